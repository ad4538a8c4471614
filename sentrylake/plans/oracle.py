"""The same results in DuckDB's SQL: what each event stands for is computed from `events` directly, without records and
parsing; the stages of `ladders` are shared text, run by another engine."""

from __future__ import annotations

from ..config import ANOMALY_THRESHOLD
from ..functions.constants import TACTICS, TECHNIQUES
from ..operators import ladders as L
from ..sources.audit import FACTOR, ORIGIN, START, command

_S = "kind = 'SYSCALL'"
_name = "CASE WHEN {0} = 0 THEN 'root' WHEN {0} = -1 THEN 'unset' ELSE concat('u', {0}) END".format
_login = "CASE WHEN auid = -1 THEN '4294967295' ELSE CAST(auid AS VARCHAR) END"
#: The raw line of an event.
LINE = f"""CASE WHEN {_S}
  THEN concat('type=SYSCALL msg=audit(', epoch, ':', f.event_id, '): arch=c000003e syscall=59 success=yes exit=0 ppid=1000 pid=', 2000 + f.event_id % 50000, ' auid=', {_login}, ' uid=', uid, ' euid=', uid,
    ' tty=pts0 ses=3 comm="', regexp_replace(prog, '^.*/', ''), '" exe="', prog, '" key="', akey, '"', chr(29), 'ARCH=x86_64 SYSCALL=', call, ' AUID="', {_name('auid')}, '" UID="', {_name('uid')}, '"')
  ELSE concat('type=', kind, ' msg=audit(', epoch, ':', f.event_id, '): pid=', 2000 + f.event_id % 50000, ' uid=', uid, ' auid=', {_login}, ' ses=3 msg=''op=PAM acct="', CASE WHEN event_type = 'error' THEN 'root' ELSE concat('u', user_id) END,
    '" exe="/usr/sbin/sshd" hostname=', addr, ' addr=', addr, ' terminal=ssh res=', CASE WHEN event_type = 'error' THEN 'failed' ELSE 'success' END, ''' AUID="', {_name('auid')}, '" UID="', {_name('uid')}, '"') END"""
FACTS = f"""
f0 AS (SELECT event_id, event_type, user_id, epoch_us(ts) AS raw_us FROM events),
f1 AS (SELECT *, CAST({START} + (raw_us - {ORIGIN}) // {FACTOR} AS BIGINT) AS us, event_id % 16 AS k FROM f0),
f AS (SELECT *, make_timestamp(us) AS ts, concat(us // 1000000, '.', lpad(CAST((us % 1000000) // 1000 AS VARCHAR), 3, '0')) AS epoch, concat('host-', user_id % 5) AS host,
  CASE event_type WHEN 'error' THEN 'USER_AUTH' WHEN 'signup' THEN 'USER_LOGIN' ELSE 'SYSCALL' END AS kind,
  CASE WHEN event_type = 'purchase' OR event_id % 97 = 0 THEN 0 ELSE 1000 + user_id % 20 END AS uid,
  CASE WHEN event_id % 97 = 0 THEN -1 ELSE 1000 + user_id % 20 END AS auid,
  CASE event_type WHEN 'view' THEN 'openat' ELSE 'execve' END AS call,
  CASE WHEN event_id % 11 = 0 THEN '?' ELSE concat('203.0.113.', user_id % 250) END AS addr,
  {command('k', 0)} AS prog, {command('k', 1)} AS cmdline,
  CASE WHEN k = 14 THEN '/etc/shadow' WHEN k = 15 THEN '/var/log/auth.log' WHEN event_type = 'view' THEN concat('/srv/data/', user_id % 7, '.txt') END AS path,
  CASE WHEN event_type = 'purchase' THEN 'privileged_commands' WHEN k = 14 THEN 'shadow' ELSE '(null)' END AS akey
  FROM f1),
ev AS (SELECT CAST(event_id * 8 AS BIGINT) AS ordinal, event_id AS n, event_type AS etype, k, ts, us, CAST((us // 3600000000) % 24 AS INT) AS hour_utc, CAST(isodow(ts) - 1 AS INT) AS weekday,
  concat(epoch, ':', event_id) AS event_id, host, kind AS record_type, CASE WHEN {_S} THEN call END AS action, CAST(uid AS BIGINT) AS uid, CAST(CASE WHEN {_S} THEN uid ELSE -1 END AS BIGINT) AS euid, CAST(auid AS BIGINT) AS auid,
  CASE WHEN uid = 0 THEN 'root' ELSE concat('u', uid) END AS user_name, CASE WHEN auid <> -1 THEN concat('u', auid) END AS auid_name,
  CASE WHEN {_S} THEN prog ELSE '/usr/sbin/sshd' END AS exe, CASE WHEN {_S} THEN regexp_replace(prog, '^.*/', '') END AS comm, CASE WHEN {_S} THEN cmdline END AS proctitle, CASE WHEN {_S} THEN cmdline END AS argv_text,
  CASE WHEN {_S} THEN length(cmdline) - length(replace(cmdline, ' ', '')) + 1 ELSE 0 END AS n_args, CASE WHEN {_S} THEN coalesce(path, '') ELSE '' END AS path_text, CASE WHEN {_S} THEN concat('/home/u', uid) END AS cwd,
  CASE WHEN {_S} THEN 'pts0' ELSE 'ssh' END AS tty, CASE WHEN NOT {_S} THEN addr END AS remote_addr, CASE WHEN event_type = 'error' THEN 'root' WHEN event_type = 'signup' THEN concat('u', user_id) END AS acct,
  event_type <> 'error' AS success, CASE WHEN {_S} THEN CASE WHEN event_type = 'purchase' THEN 'privileged_commands' WHEN k = 14 THEN 'shadow' ELSE '(null)' END END AS audit_key,
  CAST(2000 + f.event_id % 50000 AS BIGINT) AS pid, CAST(CASE WHEN {_S} THEN 1000 ELSE -1 END AS BIGINT) AS ppid, CASE WHEN {_S} THEN CASE WHEN f.event_id % 2 = 1 THEN call ELSE '59' END END AS syscall,
  CASE WHEN {_S} AND k IN (4, 5, 12) THEN concat('192.168.10.', 1 + f.event_id % 200) END AS dest_ip, CAST(CASE WHEN {_S} AND k IN (4, 5, 12) THEN 20 + f.event_id * 37 % 9000 ELSE -1 END AS BIGINT) AS dest_port,
  {LINE} AS line
  FROM f)"""  # noqa: S608


def stage(name: str, source: str, columns: list[tuple[str, str]]) -> str:
    return f"{name} AS (SELECT *, {', '.join(f'{e} AS {n}' for n, e in columns)} FROM {source})"


_account = "coalesce(nullif(acct, ''), nullif(auid_name, ''), CASE WHEN auid >= 0 THEN CAST(auid AS VARCHAR) END, nullif(user_name, ''), CASE WHEN uid >= 0 THEN CAST(uid AS VARCHAR) END, 'unknown')"
SIGNALS = f"""
s0 AS (SELECT *, {_account} AS account FROM flg),
sig AS (SELECT *, CAST(sum(CAST(is_auth_failure AS INT)) OVER (PARTITION BY host, account ORDER BY us RANGE BETWEEN 600000000 PRECEDING AND CURRENT ROW) AS BIGINT) AS recent_auth_failures,
  CAST(count(DISTINCT CASE WHEN dest_port > 0 THEN dest_port END) OVER (PARTITION BY host ORDER BY us RANGE BETWEEN 300000000 PRECEDING AND CURRENT ROW) AS BIGINT) AS recent_distinct_ports FROM s0)"""

_keyed = " UNION ALL ".join(f"SELECT '{k}' AS kind, {c} AS key, ordinal FROM sig" for k, (c, _) in zip(L.KINDS, L.KEYS, strict=True))
PROFILE = f"""
prof AS (SELECT kind, key, count(*) AS n, min(ordinal) AS first_seen FROM ({_keyed}) WHERE key IS NOT NULL GROUP BY kind, key),
tot AS (SELECT kind, CAST(sum(n) AS BIGINT) AS total, count(*) AS cardinality FROM prof GROUP BY kind)"""


def _rarity(k: str) -> str:
    w = f"(t_{k}.total + 0.5e0 * (t_{k}.cardinality + 1))"
    return f"CASE WHEN sig.k_{k} IS NULL THEN 0.5e0 ELSE greatest(0e0, least(1e0, ln((coalesce(p_{k}.n, 0) + 0.5e0) / {w}) / ln(0.5e0 / {w}))) END AS rarity_{k}"


_joins = " ".join(f"LEFT JOIN prof p_{k} ON p_{k}.kind = '{k}' AND p_{k}.key = sig.k_{k} LEFT JOIN tot t_{k} ON t_{k}.kind = '{k}'" for k in L.READ_KINDS)
RARITY = f"rar AS (SELECT sig.*, {', '.join(map(_rarity, L.READ_KINDS))} FROM sig {_joins})"
FEATURES = stage("fea", "rar", L.FEATURES)
SCORED = f"""
raw AS (SELECT *, round(-(rarity_host_exe + rarity_user_exe + rarity_exe + rarity_user_host) / 4, 6) AS raw_score FROM fea),
cal AS (SELECT list_transform(quantile_cont(round(raw_score, 9), [{', '.join(repr(i / 1000) for i in range(1001))}]), lambda x: round(x, 9)) AS q, stddev_pop(round(raw_score, 9)) AS sd FROM raw),
sc0 AS (SELECT raw.*, 1 - len(list_filter(cal.q, lambda x: x <= round(raw.raw_score, 9))) / 1001e0 AS a0, CASE WHEN cal.sd = 0 THEN 1e0 ELSE cal.sd END AS sd FROM raw, cal),
sco AS (SELECT *, round(a0, 4) AS anomaly_score, CASE WHEN a0 >= {ANOMALY_THRESHOLD} THEN -1 ELSE 1 END AS prediction, round(1 / (1 + exp(2e0 * raw_score / sd)), 4) AS confidence, 0.5e0 AS criticality FROM sc0)"""
RULES = stage("rul", "sco", L.RULE_COLUMNS)
_terms = ", ".join(f"{{'id': '{t}', 'conf': {best}, 'place': {place}}}" for t, best, place in L.technique_terms())
_techniques = ", ".join(f"('{t}', '{tactic}', '{TACTICS[tactic]}', '{name}', {base!r}e0)" for t, (tactic, name, base) in TECHNIQUES.items())
TAGS = f"""
cat AS (SELECT * FROM (VALUES {_techniques}) v(id, tactic_id, tactic, name, base)),
tag0 AS (SELECT ordinal, unnest([{_terms}]) AS t FROM rul),
tags AS (SELECT ordinal, t.id AS id, CAST(t.conf AS DOUBLE) AS conf, row_number() OVER (PARTITION BY ordinal ORDER BY t.conf DESC, t.place) AS rn FROM tag0 WHERE t.conf >= {L.LEAST_CONFIDENCE}),
top AS (SELECT ordinal AS o, max(CASE WHEN rn = 1 THEN tags.id END) AS technique_1, max(CASE WHEN rn = 2 THEN tags.id END) AS technique_2, max(CASE WHEN rn = 1 THEN name END) AS technique_1_name,
  string_agg(CASE WHEN rn <= 3 THEN tags.id END, ', ' ORDER BY rn) AS technique_list, max(base * (0.5e0 + 0.5e0 * round(conf, 2))) AS sev FROM tags JOIN cat ON cat.id = tags.id GROUP BY ordinal),
tec AS (SELECT rul.*, technique_1, technique_2, technique_1_name, technique_list, coalesce(sev, 0e0) AS technique_severity, CASE WHEN touches_sensitive THEN path_text ELSE '' END AS sensitive_list,
  CASE record_type WHEN 'SYSCALL' THEN 'Syscall' WHEN 'USER_AUTH' THEN 'User_Auth' ELSE 'User_Login' END AS type_title FROM rul LEFT JOIN top ON o = ordinal)"""
_risk = L.risk_stages()
RISK = ",\n".join(stage(f"ri{k}", "tec" if k == 0 else f"ri{k - 1}", s) for k, s in enumerate(_risk))
EXPLAIN = ",\n".join((stage("fac", f"ri{len(_risk) - 1}", L.FACTOR_TEXT), stage("exp", "fac", L.EXPLAIN), stage("asd", "exp", L.SUMMARY)))
_iso = "concat(strftime(ts, '%Y-%m-%dT%H:%M:%S'), CASE WHEN us % 1000000 > 0 THEN concat('.', lpad(CAST(us % 1000000 AS VARCHAR), 6, '0')) ELSE '' END, '+00:00')"
ALERTS = f"""
al AS (SELECT *, concat(host, ':', {_iso}, ':', event_id, ':', record_type) AS alert_id, CASE WHEN n % 3 = 0 THEN TIMESTAMP '2024-01-05 06:00:00' ELSE TIMESTAMP '2024-01-06 12:00:00' END AS scored_at, ts AS event_ts, record_type AS event_type,
  CAST(anomaly_score AS FLOAT) AS anomaly_f, auid_name AS audit_name, k IN (4, 5, 6, 7, 8, 9, 13, 14, 15) AND record_type = 'SYSCALL' OR record_type = 'USER_AUTH' AS bad FROM asd)"""
ALERT_TAGS = "atg AS (SELECT alert_id, tags.id AS technique_id, name AS technique_name, tactic, CAST(CAST(round(conf, 2) AS FLOAT) AS DOUBLE) AS conf FROM al JOIN tags USING (ordinal) JOIN cat ON cat.id = tags.id)"

CHAIN = [
    ("ev", FACTS),
    ("nam", stage("nam", "ev", L.NAMES)),
    ("flg0", stage("flg0", "nam", L.FLAGS)),
    ("flg", stage("flg", "flg0", L.KEYS)),
    ("sig", SIGNALS),
    ("prof", PROFILE),
    ("rar", RARITY),
    ("fea", FEATURES),
    ("sco", SCORED),
    ("rul", RULES),
    ("tec", TAGS),
    ("risk", RISK),
    ("asd", EXPLAIN),
    ("al", ALERTS),
    ("atg", ALERT_TAGS),
]


def sql(upto: str, select: str) -> str:
    """The common tables up to a stage, then a query over them."""
    names = [n for n, _ in CHAIN]
    parts = [t.strip() for _, t in CHAIN[: names.index(upto) + 1]]
    return "WITH " + ",\n".join(parts) + "\n" + select


def risk_sql(weights: dict | None, hosts: dict[str, float], select: str) -> str:
    """A query over the risk stages with other weights and criticalities of hosts."""
    own = "CASE " + " ".join(f"WHEN host = '{h}' THEN {v!r}e0" for h, v in hosts.items()) + " ELSE 0.5e0 END AS criticality"
    return risk_as(own, L.risk_stages(weights), select)


def risk_as(criticality: str, stages: list, select: str, threshold: float = ANOMALY_THRESHOLD) -> str:
    changed = ",\n".join(stage(f"ri{k}", "tec" if k == 0 else f"ri{k - 1}", s) for k, s in enumerate(stages))
    text = sql("tec", "").rstrip().replace("0.5e0 AS criticality", criticality).replace(f"a0 >= {ANOMALY_THRESHOLD}", f"a0 >= {threshold}")
    return text + ",\n" + changed + "\n" + select
