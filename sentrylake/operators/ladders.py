"""Rules as data: flags, features, technique rules, risk factors and explanations as named SQL expressions.

Each list is a stage: (column, expression over the columns before it). `apply` adds a stage to a DataFrame; new
features and rules are new entries. Paths of an event are one text (`path_text`), a line each, so that "some path
contains x" is `contains(path_text, 'x')`. Numbers in exponent form are doubles.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..config import BANDS, DEFAULT_CRITICALITY, RISK_WEIGHTS, Bands
from ..functions import constants as C


def quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def among(column: str, names) -> str:
    return f"coalesce({column} IN ({', '.join(quoted(n) if isinstance(n, str) else str(n) for n in names)}), false)"


def some(column: str, needles) -> str:
    return "(" + " OR ".join(f"coalesce(contains({column}, {quoted(n)}), false)" for n in needles) + ")"


def begins(column: str, prefixes) -> str:
    return "(" + " OR ".join(f"coalesce({column} LIKE {quoted(p + '%')}, false)" for p in prefixes) + ")"


def num(x: float) -> str:
    return f"{x!r}e0"


def apply(df: DataFrame, *stages: list[tuple[str, str]]) -> DataFrame:
    for stage in stages:
        df = df.selectExpr("*", *(f"{e} AS {n}" for n, e in stage))
    return df


# --- flags of an event ---

NAMES = [
    ("process_name", "coalesce(nullif(comm, ''), nullif(regexp_replace(exe, '^.*/', ''), ''))"),
    ("command_line", "coalesce(nullif(proctitle, ''), argv_text)"),
    ("ref_id", "CASE WHEN uid <> -1 THEN uid ELSE auid END"),
    ("is_root", "(euid = 0 OR (euid = -1 AND uid = 0))"),
    ("privilege_transition", "(auid <> -1 AND uid <> -1 AND auid <> uid AND auid >= 1000)"),
    ("is_auth_event", among("record_type", C.AUTH_TYPES)),
    ("sensitive_text", "lower(path_text)"),
]
_private = " OR ".join(["dest_ip IN ('127.0.0.1', '::1', '0.0.0.0')", *(f"dest_ip LIKE {quoted(p + '%')}" for p in ("10.", "192.168.", "169.254.", "172.", "fe80", "fc", "fd"))])
FLAGS = [
    ("is_root_daemon", "(is_root AND auid = -1)"),
    ("is_login_user", "(ref_id >= 1000)"),
    ("is_system_user", "(ref_id > 0 AND ref_id < 1000)"),
    ("cmd", "coalesce(command_line, '')"),
    ("cmd_lower", "lower(coalesce(command_line, ''))"),
    ("exe_unusual", f"(coalesce(exe LIKE '/%', false) AND NOT {begins('exe', C.SYSTEM_DIRS)})"),
    ("is_shell", among("process_name", C.SHELLS)),
    ("is_interpreter", among("process_name", C.INTERPRETERS)),
    ("is_network_tool", among("process_name", C.NET_TOOLS)),
    ("is_scanner", among("process_name", C.SCANNERS)),
    ("is_cred_tool", among("process_name", C.CRED_TOOLS)),
    ("is_auth_failure", "(is_auth_event AND coalesce(NOT success, false))"),
    ("touches_sensitive", some("sensitive_text", C.SENSITIVE)),
    ("is_remote", f"(coalesce(remote_addr <> '' AND remote_addr NOT IN ('?', '127.0.0.1', '::1'), false) OR coalesce(contains(tty, 'ssh'), false) OR (dest_ip IS NOT NULL AND NOT coalesce({_private}, false)))"),
    ("has_addr", "coalesce(remote_addr <> '', false)"),
    ("exe_key", "coalesce(nullif(exe, ''), nullif(comm, ''))"),
    ("user_key", "coalesce(nullif(auid_name, ''), CASE WHEN auid <> -1 THEN CAST(auid AS STRING) END)"),
]

# --- baseline keys: null where a part is missing ---

PAIR = "{} || chr(31) || {}".format
KEYS = [
    ("k_host_exe", PAIR("nullif(host, '')", "exe_key")),
    ("k_user_exe", PAIR("user_key", "exe_key")),
    ("k_exe", "exe_key"),
    ("k_record_type", "nullif(record_type, '')"),
    ("k_user_host", PAIR("user_key", "nullif(host, '')")),
    ("k_comm_exe", PAIR("nullif(comm, '')", "nullif(exe, '')")),
]
KINDS = ("host_exe", "user_exe", "exe", "record_type", "user_host", "comm_exe")
READ_KINDS = KINDS[:5]

# --- the 28 features, in the order of the model's contract ---

_flag = "CAST({} AS DOUBLE)".format
FEATURES = [
    ("hour", "CAST(coalesce(hour_utc, 12) AS DOUBLE)"),
    ("is_offhours", _flag("coalesce(hour_utc < 7 OR hour_utc >= 19, false)")),
    ("is_weekend", _flag("coalesce(weekday >= 5, false)")),
    ("f_is_root", _flag("is_root")),
    ("f_is_system_user", _flag("is_system_user")),
    ("f_is_login_user", _flag("is_login_user")),
    ("f_privilege_transition", _flag("privilege_transition")),
    ("is_privileged_key", _flag(among("audit_key", C.PRIVILEGED_KEYS))),
    ("auth_failure", _flag("is_auth_failure")),
    ("f_recent_auth_failures", "CAST(least(recent_auth_failures, 20) AS DOUBLE)"),
    ("proctitle_len", "CAST(least(length(cmd), 400) AS DOUBLE)"),
    ("proctitle_tokens", "CAST(CASE WHEN trim(cmd) = '' THEN 0 ELSE least(length(trim(cmd)) - length(replace(trim(cmd), ' ', '')) + 1, 50) END AS DOUBLE)"),
    ("arg_count", "CAST(least(n_args, 50) AS DOUBLE)"),
    ("exe_depth", "CAST(coalesce(length(exe) - length(replace(exe, '/', '')), 0) AS DOUBLE)"),
    ("exe_unusual_dir", _flag("exe_unusual")),
    ("f_is_shell", _flag("is_shell")),
    ("f_is_interpreter", _flag("is_interpreter")),
    ("f_is_network_tool", _flag("is_network_tool")),
    ("f_is_scanner", _flag("is_scanner")),
    ("has_sensitive_path", _flag("touches_sensitive")),
    ("f_is_remote", _flag("is_remote")),
    ("dest_port_class", f"CASE WHEN dest_port < 0 THEN 0e0 WHEN {among('dest_port', C.RISKY_PORTS)} THEN 3e0 WHEN {among('dest_port', C.COMMON_PORTS)} THEN 1e0 WHEN dest_port BETWEEN 1 AND 1023 THEN 2e0 ELSE 1.5e0 END"),
    ("f_recent_distinct_ports", "CAST(least(recent_distinct_ports, 50) AS DOUBLE)"),
    *((f"{k}_rarity", f"rarity_{k}") for k in READ_KINDS),
]
FEATURE_NAMES = [n for n, _ in FEATURES]

# --- technique rules: (technique, [(condition, confidence), ...]), the first condition that holds counts ---

_reverse = some("cmd_lower", C.REVERSE_SHELL)
_piped = "((contains(cmd_lower, 'curl') OR contains(cmd_lower, 'wget')) AND " + some("cmd_lower", ("| sh", "| bash", "|sh", "|bash")) + ")"
_second = "regexp_replace(split_part(trim(cmd_lower), ' ', 2), '^.*/', '')"
_sudo_shell = f"(split_part(trim(cmd_lower), ' ', 2) <> '' AND split_part(trim(cmd_lower), ' ', 1) LIKE '%sudo' AND ({among(_second, ('su', 'bash', 'sh', 'zsh', 'dash', '-i', '-s'))} OR contains(concat(' ', cmd_lower, ' '), ' -i ')))"
_writes = lambda *needles: f"({among('action', C.WRITE_CALLS)} AND {some('path_text', needles)})"
_named = lambda *names: among("process_name", names)
RULES = [
    ("T1059.004", [("is_shell AND (privilege_transition OR exe_unusual OR is_remote)", 0.6), ("is_shell AND cmd <> ''", 0.4)]),
    ("T1059.006", [("is_interpreter AND process_name LIKE 'python%' AND (exe_unusual OR is_remote)", 0.6)]),
    ("T1204.002", [("exe_unusual AND coalesce(action = 'execve', false) AND is_login_user", 0.4)]),
    ("T1059.004", [(_reverse, 0.85)]),
    ("T1071", [(_reverse, 0.5)]),
    ("T1105", [(_piped, 0.8), (f"{_named('wget', 'curl')} AND is_remote", 0.55)]),
    ("T1219", [(_named("teamviewer", "anydesk", "ngrok", "rustdesk"), 0.6)]),
    ("T1571", [("dest_port > 1024 AND dest_port NOT IN (3389, 8080, 8443) AND is_network_tool", 0.5)]),
    ("T1046", [("is_scanner", 0.8), ("recent_distinct_ports >= 15", 0.5)]),
    ("T1018", [(f"{_named('ping', 'arp', 'fping')} AND is_remote", 0.35)]),
    ("T1021.004", [(f"{_named('ssh', 'sshpass')} AND is_remote", 0.55), ("record_type = 'USER_LOGIN' AND has_addr AND coalesce(success, false)", 0.5)]),
    ("T1110", [("is_auth_failure AND recent_auth_failures >= 5", 0.85)]),
    ("T1003.008", [(f"NOT is_root_daemon AND {some('path_text', ('/etc/shadow', '/etc/gshadow'))}", 0.8), (some("path_text", ("/etc/shadow", "/etc/gshadow")), 0.6)]),
    ("T1552.004", [(f"privilege_transition AND {some('path_text', ('id_rsa', 'id_ed25519', '/.ssh/'))}", 0.7), (some("path_text", ("id_rsa", "id_ed25519", "/.ssh/")), 0.5)]),
    ("T1548.003", [(f"{_named('sudo')} AND {_sudo_shell}", 0.85), (f"record_type = 'USER_CMD' AND {_sudo_shell}", 0.4)]),
    ("T1548.001", [(f"{_named('setcap')} OR ({_named('chmod')} AND {some('cmd', ('+s', 'u+s', 'g+s', '4755', '2755', '6755'))})", 0.7)]),
    ("T1136.001", [(f"{_named('useradd', 'adduser')} OR record_type = 'ADD_USER'", 0.7)]),
    ("T1098", [(f"{_named('usermod', 'gpasswd', 'chage')} OR record_type IN ('ADD_GROUP', 'GRP_MGMT')", 0.6)]),
    ("T1053.003", [(f"{_named('crontab')} OR {_writes('/etc/cron', '/var/spool/cron/')}", 0.6)]),
    ("T1543.002", [(_writes("/etc/systemd/system/", "/lib/systemd/system/", "/run/systemd/system/", ".service"), 0.65), (f"{_named('systemctl')} AND privilege_transition AND {some('cmd', (' enable ', ' disable ', ' mask ', '--now'))}", 0.5)]),
    ("T1547.006", [(f"{_named('insmod', 'modprobe')} OR {among('action', ('init_module', 'finit_module'))}", 0.7)]),
    ("T1562.001", [(f"({_named('auditctl')} AND {some('cmd', (' -e 0', ' -e0', ' -D'))}) OR ({_named('setenforce')} AND contains(cmd, '0')) OR ({_named('systemctl', 'service')} AND {some('cmd', ('stop auditd', 'disable auditd', 'stop apparmor', 'stop falcon'))})", 0.8)]),
    ("T1070.002", [(f"contains(path_text, '/var/log/') AND {among('action', ('unlink', 'unlinkat', 'truncate', 'ftruncate', 'rename'))}", 0.7)]),
    ("T1070.003", [(f"{some('path_text', ('.bash_history', '.zsh_history'))} AND {among('action', ('unlink', 'unlinkat', 'truncate', 'ftruncate', 'openat'))}", 0.65)]),
    ("T1222.002", [(f"{_named('chmod', 'chown', 'chattr')} AND touches_sensitive", 0.4)]),
]
LEAST_CONFIDENCE = 0.35
RULE_COLUMNS = [(f"rule_{k}", "CASE " + " ".join(f"WHEN {c} THEN {num(v)}" for c, v in ladder) + " END") for k, (_, ladder) in enumerate(RULES)]


def technique_terms() -> list[tuple[str, str, str]]:
    """(technique, confidence, place in the order of firing) from the rule columns: the strongest rule counts, and the
    first that fired gives the place."""
    out = []
    for t in dict.fromkeys(t for t, _ in RULES):
        mine = [k for k, (u, _) in enumerate(RULES) if u == t]
        best = f"rule_{mine[0]}" if len(mine) == 1 else f"greatest({', '.join(f'rule_{k}' for k in mine)})"
        place = "CASE " + " ".join(f"WHEN rule_{k} IS NOT NULL THEN {k}" for k in mine) + " END"
        out.append((t, best, place))
    return out


# --- risk ---


def _ladder(*steps, otherwise: float) -> str:
    return "CASE " + " ".join(f"WHEN {c} THEN {num(v)}" for c, v in steps) + f" ELSE {num(otherwise)} END"


def _mean(weights: dict, prefix: str) -> str:
    total = sum(weights.values()) or 1.0
    return "(" + " + ".join(f"{num(float(w))} * {prefix}{k}" for k, w in weights.items()) + f") / {num(float(total))}"


def risk_stages(weights: dict | None = None, bands: Bands = BANDS) -> list[list[tuple[str, str]]]:
    """Sub-factors, their means, the technical severity, the context modifier, the score and its band. Needs the flags,
    rarities, technique_severity, anomaly_score and criticality."""
    w = weights or RISK_WEIGHTS
    subs = [
        ("impact_privilege", _ladder(("privilege_transition AND is_root", 1.0), ("is_root AND NOT is_root_daemon", 0.8), ("privilege_transition", 0.6), ("is_root_daemon", 0.4), otherwise=0.2)),
        ("impact_confidentiality", _ladder((some("path_text", ("/etc/shadow", "id_rsa", "id_ed25519")), 1.0), (some("path_text", ("/.ssh/", ".bash_history", "/etc/passwd")), 0.7), ("is_network_tool AND is_remote", 0.5), ("touches_sensitive", 0.5), otherwise=0.15)),
        ("impact_integrity", _ladder((some("path_text", C.PERSISTENCE), 0.9), (among("record_type", C.ACCOUNT_TYPES), 0.8), ("record_type = 'CONFIG_CHANGE'", 0.7), (f"{among('action', C.INTEGRITY_CALLS)} AND privilege_transition", 0.55), (among("action", C.INTEGRITY_CALLS), 0.3), otherwise=0.1)),
        ("impact_availability", _ladder((f"{among('process_name', C.SERVICE_PROGRAMS)} AND {some('cmd', ('stop', 'disable', 'mask', 'kill', '-9'))}", 0.7), (among("process_name", C.SERVICE_PROGRAMS), 0.4), ("record_type = 'SERVICE_STOP'", 0.5), (_named("auditctl", "setenforce"), 0.6), otherwise=0.1)),
        ("exploit_privilege_required", _ladder(("is_login_user AND NOT is_root", 1.0), ("privilege_transition", 0.7), ("is_system_user", 0.4), ("is_root_daemon", 0.2), otherwise=0.5)),
        ("exploit_attack_complexity", _ladder((f"is_shell OR is_interpreter OR {among('record_type', ('USER_CMD', 'USER_LOGIN', 'USER_AUTH'))}", 0.9), ("coalesce(action = 'execve', false)", 0.7), otherwise=0.4)),
        ("exploit_auth_context", _ladder(("is_auth_failure AND recent_auth_failures >= 5", 1.0), ("is_auth_failure", 0.5), ("record_type = 'USER_LOGIN' AND has_addr", 0.4), otherwise=0.1)),
        ("exploit_remote", _ladder(("is_remote AND (dest_ip IS NOT NULL OR has_addr)", 1.0), ("is_remote", 0.7), ("dest_port > 0", 0.3), otherwise=0.0)),
        ("rarity", "greatest(rarity_host_exe, rarity_user_exe, rarity_exe, rarity_user_host)"),
    ]
    means = [("impact", _mean(w["impact"], "impact_")), ("exploitability", _mean(w["exploitability"], "exploit_"))]
    floor, mod = w["technique_floor"], w["context_modifier"]
    base = _mean({"impact": w["technical_severity"]["impact"], "exploitability": w["technical_severity"]["exploitability"]}, "")
    technical = [
        ("technical_severity", f"CASE WHEN technique_severity > 0 THEN greatest({base}, least({num(floor['base'])} + {num(floor['scale'])} * technique_severity, 1e0)) ELSE {base} END"),
        ("context_modifier", f"greatest({num(mod['min'])}, least({num(mod['max'])}, {num(mod['base'])} + {num(mod['anomaly'])} * anomaly_score + {num(mod['rarity'])} * rarity + {num(mod['technique'])} * technique_severity + {num(mod['asset'])} * (criticality - 0.5e0) * 2e0))"),
    ]
    # nine decimals first: a product that should be exact but is a hair below .5 rounds alike everywhere
    exact = "round(greatest(0e0, least(100e0, 100e0 * technical_severity * context_modifier)), 9)"
    half_even = f"CAST(CASE WHEN {exact} - floor({exact}) = 0.5e0 THEN 2 * round({exact} / 2e0) ELSE floor({exact} + 0.5e0) END AS INT)"
    severity = "CASE " + " ".join(f"WHEN risk_score >= {least} THEN '{name}'" for name, least in bands) + " ELSE 'informational' END"
    return [subs, means, technical, [("risk_score", half_even)], [("severity", severity)]]


FACTORS = [
    ("privilege_transition", "privilege_transition"),
    ("interactive_root", "is_root AND NOT is_root_daemon"),
    ("sensitive_audit_rule", "is_privileged_key > 0"),
    ("auth_failure", "is_auth_failure"),
    ("repeated_auth_failure", "recent_auth_failures >= 5"),
    ("rare_behaviour", "rarity >= 0.85e0"),
    ("uncommon_behaviour", "rarity >= 0.6e0 AND rarity < 0.85e0"),
    ("executable_outside_system_path", "exe_unusual"),
    ("shell_execution", "is_shell"),
    ("interpreter_execution", "is_interpreter"),
    ("port_scanning", "is_scanner OR recent_distinct_ports >= 15"),
    ("remote_origin", "is_remote"),
    ("sensitive_file_access", "touches_sensitive"),
    ("off_hours", "is_offhours > 0"),
    ("model_high_anomaly", "anomaly_score >= 0.9e0"),
]
#: The factor tags as one text, a space between; the first two techniques last.
FACTOR_TEXT = [("factor_text", "trim(concat_ws(' ', " + ", ".join(f"CASE WHEN {c} THEN '{n}' END" for n, c in FACTORS) + ", 'mitre_' || technique_1, 'mitre_' || technique_2))")]

# --- explanation ---

_tag = "contains(concat(' ', factor_text, ' '), ' {} ')".format
_who = "coalesce(nullif(auid_name, ''), CASE WHEN auid >= 0 THEN CAST(auid AS STRING) END, '{}')".format
_rarity_word = "CASE WHEN rarity >= 0.85e0 THEN 'Very high' WHEN rarity >= 0.6e0 THEN 'High' WHEN rarity >= 0.35e0 THEN 'Moderate' ELSE 'Low' END"
EXPLAIN = [
    ("privilege_phrase", f"CASE WHEN privilege_transition AND is_root THEN concat('Root (via privilege escalation from ', chr(39), {_who('a user')}, chr(39), ')') WHEN is_root AND NOT is_root_daemon THEN 'Root (interactive)' "
     "WHEN is_root_daemon THEN 'Root (system service)' WHEN privilege_transition THEN 'Elevated (privilege transition)' WHEN is_login_user THEN concat('Standard user (', coalesce(nullif(user_name, ''), CAST(uid AS STRING)), ')') ELSE 'Unprivileged' END"),
    ("rarity_word", _rarity_word),
    ("title", f"CASE WHEN {_tag('repeated_auth_failure')} THEN 'Repeated authentication failures' WHEN {_tag('port_scanning')} THEN 'Network scanning activity' WHEN {_tag('mitre_T1003.008')} THEN 'Credential store access' "
     f"WHEN privilege_transition AND {_tag('rare_behaviour')} THEN 'Rare privileged process execution' WHEN privilege_transition THEN 'Privilege escalation' WHEN is_remote AND (is_network_tool OR is_shell) THEN 'Remote command execution' "
     f"WHEN exe_unusual AND coalesce(action = 'execve', false) THEN 'Execution from a non-standard path' WHEN touches_sensitive THEN 'Sensitive file access' WHEN {_tag('rare_behaviour')} THEN concat('Rare ', type_title, ' activity') "
     "WHEN technique_1 IS NOT NULL THEN technique_1_name ELSE concat('Anomalous ', type_title, ' activity') END"),
    ("actor", "coalesce(nullif(process_name, ''), nullif(exe, ''), lower(record_type))"),
]
_command = "CASE WHEN cmd <> '' AND cmd <> actor THEN concat(' (`', substring(cmd, 1, 160), CASE WHEN length(cmd) > 160 THEN '…' ELSE '' END, '`)') ELSE '' END"
_where = "coalesce(nullif(remote_addr, ''), dest_ip)"
SUMMARY = [
    ("summary", "concat(concat_ws('; ', "
     f"concat(actor, ' was executed by ', coalesce(nullif(user_name, ''), CASE WHEN uid >= 0 THEN concat('uid ', uid) END, 'an unknown user'), ' on ', coalesce(nullif(host, ''), 'an unknown host'), {_command}), "
     f"CASE WHEN privilege_transition THEN concat('the action ran with escalated privileges from ', chr(39), {_who('another account')}, chr(39)) END, "
     "CASE WHEN rarity >= 0.6e0 THEN concat('this executable is ', lower(rarity_word), ' rarity for this user/host in the learned baseline') END, "
     "CASE WHEN recent_auth_failures >= 5 THEN concat(recent_auth_failures, ' authentication failures preceded it in a short window') END, "
     f"CASE WHEN is_remote THEN concat('the session originated remotely', CASE WHEN {_where} IS NOT NULL THEN concat(' from ', {_where}) ELSE '' END) END, "
     "CASE WHEN touches_sensitive THEN concat('it touched sensitive files (', sensitive_list, ')') END"
     "), '. Model anomaly score ', CAST(floor(round(anomaly_score * 100e0, 6) + 0.5e0) AS INT), '%.', CASE WHEN technique_1 IS NOT NULL THEN concat(' Mapped to ATT&CK ', technique_list, '.') ELSE '' END)"),
]
CRITICALITY = f"{DEFAULT_CRITICALITY!r}e0"
