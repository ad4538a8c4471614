import random
from datetime import datetime, timedelta, timezone

import numpy as np

from sentrylake.operators.correlate import correlated
from sentrylake.operators.normalize import parsed
from sentrylake.operators.signals import PORTS
from sentrylake.plans import registry as R
from sentrylake.plans.session import prepare
from sentrylake.sources.audit import RAW
from sentrylake.streaming.state import correlation_stream, in_sight, port_signals

T0 = datetime(2024, 1, 5, 4, tzinfo=timezone.utc)


def test_in_sight_by_definition():
    rng = np.random.default_rng(2)
    for _ in range(20):
        us, ordinal = rng.integers(0, 5 * PORTS, 80) // 7 * 7, rng.permutation(80)
        seen = (rng.integers(1, 6, 60), rng.integers(0, 5 * PORTS, 60) // 7 * 7, rng.permutation(np.arange(80, 140)))
        us[:20] = seen[1][:20] + PORTS  # just in reach
        us[20:40] = seen[1][20:40]  # of the same instant
        ordinal[20:40] = seen[2][20:40] + rng.integers(-1, 2, 20)
        want = [len({p for p, t, o in zip(*seen, strict=True) if (t, o) <= (u, k) and t >= u - PORTS}) for u, k in zip(us, ordinal, strict=True)]
        assert in_sight(us, ordinal, seen).tolist() == want
    assert in_sight(np.array([5]), np.array([0]), (np.zeros(0, np.int64),) * 3).tolist() == [0]


def test_ports_across_micro_batches(spark, tmp_path):
    """Random sightings over slices and hosts in four turns that overlap in time: each event counts what has come by its
    turn and lies before it; without a host or a time nothing."""
    rng = random.Random(5)
    schema = "ts timestamp, host string, ordinal long, us long, dest_port long"
    base = int(T0.timestamp()) * 1_000_000
    rows = []
    for i in range(600):
        turn = i // 150
        us = base + (turn * 20 + rng.randint(0, 40)) * 60_000_000 + rng.choice((0, 0, 1, 999))
        rows.append((turn, (T0 + timedelta(microseconds=us - base), rng.choice(("a", "b", None)), i, us, rng.choice((-1, 0, None, 22, 80, 443, 8080)))))
    turns = [spark.createDataFrame([r for t, r in rows if t == k], schema) for k in range(4)]
    got = {r.ordinal: r.recent_distinct_ports for r in R._in_turns(turns, "ports-test", lambda s: port_signals(s, "1 hour")).collect()}
    want = {}
    for turn, (_, host, i, us, _) in rows:
        near = {p for t, (_, h, k, u, p) in rows if t <= turn and h == host and p and p > 0 and us - PORTS <= u and (u, k) <= (us, i)}
        want[i] = len(near) if host else 0
    assert got == want


def test_correlation_of_awkward_records(spark):
    """Children before, with, after and long after their event, two events of one id, none at all, no time, no id."""
    line = "type={} msg=audit({}.000:{}): {}".format
    at = lambda s: T0 + timedelta(seconds=s)
    second = lambda s: int(at(s).timestamp())
    one = [  # (turn, ordinal, time, text)
        (0, 1, at(0), line("CWD", second(0), 7, 'cwd="/early"')), (1, 2, at(0), line("SYSCALL", second(0), 7, "syscall=59")), (2, 3, at(0), line("CWD", second(0), 7, 'cwd="/late"')),
        (1, 4, at(1), line("SYSCALL", second(1), 8, "a=1")), (1, 5, at(1), line("SYSCALL", second(1), 8, "a=2")), (0, 6, at(1), line("PATH", second(1), 8, 'name="/x"')), (2, 7, at(1), line("PATH", second(1), 8, 'name="/y"')),
        (1, 8, at(2), line("USER_AUTH", second(2), 9, "res=failed")), (1, 9, at(3), "no record at all"), (1, 10, None, line("SYSCALL", second(4), 10, "b=1")), (2, 11, None, line("CWD", second(4), 10, 'cwd="/no/time"')),
        (0, 12, at(5), line("CWD", second(5), 11, 'cwd="/no/event"')), (0, 13, at(6), line("SYSCALL", second(6), 12, "c=1")), (4, 14, at(6), line("CWD", second(6), 12, 'cwd="/too/late"')), (3, 20, at(100_000), line("USER_END", second(100_000), 99, "")), (4, 21, at(100_001), line("USER_END", second(100_001), 98, "")),
    ]
    names = [c.split()[0] for c in RAW.split(", ")]
    prepare(spark)

    def frame(rows):
        return parsed(spark.createDataFrame([tuple({"ordinal": o, "ts": t, "message": m}.get(n) for n in names) for _, o, t, m in rows], RAW))

    turns = [frame([r for r in one if r[0] == k]) for k in range(5)]
    view = lambda rows: {r.ordinal: (r.event_id, r.ts, r.e_cwd, r.paths, r.raw_text, dict(r.kv)) for r in rows.collect()}
    got = view(R._in_turns(turns, "correlation-test", lambda s: correlation_stream(s, "1 hour")))
    want = view(correlated(frame([r for r in one if r[0] < 4])))
    assert got == {k: v for k, v in want.items() if k not in (20, 21)} and got[2][2] == "/late" and got[4][3] == got[5][3] == ["/x", "/y"] and got[13][2] is None and got[10][2] == "/no/time"
