"""Alert queries: parameters, plans, and every registered query against DuckDB."""

import glob
import math
import os
from datetime import datetime, timezone

import duckdb
import pytest

import __spark_entry__
from sentrylake.operators import alert_query as A
from sentrylake.operators import report
from sentrylake.plans import registry as R


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for p in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return con


TYPES = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN", "timestamp": "TIMESTAMP", "timestamp_ntz": "TIMESTAMP"}


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 9) + 0.0
    return v.isoformat() if hasattr(v, "isoformat") else v


@pytest.mark.parametrize("name", list(R.QUERIES))
def test_against_the_oracle(spark, sf, duck, name):
    got = R.QUERIES[name](spark, sf)
    columns = sorted(got.columns)
    rows = sorted(repr([plain(r[c]) for c in columns]) for r in got.collect())
    if name not in R.ORACLE:
        assert rows
        return
    want = duck.execute(R.ORACLE[name])
    found = {d[0]: str(d[1]) for d in want.description}
    assert sorted(found) == columns
    assert {c: TYPES[t] for c, t in got.dtypes} == found
    at = [list(found).index(c) for c in columns]
    assert rows == sorted(repr([plain(r[i]) for i in at]) for r in want.fetchall())


def test_entry(spark):
    got = __spark_entry__.entry(spark)
    assert got.columns == ["label", "from", "to", "n"] and got.count() == 5
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


@pytest.mark.parametrize("bad", [{"severity": "huge"}, {"min_risk": "x"}, {"min_anomaly": "x"}, {"anomalies_only": "maybe"}, {"from_time": "soon"}, {"sort": "name"}, {"order": "up"}, {"size": "0"}, {"from": "-1"}, {"from": "9990", "size": "50"}])
def test_bad_parameters(bad):
    with pytest.raises(A.BadQuery):
        A.from_params(bad)


def test_parameters():
    q = A.from_params({"severity": " High,low", "min_risk": "20", "size": "500", "to_time": "2024-01-05", "user": "", "order": "asc", "sort": "event_time"})
    assert q.severities == ("high", "low") and q.rows == 100 and q.until == datetime(2024, 1, 5) and q.user is None and not q.descending
    assert A.from_params({"from_time": "2024-01-05T02:00:00+02:00"}).since == datetime(2024, 1, 5)
    with pytest.raises(A.BadQuery):
        A.timeline(None, "2h")
    with pytest.raises(A.BadQuery):
        A.techniques(None, 51)


def test_get_and_page(spark, sf):
    alerts = R.alerts(spark, sf)
    one = alerts.first()
    assert A.get_one(alerts, one.alert_id).risk_score == one.risk_score
    with pytest.raises(A.NotFound):
        A.get_one(alerts, "none")
    total, page = A.AlertQuery(rows=7).page(alerts)
    rows = page.collect()
    assert total == alerts.count() and len(rows) == 7 and [r.risk_score for r in rows] == sorted((r.risk_score for r in rows), reverse=True)
    assert report.check_spread(alerts, 1.0) and not report.check_spread(alerts, 0.0)


def test_latest_takes_every_alert(spark, sf):
    got = R.alert_latest_versions(spark, sf).collect()
    assert len(got) == R.alerts(spark, sf).select("alert_id").distinct().count() and all(r.risk_score >= 0 for r in got)


def test_streamed_signals_across_hours_and_files(spark, tmp_path):
    from sentrylake.streaming.jobs import failure_signals

    hour, minute = 473_000 * 3_600_000_000, 60_000_000
    at = [hour + m * minute for m in (55, 58, 61, 66, 66, 69)]  # over the full hour
    rows = [(datetime.fromtimestamp(us / 1e6), "h", "a", i, us, i != 3) for i, us in enumerate(at)]
    schema = "ts timestamp, host string, account string, ordinal long, us long, failed boolean"
    for k, part in enumerate((rows[:2], rows[2:4], rows[4:])):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/in")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"file://{tmp_path}/in")
    got = R._drained(failure_signals(stream, "1 hour"), "signals")
    assert [r.recent_auth_failures for r in got.orderBy("ordinal").collect()] == [1, 2, 3, 2, 3, 3]
    assert got.inputFiles()  # files, not rows that the driver holds


def test_late_failures_count_nothing_after_them(spark, tmp_path):
    from sentrylake.streaming.jobs import failure_signals

    at = datetime(2024, 1, 5, 4)
    schema = "ts timestamp, host string, account string, ordinal long, us long, failed boolean"
    rows = lambda *seconds: [(at.replace(second=s), "h", "a", o, int(at.replace(second=s, tzinfo=timezone.utc).timestamp()) * 1_000_000, True) for o, s in seconds]
    got = None
    for k, part in enumerate((rows((1, 10), (2, 20)), rows((3, 5)), rows((4, 20), (5, 21)))):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/in")
        stream = spark.readStream.schema(schema).parquet(f"file://{tmp_path}/in")
        got = R._drained(failure_signals(stream, "1 hour"), "late", f"file://{tmp_path}/out")
    assert {r.ordinal: r.recent_auth_failures for r in got.collect()} == {1: 1, 2: 2, 3: 1, 4: 4, 5: 5}


def test_all_rules_fire(spark, sf):
    from sentrylake.operators.ladders import RULES

    assert {r.technique_id for r in R.technique_probes(spark, sf).select("technique_id").distinct().collect()} == {t for t, _ in RULES} - {"T1110"}


def test_reports(spark, sf, tmp_path):
    import json

    from sentrylake.operators import evaluate

    text = report.as_text(R.alerts(spark, sf))
    assert "risk_score" in text and "#" in text and "actionable" in text and "T1548.003" in text
    got = evaluate.save_summary(R.judged(spark, sf), f"file://{tmp_path}")
    assert json.loads((tmp_path / "evaluation.json").read_text()) == got and set(got["metrics"]) >= {"precision", "recall", "f1", "fpr"} and len(got["scores"]) == 2


def test_filters_reach_the_scan(spark, sf):
    q = A.AlertQuery(severities=("high",), least_risk=60, anomalies_only=True)
    plan = q.run(R.alerts(spark, sf)).select("alert_id")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters" in plan and "EqualTo(severity,high)" in plan.split("PushedFilters")[1] and "summary" not in plan.split("ReadSchema")[1]


def test_compact_numbers(spark):
    from pyspark.sql import functions as F

    rows = spark.createDataFrame([(999,), (1234,), (2_500_000,), (1000,)], "n long").select(A.compact(F.col("n")).alias("s")).collect()
    assert [r.s for r in rows] == ["999", "1.2k", "2.5M", "1k"]
