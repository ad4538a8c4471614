import pytest
from pyspark.sql import functions as F

from sentrylake.config import BANDS, BadSettings, Settings, bands
from sentrylake.operators import alert_query as A
from sentrylake.operators import calibrate
from sentrylake.operators.alerts import read_table, upsert
from sentrylake.operators.overview import Overview
from sentrylake.plans import detect
from sentrylake.plans import registry as R


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_overview_counts_only_changed_days(spark, sf, tmp_path):
    """Alerts without a time, without techniques, that change their severity; a table that isn't there yet."""
    path, alerts = f"file://{tmp_path}/alerts", R.alerts(spark, sf).withColumn("event_ts", F.when(F.col("ordinal") % 56 != 0, F.col("event_ts"))).cache()
    overview = Overview(spark, path, f"file://{tmp_path}/overview")
    assert overview.refresh() == [] and overview.timeline().count() == 0 and overview.techniques().count() == 0
    days = sorted(r[0] for r in alerts.select(F.coalesce(F.to_date("event_ts").cast("string"), F.lit("none"))).distinct().collect())
    upsert(path, alerts)
    assert overview.refresh() == days and overview.refresh() == [] and len(days) == 3
    upsert(path, alerts.where(F.to_date("event_ts") == days[0]).withColumn("severity", F.lit("high")).withColumn("mitre", F.slice("mitre", 1, 1)))
    assert overview.refresh() == days[:1]
    now = read_table(spark, path)
    for interval in ("5m", "1h", "1d"):
        assert rows(overview.timeline(interval)) == rows(A.anomaly_timeline(now, interval))
    whole = A.techniques(now)
    assert rows(overview.techniques().select(whole.columns)) == rows(whole)
    with pytest.raises(A.BadQuery):
        overview.timeline("2h")
    with pytest.raises(A.BadQuery):
        overview.techniques(0)


def test_bands():
    assert bands() == BANDS and bands(high=70)[1] == ("high", 70)
    for wrong in ({"high": 90}, {"low": 0}, {"medium": 20}, {"critical": 101}, {"low": 1.5}, {"other": 3}):
        with pytest.raises(BadSettings):
            bands(**wrong)
    got = Settings.read({"SENTRYLAKE_BANDS": '{"low": 5}', "SENTRYLAKE_THRESHOLD": "0.5"})
    assert got.bands[-1] == ("low", 5) and got.threshold == 0.5 and not got.problems
    for text in ("[1]", "{", '{"low": 99}'):
        got = Settings.read({"SENTRYLAKE_BANDS": text})
        assert got.bands == BANDS and "SENTRYLAKE_BANDS" in got.problems[0]


def test_settings_reach_the_alerts(spark, sf):
    """Weights, hosts, bands and threshold of the settings; hosts of a table that has one twice and a null."""
    events = R.featured(spark, sf)
    cal = calibrate.fit(events, "raw_score")
    hosts = spark.createDataFrame([("host-1", 0.2), ("host-1", 0.9), (None, 1.0), ("host-2", None)], "host string, criticality double")
    got = detect.assessed(events, cal, hosts=hosts, bands=bands(low=3, medium=4, high=5, critical=6), threshold=0.5).collect()
    assert {(r.host, r.criticality) for r in got} == {(f"host-{k}", 0.9 if k == 1 else 0.5) for k in range(5)}
    assert all((r.severity == "critical") == (r.risk_score >= 6) for r in got) and 0.3 < sum(r.prediction == -1 for r in got) / len(got) < 0.7
    plain = detect.assessed(events, cal, hosts={"host-1": 0.9}).collect()
    assert {r.ordinal: r.risk_score for r in plain} == {r.ordinal: r.risk_score for r in got}
