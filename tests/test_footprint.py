"""What queries leave on disk and what they read and shuffle: the parts that grow with the events."""

import os

from pyspark.sql import functions as F

from sentrylake.operators.overview import tagged
from sentrylake.operators.text_index import TextIndex
from sentrylake.plans import registry as R
from sentrylake.plans.session import scratch


def plan(rows):
    return rows._jdf.queryExecution().executedPlan().toString()


def test_alerts_keep_no_table_of_their_way(spark, sf, tmp_path):
    os.link(f"{sf}/events.parquet", f"{tmp_path}/events.parquet") if os.stat(sf).st_dev == os.stat(tmp_path).st_dev else (tmp_path / "events.parquet").write_bytes(open(f"{sf}/events.parquet", "rb").read())
    base = spark.conf.get("spark.checkpoint.dir").removeprefix("file://")
    before = set(os.listdir(base))
    rows = R.alerts(spark, str(tmp_path))
    assert {n.rpartition("-")[0] for n in set(os.listdir(base)) - before if "-" in n} == {"contextual", "profile", "alerts"}
    assert rows.count() == 1000 and R.alerts(spark, str(tmp_path)) is rows


def test_an_id_has_its_postings_in_one_file(spark):
    index = TextIndex(spark, scratch(spark, "index-files"))
    rows = spark.range(300).select(F.concat(F.lit("i"), "id").alias("alert_id"), F.concat_ws(" ", F.lit("one two"), F.col("id") % 7, F.col("id")).alias("title"))
    index.add(rows, 0, ("title",))
    files = spark.read.parquet(f"{index.path}/segment=000000000/postings").select("id", F.input_file_name().alias("f")).groupBy("id").agg(F.count_distinct("f").alias("n"))
    assert files.where("n <> 1").count() == 0 and files.count() == 300
    index.add(rows, 1, ("title",))
    index.merge()  # nothing of the first is left: it goes, the second stays as it is
    assert index.segments() == ["segment=000000001"] and index.search("one").count() == 300


def test_latest_sorts_the_columns_asked_for(spark, sf):
    assert "summary" not in plan(R.alert_latest_versions(spark, sf))


def test_tags_are_counted_in_their_row(spark, sf):
    assert "Window" not in plan(tagged(R.alerts(spark, sf).withColumn("event_day", F.lit("a"))))
