import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from sentrylake.operators import alert_query as A
from sentrylake.operators.alerts import lookup, upsert
from sentrylake.operators.text_index import B, K1, TextIndex
from sentrylake.plans import registry as R
from sentrylake.plans.session import scratch

WORD = re.compile(r"\w+(?:[.']\w+)*")


def best(rows, query):
    """Scores by definition: {id: (score, field)} of {id: {field: text}}."""
    words = {(i, f): WORD.findall((t or "").lower()) for i, fields in rows.items() for f, t in fields.items()}
    words = {k: w for k, w in words.items() if w}
    out = {}
    for f in {f for _, f in words}:
        mine = {i: Counter(w) for (i, g), w in words.items() if g == f}
        mean = sum(sum(c.values()) for c in mine.values()) / len(mine)
        for q in set(WORD.findall(query.lower())):
            n = sum(q in c for c in mine.values())
            for i, c in mine.items():
                if q in c:
                    weight = math.log(1 + (len(mine) - n + 0.5) / (n + 0.5)) * c[q] / (c[q] + K1 * (1 - B + B * sum(c.values()) / mean))
                    out.setdefault(i, Counter())[f] += weight
    return {i: max((s, f) for f, s in by.items()) for i, by in out.items()}


def test_index_by_definition(spark):
    """Segments with rows that come again, null and empty texts, null ids, an empty batch, a repeated batch, merging."""
    rng = random.Random(6)
    text = lambda: rng.choice((None, "", " ".join(rng.choice(("sudo", "nmap", "Sudo", "it's", "v1.2", "über", "a_b", "x")) for _ in range(rng.randint(1, 12)))))
    index, now = TextIndex(spark, scratch(spark, "index-test")), {}
    schema = "alert_id string, title string, log struct<a:string>"
    fields = ("title", "log.a")
    assert index.search("sudo").count() == 0
    for k in range(4):
        ids = [f"i{rng.randint(0, 60)}" for _ in range(30)] if k != 2 else []
        batch = {i: {"title": text(), "log.a": text()} for i in ids}
        now |= batch
        rows = [(i, f["title"], (f["log.a"],)) for i, f in batch.items()] + ([(None, "sudo", ("nmap",))] if k == 1 else [])
        for _ in range(2):
            index.add(spark.createDataFrame(rows, schema).repartition(3), k, fields)
    for merged in (False, True):
        if merged:
            index.merge()
            assert len(index.segments()) == 1
        for query in ("SUDO nmap", "it's über", "v1.2", "nowhere", "", "x x x a_b"):
            got = {r.id: (round(r.score, 9), r.field) for r in index.search(query).collect()}
            want = best(now, query)
            assert got.keys() == want.keys()
            if merged:  # before, a field's rows count with each segment
                assert got == {i: (round(s, 9), f) for i, (s, f) in want.items()}
    top = index.top("sudo nmap", 5).collect()
    assert len(top) == 5 and [r.score for r in top] == sorted((r.score for r in index.search("sudo nmap").collect()), reverse=True)[:5]
    plan = index.postings(["sudo"])._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters" in plan and "EqualTo(term,sudo)" in plan or "In(term" in plan


@pytest.mark.parametrize("sort,descending", [("risk_score", True), ("event_time", False), ("detected_at", True)])
def test_pages_by_token_are_the_whole_order(spark, sf, sort, descending):
    """Missing values and ties; every hit once, in order; hits that come before the page move nothing."""
    rows = R.alerts(spark, sf).where("ordinal % 5 = 0")
    for c in ("risk_score", "scored_at", "event_ts"):
        rows = rows.withColumn(c, F.when(F.xxhash64("alert_id", F.lit(c)) % 5 != 0, F.col(c)))
    rows = rows.withColumn("risk_score", F.floor(F.col("risk_score") / 20).cast("int")).cache()
    q = A.AlertQuery(sort=sort, descending=descending, rows=40)
    want = [r.alert_id for r in A.AlertQuery(sort=sort, descending=descending, rows=10**6).ordered(rows).collect()]
    got, token = [], None
    while True:
        page, token = q.page_after(rows if len(got) < 80 else rows.unionByName(rows.limit(0)), token)
        got += [r.alert_id for r in page]
        if token is None:
            break
    assert got == want and len(want) > 150
    with pytest.raises(A.BadQuery):
        q.page_after(rows, "no token")
    with pytest.raises(A.BadQuery):
        A.AlertQuery(sort="risk_score", descending=False).page_after(rows, A.AlertQuery().token(rows.first()))


def test_lookup_reads_one_file(spark, sf, tmp_path):
    path, rows = f"file://{tmp_path}/alerts", R.alerts(spark, sf)
    assert lookup(spark, path, "x") is None
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # several files a day, as large days have
    try:
        upsert(path, rows)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    wanted = rows.where("ordinal = 328").first().alert_id
    found = lookup(spark, path, wanted)
    assert [r.alert_id for r in found.collect()] == [wanted]
    days, files = {f.split("event_day=")[1][:10] for f in found.inputFiles()}, spark.read.parquet(*found.inputFiles()).select(F.input_file_name().alias("f"), "alert_id")
    holding = files.groupBy("f").agg(F.min("alert_id").alias("low"), F.max("alert_id").alias("high")).collect()
    assert len(days) == 1 and len(holding) > 1 and sum(r.low <= wanted <= r.high for r in holding) == 1
    assert lookup(spark, path, wanted + "x").count() == 0 and lookup(spark, path, "host:2031-01-01T00:00:00+00:00:1:SYSCALL").count() == 0
