import gzip
import hashlib
import io
import random

import pytest
from pyarrow import fs
from pyspark.sql import functions as F

from sentrylake.llm import warc
from sentrylake.llm._shared import scratch
from sentrylake.llm.queries import op5_warc


def expected(rows):
    out, first = [], {}
    for i, _, h in rows:
        p = (h or "").encode()
        if len(p) >= 100 and i is not None:
            first[p] = min(i, first.get(p, i))
    for i, _, h in rows:
        p = (h or "").encode()
        f = first.get(p)
        revisit = f is not None and i != f
        out.append((i, len(p), hashlib.sha256(p).hexdigest(), "revisit" if revisit else "response", f if revisit else None))
    return sorted(out, key=str)


def test_round_trip_with_copies_and_awkward_rows(spark):
    rng = random.Random(2)
    text = lambda n: "".join(rng.choice("abc <>é中\n") for _ in range(n))
    shared, short = text(400), text(60)
    rows = [(i, f"http://x/{i}", text(rng.randint(0, 3000))) for i in range(60)]
    rows += [(100 + i, None, shared) for i in range(40)] + [(200 + i, "http://y/a b\r\nX: 1", short) for i in range(5)]
    rows += [(300, "u", None), (301, "u", ""), (None, "u", shared), (None, None, None), (100, "u", shared), (302, "u", text(300_000)), (303, "u", "WARC/1.1\r\n\r\n" * 20)]
    pages = spark.createDataFrame([(*r, 1, "z") for r in rows], "page_id long, url string, html string, digest int, first string").repartition(5)
    assert sorted(map(tuple, warc.round_trip(spark, pages).collect()), key=str) == expected(rows)
    assert warc.round_trip(spark, pages.limit(0)).count() == 0


def test_query(spark, sf):
    pages = [(p.page_id, p.url, p.html) for p in spark.read.parquet(f"{sf}/pages.parquet").collect()]
    assert sorted(map(tuple, op5_warc(spark, sf).collect()), key=str) == expected(pages)


def test_any_split_size_reads_each_record_once(spark):
    pages = spark.createDataFrame([(i, "u", f"{i} " * 500) for i in range(50)], "page_id long, url string, html string").coalesce(1)
    folder = scratch(spark, "warc-test")
    files = [tuple(r) for r in warc.write_archives(pages, folder).collect()]
    path, size, records = files[0]
    assert records == 50
    raw = fs.FileSystem.from_uri(folder)[0].open_input_file(path).read()
    assert gzip.decompress(raw).count(b"WARC/1.1\r\n") == 50
    for step in (1, 7, 100, 1000, size, size + 5):
        got = []
        for start in range(0, size, step):
            got += [warc.parsed(m)[0] for m in warc.Members(fs.FileSystem.from_uri(folder)[0].open_input_file(path), start, min(start + step, size))]
        assert sorted(got) == list(range(50))


def test_ranges_are_read_in_many_tasks(spark):
    rng = random.Random(8)
    pages = spark.createDataFrame([(i, "u", "".join(rng.choices("abcdefgh <>", k=3000))) for i in range(300)], "page_id long, url string, html string").coalesce(2)
    folder = scratch(spark, "warc-test")
    files = spark.createDataFrame([tuple(r) for r in warc.write_archives(pages, folder).collect()], "path string, bytes long, records long")
    split = 16_384
    tasks = warc.tasks_of(files, split)
    rows = warc.read_archives(files, folder, split).withColumn("task", F.spark_partition_id()).collect()
    assert tasks > 20 and sorted(r.page_id for r in rows) == list(range(300)) and len({r.task for r in rows}) > tasks / 2
    at = lambda n: warc.tasks_of(spark.createDataFrame([("x", n * warc.SPLIT, 1)], "path string, bytes long, records long"))
    assert at(100) == 100 and at(warc.ALONE + 1600) == warc.ALONE + 100


def test_short_payloads_do_not_meet(spark):
    rows = warc.with_records(spark.createDataFrame([(i, "u", "" if i % 2 else "x" * 200) for i in range(50)], "page_id long, url string, html string"))
    assert all(r.first is None or r.page_id % 2 == 0 for r in rows.collect()) and rows.where("revisit").count() == 24


def test_false_magic_is_no_member_and_damage_is_seen():
    member = warc.record(1, "u", b"hello" * 50, hashlib.sha256(b"hello" * 50).hexdigest(), None, False)

    class Source(io.BytesIO):
        def size(self):
            return len(self.getvalue())

    junk = b"\x1f\x8b\x08\x00garbage" + gzip.compress(b"not a record") + member + b"\x1f\x8b\x08"
    assert [warc.parsed(m)[0] for m in warc.Members(Source(junk), 0, len(junk))] == [1]
    with pytest.raises(ValueError, match="damaged"):
        warc.parsed(gzip.decompress(member).replace(b"hellohello", b"hellOhello", 1))
