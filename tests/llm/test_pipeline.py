import corpus_pipeline
from sentrylake.llm import jaccard_join, packing, quality_rules

from . import cases
from .test_corpus import classes, dedup
from .test_tokens import check_packing


def test_stages_against_brute_force(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    kept = [docs]
    for _, stage in corpus_pipeline.STAGES:
        kept.append(stage(spark, kept[-1], sf).cache())
    rows = [[(r.doc_id, r.text) for r in d.collect()] for d in kept[:5]]
    assert all(d.columns == columns for d in kept[:5])
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    ids = [{i for i, _ in r} for r in rows]
    good = {i for i, q in labels.items() if q == 1}
    assert len(good - ids[1]) <= 0.02 * len(good) and len({i for i, q in labels.items() if q == 0} & ids[1]) <= 3
    passing = {r.doc_id for r in quality_rules.quality_rules(kept[1]).where("kept").collect()}
    assert ids[2] == passing
    assert dict(rows[3]) == {i: t for i, (t, _, _) in dedup(sorted(rows[2]), 50).items()}
    assert ids[4] == {c[1] for c in classes(rows[3])}
    check_packing(kept[5].collect(), rows[4])
    assert all(r.n_chars == len(r.text) for r in kept[3].collect())
    assert corpus_pipeline.ORACLE_SQL is None and jaccard_join.THRESHOLD == 0.8 and packing.CAPACITY == 2048


def test_stages_on_awkward_rows(spark, tmp_path):
    spark.createDataFrame([(i, i % 2, 0) for i in range(20)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    for docs in (cases.frame(spark), cases.empty(spark)):
        for _, stage in corpus_pipeline.STAGES:
            assert stage(spark, docs, f"file://{tmp_path}").count() <= 4 * docs.count()
