import numpy as np
from pyspark.sql import functions as F

from sentrylake.operators import iforest
from sentrylake.operators.ladders import FEATURE_NAMES
from sentrylake.plans import registry as R


def walked(model, x):
    """Scores node by node."""
    c = lambda n: 0.0 if n < 2 else 1.0 if n == 2 else 2 * (np.log(n - 1) + 0.5772156649015329) - 2 * (n - 1) / n
    z, total = (x - model["mean"]) / model["scale"], np.zeros(len(x))
    trees = [t.set_index("node")[["feature", "cut", "left", "right", "size"]].to_numpy() for _, t in model["nodes"].groupby("tree")]
    for nodes in trees:
        for i, v in enumerate(z):
            at = depth = 0
            while nodes[at][0] >= 0:
                f, cut, left, right, _ = nodes[at]
                at, depth = int(left if v[int(f)] <= cut else right), depth + 1
            total[i] += depth + c(nodes[at][4])
    return -(2 ** (-total / len(trees) / c(model["size"]))) - model["offset"]


def test_query_by_definition(spark, sf):
    """iforest_scores: path lengths node by node, percentiles by sorting, labels and confidences from these."""
    rows = R.featured(spark, sf)
    data = rows.select("ordinal", *FEATURE_NAMES).toPandas()
    raw = walked(iforest.fit(rows, FEATURE_NAMES), data[FEATURE_NAMES].to_numpy(float))
    rounded = np.round(raw, 9)
    sketch = np.percentile(rounded, np.linspace(0, 100, 1001))
    got = {r.ordinal: r for r in R.iforest_scores(spark, sf).collect()}
    assert len(got) == len(data)
    for i, score in zip(data["ordinal"], raw, strict=True):
        r = got[i]
        assert abs(r.raw_score - score) < 1e-9
        below, upto = (1 - np.searchsorted(sketch, score + e, "right") / 1001 for e in (2e-9, -2e-9))
        assert below - 1e-4 <= r.anomaly_score <= upto + 1e-4
        assert r.prediction == (-1 if r.anomaly_score >= 0.98 else 1) or abs(r.anomaly_score - 0.98) < 2e-3
        assert abs(r.confidence - 1 / (1 + np.exp(2 * score / rounded.std()))) < 1e-3


def test_samples_by_definition(spark):
    """Each tree is that of the rows with the least hashes of its own, whatever the partitions; a pool of fewer rows."""
    rng = np.random.default_rng(4)
    x = rng.normal(0, 1, (900, 2))
    rows = spark.createDataFrame([(i, *map(float, v)) for i, v in enumerate(x)], "ordinal long, a double, b double")
    for pool, sample in ((10_000, 64), (300, 64), (10_000, 2000)):
        models = [iforest.fit(rows.repartition(k), ["a", "b"], trees=12, sample=sample, pool=pool) for k in (1, 7)]
        assert models[0]["nodes"].equals(models[1]["nodes"])
        hashes = rows.select("ordinal", iforest.share(42, "ordinal").alias("p"), *(iforest.share(42, "ordinal", F.lit(t)).alias(f"t{t}") for t in range(12))).toPandas()
        mine = hashes[hashes["p"] < pool / 900]
        assert models[0]["size"] == min(sample, len(mine)) and (pool > 900 or 200 < len(mine) < 400)
        for t in range(12):
            pick = mine.sort_values(f"t{t}")["ordinal"].to_numpy()[:sample]
            z = (x[pick] - models[0]["mean"]) / models[0]["scale"]
            want = iforest.build(z, np.random.default_rng([42, t]))
            nodes = models[0]["nodes"]
            assert np.allclose(nodes[nodes["tree"] == t].drop(columns="tree").to_numpy(float), np.array(want, float))


def test_forest_of_no_rows(spark):
    none = spark.createDataFrame([], "ordinal long, a double")
    model = iforest.fit(none, ["a"], trees=3)
    assert model["size"] == 0 and iforest.with_raw_score(none, model).count() == 0
