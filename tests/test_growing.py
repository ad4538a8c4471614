import random
from collections import Counter

import numpy as np

from sentrylake.operators import baseline, calibrate
from sentrylake.operators.growing import Profile
from sentrylake.operators.ladders import FEATURE_NAMES
from sentrylake.operators import iforest
from sentrylake.plans import detect
from sentrylake.plans import registry as R
from sentrylake.plans.session import scratch


def test_bounded_profile_by_definition(spark):
    """Kept counts are exact or off by at most their error; what isn't kept was never seen more often than the bound;
    a key that comes again after it went; ties by first sighting; null keys; repeated batches."""
    rng = random.Random(3)
    profile, true, seen = Profile(spark, scratch(spark, "profile-test"), most=12), {"a": Counter(), "b": Counter()}, 0
    assert profile.keys().count() == 0 and profile.sums().count() == 0
    for k in range(6):
        batch = []
        for kind, size in (("a", 60), ("b", 8)):
            got = Counter(min(int(rng.paretovariate(0.8)), size) + (20 * k if rng.random() < 0.3 and kind == "a" else 0) for _ in range(300))
            for key, n in got.items():
                batch.append((kind, f"k{key}", n, seen))
                true[kind][f"k{key}"] += n
                seen += 1
        frame = spark.createDataFrame(batch, "kind string, key string, n long, first_seen long")
        assert profile.add_counts(frame, k) and not profile.add_counts(frame, k)
        sums = {r.kind: r for r in profile.sums().collect()}
        kept = {(r.kind, r.key): r for r in profile.keys().collect()}
        for kind in true:
            mine = {key: r for (c, key), r in kept.items() if c == kind}
            assert len(mine) == min(12, len(true[kind])) and sums[kind].total == 300 * (k + 1)
            assert abs(sums[kind].cardinality - len(true[kind])) <= 0.03 * len(true[kind])
            for key, n in true[kind].items():
                if key in mine:
                    assert mine[key].n <= n <= mine[key].n + mine[key].error
                else:
                    assert n <= sums[kind].bound
            assert all(r.error == 0 for r in mine.values()) or kind == "a"
    assert sums["b"].bound == 0 < sums["a"].bound and any(r.error for r in kept.values())
    assert len([n for n in profile.folder.names() if n.startswith("v-")]) == 2  # and what readers may still use


def test_batches_without_events(spark):
    profile = Profile(spark, scratch(spark, "profile-test"))
    none = spark.createDataFrame([], "kind string, key string, n long, first_seen long")
    assert profile.add_counts(none, 0) and profile.keys().count() == 0
    assert profile.add_counts(spark.createDataFrame([("a", "x", 2, 7)], none.schema), 1)
    assert profile.add_counts(none, 2) and [tuple(r) for r in profile.keys().collect()] == [("a", "x", 2, 0, 7)]


def test_sketch_keeps_its_error(spark):
    """Merged over uneven batches, one of them twice, one without scores: every point within the stated rank error."""
    rng = np.random.default_rng(8)
    x = np.round(np.concatenate([rng.normal(0, 1, 60_000), np.repeat(0.25, 9000), rng.pareto(1, 31_000)]), 9)
    rng.shuffle(x)
    path = scratch(spark, "states-test")
    for k, part in enumerate([*np.split(x, [10, 500, 40_000]), x[:0], x[10:500]]):
        rows = spark.createDataFrame([(float(v),) for v in part] + [(None,)], "s double")
        calibrate.add_batch(rows, "s", path, min(k, 4) if k < 5 else 1)
    cal = calibrate.from_states(calibrate.read_states(spark, path))
    x.sort()
    assert cal.n == len(x) and abs(cal.mean - x.mean()) < 1e-6 and abs(cal.std / x.std() - 1) < 1e-6
    for i, q in enumerate(cal.quantiles):
        low, high = np.searchsorted(x, q, "left") / len(x), np.searchsorted(x, q, "right") / len(x)
        assert low - calibrate.SKETCH_ERROR <= i / 1000 <= high + calibrate.SKETCH_ERROR
    assert calibrate.from_states(spark.createDataFrame([], calibrate.STATE)).quantiles == ()


def test_exact_quantiles_with_few_scores(spark):
    for x in ([3.0], [3.0, 3.0], [1.0, 2.0], [5.0, 1.0, 9.0]):
        cal = calibrate.fit(spark.createDataFrame([(v,) for v in x], "s double"), "s")
        assert np.allclose(cal.quantiles, np.percentile(x, np.linspace(0, 100, 1001)), atol=1e-9)


def test_model_that_grows(spark, sf):
    """After three batches the profile is that of all events, and rarities by it are those of the whole profile."""
    events = R.contextual(spark, sf)
    forest = iforest.fit(R.featured(spark, sf), FEATURE_NAMES, trees=20, sample=256)
    path = scratch(spark, "model-test")
    for k in range(3):
        model = detect.learn(events.where(f"pmod(ordinal div 8, 3) = {k}"), forest, path, k)
    whole = baseline.counts(events)
    assert sorted(map(tuple, model["profile"].select("kind", "key", "n", "first_seen").collect())) == sorted(map(tuple, whole.collect()))
    exact = whole.groupBy("kind").count().collect()
    assert {r.kind: r.cardinality for r in model["sums"].collect()} == {r["kind"]: r["count"] for r in exact}
    assert model["calibration"].n == events.count()
    view = lambda rows: sorted((r.ordinal, round(r.rarity_exe, 9), round(r.rarity_user_host, 9)) for r in rows.select("ordinal", "rarity_exe", "rarity_user_host").collect())
    assert view(detect.featured(events, model["profile"], model["sums"])) == view(detect.featured(events, whole))
