import hashlib

import numpy as np

from sentrylake.llm import fingerprints as fp
from sentrylake.llm.queries import op4_fingerprints

from . import cases


def signature(t):
    return fp.sampled([fp.terms(t)])[0]


def test_collision_rate_is_generalised_jaccard():
    rng = np.random.default_rng(3)
    error = []
    for _ in range(40):
        keys = rng.integers(1, 1 << 62, 120).astype(np.uint64)
        a, b = (np.where(rng.random(120) < 0.8, rng.integers(1, 6, 120), 0) for _ in range(2))
        b = np.where(rng.random(120) < 0.6, a, b)
        order = np.argsort(keys)
        sets = [(keys[order][w[order] > 0], w[order][w[order] > 0]) for w in (a, b)]
        x, y = fp.sampled(sets)
        error.append(np.minimum(a, b).sum() / np.maximum(a, b).sum() - (x == y).mean())
    assert abs(np.mean(error)) < 0.03 and np.std(error) < 0.1


def test_joint_and_single_evaluation_agree():
    a, b = (fp.terms(cases.words(300, s, 50)) for s in (1, 2))
    both = fp.sampled([a, b], chunk=37)
    assert (both[0] == fp.sampled([a])[0]).all() and (both[1] == fp.sampled([b])[0]).all()


def expected(docs):
    docs = sorted(docs, key=lambda d: (d[0] is not None, d[0] or 0, d[1] or ""))
    texts = [t or "" for _, t in docs]
    has = lambda t: bool(t.encode().split())
    for k, (i, _) in enumerate(docs):
        t, after = texts[k], texts[(k + 1) % len(docs)]
        n = len(t) // 4
        edited = t[: len(t) - n] + after[:n]
        s, e, x = map(signature, (t, edited, after))
        yield (i, len(t), hashlib.sha256(edited.encode()).hexdigest(), fp.written(s), fp.written(e), fp.likeness(s, e, has(t), has(edited)), fp.likeness(s, x, has(t), has(after)))


def test_against_plain_computation(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = sorted(map(tuple, op4_fingerprints(spark, sf).collect()))
    assert got == sorted(expected([(d.doc_id, d.text) for d in docs.collect()]))
    near = [g[5] for g in got if g[1] > 200]
    assert np.mean(near) > 0.5 and np.mean([g[6] for g in got]) < 0.1


def test_awkward_rows(spark):
    key = lambda r: tuple("" if v is None else str(v) for v in r)
    got = sorted((tuple(r) for r in fp.fingerprints(cases.frame(spark)).collect()), key=key)
    assert got == sorted(expected([(r[0], r[1]) for r in cases.rows()]), key=key)
    assert fp.fingerprints(cases.empty(spark)).count() == 0
    one = spark.createDataFrame([(5, "a b c d e f g h")], "doc_id long, text string")
    assert [tuple(r) for r in fp.fingerprints(one).collect()] == list(expected([(5, "a b c d e f g h")]))
