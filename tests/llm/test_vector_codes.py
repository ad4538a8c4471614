import hashlib
import math
import random

import numpy as np
import pytest

from sentrylake.llm import vector_codes as vc
from sentrylake.llm.queries import op12_vector_codes


def plain(rows, parts=16, entries=64, rounds=2):
    """The same by definition, in Python's integers: (vec_id, code, error, label_error, digest) of (vec_id, vector, label)."""
    rows = [(i, [math.floor(256 * x) for x in v], label) for i, v, label in rows if v and all(x is not None and math.isfinite(x) for x in v)]
    w = len(rows[0][1]) // parts
    cut = lambda v: [v[p * w : (p + 1) * w] for p in range(parts)]
    books = [list(b) for b in zip(*(cut(v) for _, v, _ in sorted(rows, key=lambda r: r[0])[:entries]), strict=True)]
    dist = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    for k in range(rounds + 1):
        got = [[min((dist(x, c), e) for e, c in enumerate(book)) for x, book in zip(cut(v), books, strict=True)] for _, v, _ in rows]
        if k < rounds:
            for p, book in enumerate(books):
                for e in range(len(book)):
                    mine = [cut(v)[p] for (_, v, _), g in zip(rows, got, strict=True) if g[p][1] == e]
                    if mine:
                        book[e] = [sum(c) // len(mine) for c in zip(*mine, strict=True)]
    digest = hashlib.sha256(",".join(str(x) for book in books for c in book for x in c).encode()).hexdigest()
    errors = [sum(d for d, _ in g) for g in got]
    by = {}
    for (_, _, label), e in zip(rows, errors, strict=True):
        by[label] = by.get(label, 0) + e
    return sorted(((i, "".join(f"{e:02x}" for _, e in g), e, by[label], digest) for (i, _, label), g, e in zip(rows, got, errors, strict=True)), key=str)


def got(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_query(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding", "label").collect()]
    assert got(op12_vector_codes(spark, sf)) == plain(rows)


def test_awkward_rows(spark):
    """Null and broken vectors, null ids and labels, ties and repeats, vectors of another length, huge components."""
    rng = random.Random(3)
    rows = [(i, [rng.choice((-0.01, 0.0, 0.004, 0.5)) for _ in range(32)], rng.choice((None, 1, 2))) for i in range(90)]
    rows += [(5, rows[5][1], 1)] + [(200 + i, [0.25] * 32, None) for i in range(30)] + [(300, [3000.0, -3000.0] * 16, 2)]
    bad = [(-5, None, 1), (-4, [], 1), (-3, [float("nan")] * 32, 1), (-2, [float("inf")] + [0.0] * 31, 1), (-1, [None] + [0.0] * 31, 1), (999, [0.5] * 16, 1), (998, [0.5] * 30, 1)]
    frame = spark.createDataFrame([(i, v, label, "x", 1, "y", 2) for i, v, label in rows + bad], "vec_id long, embedding array<float>, label int, code string, error int, key string, ids int").repartition(3)
    assert got(vc.vector_codes(frame)) == plain(rows)
    assert vc.vector_codes(frame.limit(0)).count() == 0
    few = spark.createDataFrame([(2, [0.5] * 16, "a"), (1, [0.1] * 16, None), (None, [0.2] * 16, "a")], "vec_id long, embedding array<double>, label string")
    assert [r.vec_id for r in vc.vector_codes(few).orderBy("vec_id").collect()] == [None, 1, 2]
    huge = spark.createDataFrame([(1, [3e38] * 16, 0), (2, [-3e38] * 16, 0)], "vec_id long, embedding array<float>, label int")
    assert {r.error for r in vc.vector_codes(huge).collect()} == {0}


@pytest.mark.parametrize("block", [7, 64, 8192])
def test_rounds_and_blocks(spark, block):
    """Many rounds, whatever the blocks: the codes are those of the definition."""
    rng = np.random.default_rng(block)
    rows = [(i, rng.choice(rng.normal(size=4), 8).round(2).tolist(), 0) for i in range(300)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(4)
    codes, books = vc.compress(frame, parts=4, entries=9, rounds=6, block=block)
    want = plain(rows, 4, 9, 6)
    assert vc.codebooks_sha256(books) == want[0][-1] and got(codes.select("vec_id", "code", "error")) == [w[:3] for w in want]


def test_only_violated_parts_are_scanned():
    """Well separated groups: entries move, few parts are popped, and none is wrong."""
    rng = np.random.default_rng(1)
    centres = rng.integers(-4000, 4000, (2, 8, 4))
    points = np.stack([centres[p, rng.integers(0, 8, 4000)] + rng.integers(-40, 40, (4000, 4)) for p in range(2)], 1).astype(np.int32)
    books = points[:64].transpose(1, 0, 2).astype(np.int64)
    block, drift, full = vc.Block.assigned(points, books), np.zeros(books.shape[:2]), 0
    for _ in range(8):
        after = books.copy()
        for p in range(2):
            for e in range(64):
                if (mine := points[block.owners[:, p] == e, p]).size:
                    after[p, e] = mine.astype(np.int64).sum(0) // len(mine)
        drift, books, full = drift + vc.drifts(books, after), after, full + points.shape[0] * 2
        block = vc.Block.unpacked(block.packed(), books) if full % 3 else block
        changes = vc.Changes(books.shape)
        block.reassign(books, drift, changes)
        for p in range(2):
            assert (block.owners[:, p] == vc.distances(points[:, p], books[p]).argmin(1)).all()
        members = sum(len(h) if isinstance(h, list) else len(h[0]) for row in block.heaps for h in row)
        assert members == 8000 and not changes.counts.sum()
    assert 0 < block.scanned < full


def test_distances_are_exact():
    big = np.array([[vc.BOUND, -vc.BOUND], [vc.BOUND - 1, 0]], np.int32)
    assert vc.distances(big, -big.astype(np.int64)).tolist() == [[2 * (2 * vc.BOUND) ** 2, (2 * vc.BOUND - 1) ** 2 + vc.BOUND**2], [(2 * vc.BOUND - 1) ** 2 + vc.BOUND**2, (2 * vc.BOUND - 2) ** 2]]
