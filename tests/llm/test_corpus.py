import math
import random
import re
import tracemalloc
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from sentrylake.llm import _shared as shared
from sentrylake.llm import jaccard_join as jj
from sentrylake.llm import line_dedup as ld
from sentrylake.llm import lm_scoring as lm
from sentrylake.llm._shared import components, in_fold
from sentrylake.llm.queries import op8_jaccard_join, op9_lm_scoring, op10_line_dedup

from . import cases

WORD = re.compile(r"[^\x20\x09-\x0D]+")


# --- language-model scores ---


def base_scores(docs):
    tokens = lambda t: [*WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")), "\n"]
    held = {i: zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2 for i, _ in docs}
    count = Counter(w for i, t in docs if not held[i] for w in tokens(t))
    n, v = sum(count.values()), len(count)
    for i, t in docs:
        w = tokens(t)
        yield i, held[i], len(w), sum(count[x] > 0 for x in w), n, sum(math.log10((count[x] + 1) / (n + v + 1)) for x in w)


def check_base(rows, docs):
    key = lambda r: (str(r[0]), r[2], round(r[5], 4))
    for a, b in zip(sorted(map(tuple, rows), key=key), sorted(base_scores(docs), key=key), strict=True):
        assert a[:5] == b[:5] and math.isclose(a[5], b[5], rel_tol=1e-9) and a[6] < 0


def test_lm_query(spark, sf):
    docs = [(d.doc_id, d.text) for d in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    rows = op9_lm_scoring(spark, sf).collect()
    check_base(rows, docs)
    size = dict((i, len(t.encode()) + 1) for i, t in docs)
    bits = [-r.score / math.log10(2) / size[r.doc_id] for r in rows if r.held_out]
    assert np.average(bits) < 4  # bytes of these languages: under an order-0 model about 4.3
    want = tree_scores([t or "" for _, t in docs], [zlib.crc32(str(i).encode()) % 7 == 2 for i, _ in docs])
    got = {r.doc_id: r.score for r in rows}
    assert np.allclose([got[i] for i, _ in docs], want, rtol=1e-5, atol=1e-3)


def test_lm_awkward_rows(spark):
    check_base(lm.lm_scores(cases.frame(spark), in_fold(7, 2)).collect(), [(r[0], r[1]) for r in cases.rows()])
    assert lm.lm_scores(cases.empty(spark), in_fold(7, 2)).count() == 0


def test_many_batches_parts_and_tasks(spark, monkeypatch):
    monkeypatch.setattr(lm, "PART_ROWS", 3000)
    monkeypatch.setattr(lm, "ASKED_BYTES", 3000)
    monkeypatch.setattr(lm, "BATCH_BYTES", 30_000)
    rows = [(r[0], r[1]) for r in cases.rows() if len(r[1] or "") < 50_000]
    got = lm.lm_scores(spark.createDataFrame(rows, "doc_id long, text string"), in_fold(7, 2)).collect()
    check_base(got, rows)
    want = tree_scores([t or "" for _, t in rows], [zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2 for i, _ in rows])
    assert np.allclose(sorted(r.score for r in got), sorted(want), rtol=1e-5, atol=1e-3)


def test_questions_are_restored():
    for n in (0, 1, 1000):
        keys = np.unique(np.random.default_rng(n).integers(0, 1 << 63, n, dtype=np.uint64))
        assert (lm.restored(lm.squeezed(keys)) == keys).all()


def tree_probability(history, counts, depth):
    """P(byte) of the last byte of `history` by the definition of context-tree weighting, nodes as dicts."""
    def kt(a, b):
        return math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi)

    def zeros_ones(table, prefix):
        a = b = 0
        for byte, n in table.items():
            bits = f"{byte:08b}"
            if bits.startswith(prefix):
                a, b = (a + n, b) if bits[len(prefix)] == "0" else (a, b + n)
        return a, b

    def weighted(node, d, prefix):
        own = kt(*zeros_ones(counts[node], prefix))
        if d == depth:
            return own, 1.0
        kids = [c for c in counts if len(c) == d + 1 and c[1:] == node]
        split = sum(weighted(c, d + 1, prefix)[0] for c in kids)
        both = np.logaddexp(own, split) - math.log(2)
        return both, math.exp(own - math.log(2) - both)

    context, byte = history[:-1], history[-1]
    total = 0.0
    for k in range(8):
        prefix = f"{byte:08b}"[:k]
        p = None
        for d in range(depth, -1, -1):
            node = tuple(context[len(context) - d :])
            if node not in counts:
                continue
            a, b = zeros_ones(counts[node], prefix)
            stay = weighted(node, d, prefix)[1]
            value = (b + 0.5) / (a + b + 1)
            p = value if p is None else stay * value + (1 - stay) * p
        total += math.log10(p if f"{byte:08b}"[k] == "1" else 1 - p)
    return total


def test_tree_equals_the_definition():
    data = b"abracadabra abracadabra bab"
    depth = 2
    counts = defaultdict(Counter)
    for i in range(depth, len(data)):
        for d in range(depth + 1):
            counts[tuple(data[i - d : i])][data[i]] += 1
    nodes, tables = [], []
    for d in range(depth + 1):
        mine = sorted(c for c in counts if len(c) == d)
        number = lambda c: int.from_bytes(bytes(c), "big")
        nodes.append(np.array([number(c) for c in mine], np.uint64))
        tables.append(np.stack([np.bincount(list(counts[c].elements()), minlength=256) for c in mine]).astype(float))
    to, logs = lm.weighted_tree(nodes, tables)
    state = 0
    for i in range(len(data)):
        if i >= depth:
            assert abs(logs[state, data[i]] - tree_probability(data[i - depth : i + 1], counts, depth)) < 1e-4
        state = to[state, data[i]]
    assert np.allclose((10.0 ** logs.astype(float)).sum(1), 1, atol=1e-4)


def test_grams_of_a_batch_take_the_room_of_a_piece():
    rng = np.random.default_rng(11)
    words = [bytes(rng.integers(97, 103, 6).astype(np.uint8)) for _ in range(300)]
    mixed = [b" ".join(words[i] for i in rng.integers(0, 300, 40_000)) for _ in range(14)]
    for texts in (mixed, [b" ".join(mixed)]):  # many texts, and one as long
        key, real = lm.positions(texts)
        want = np.unique(key[real], return_counts=True)
        tracemalloc.start()
        got = lm.grams(texts)
        most = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert (got[0] == want[0]).all() and (got[1] == want[1]).all()
        assert most < 16 * sum(map(len, texts))
    assert [len(x) for x in lm.grams([])] == [0, 0]


def test_scores_of_one_long_text_take_the_room_of_a_piece(monkeypatch):
    rng = np.random.default_rng(12)
    words = [bytes(rng.integers(97, 103, 6).astype(np.uint8)) for _ in range(300)]
    texts = [b" ".join(words[i] for i in rng.integers(0, 300, n)) for n in (560_000, 3, 0, 1, 20)]
    known = lm.distinct(texts)
    log = -rng.random(len(known))
    want = []
    for t in texts:
        key, real = lm.positions([t])
        want.append(log[np.searchsorted(known, key[real])].sum())
    tracemalloc.start()
    got = lm.text_scores(texts, known, log)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert np.allclose(got, want, rtol=1e-12) and most < 16 * sum(map(len, texts))
    for size in (1, 7, 64):  # texts that end at, before and after a piece
        monkeypatch.setattr(lm, "PART_BYTES", size)
        assert np.allclose(lm.text_scores(texts[1:], known, log), want[1:], rtol=1e-12)
    assert not len(lm.text_scores([], known, log))


def test_lanes_score_as_one():
    rng = np.random.default_rng(5)
    texts = [bytes(rng.integers(97, 103, rng.integers(0, 300)).astype(np.uint8)) for _ in range(40)]
    k, n = lm.grams(texts)
    keys = k[np.argsort(k)]
    assert n.sum() == sum(len(t) + 1 for t in texts) and len(keys) == len(set(keys))
    nodes, tables = [], []
    for d in range(lm.DEPTH + 1):
        c = (k >> np.uint64(8)) & np.uint64((1 << 8 * d) - 1)
        node, at = np.unique(c, return_inverse=True)
        table = np.zeros((len(node), 256))
        np.add.at(table, (at, (k & np.uint64(255)).astype(int)), n)
        nodes.append(node)
        tables.append(table)
    to, logs = lm.weighted_tree(nodes, tables)
    want = []
    for t in texts:
        state, total = 0, 0.0
        for b in [lm.PAD] * lm.DEPTH:
            state = to[state, b]
        for b in [*t, lm.STOP]:
            total += float(logs[state, b])
            state = to[state, b]
        want.append(total)
    assert np.allclose(lm.text_logs(texts, to, logs), want, atol=1e-3)


def tree_scores(texts, held):
    """Scores by the tree of all contexts of the training texts, in memory."""
    nodes, tables = [], []
    k, n = lm.grams([lm.lowered(t) for t, h in zip(texts, held, strict=True) if not h])
    for d in range(lm.DEPTH + 1):
        node, at = np.unique((k >> np.uint64(8)) & np.uint64((1 << 8 * d) - 1), return_inverse=True)
        table = np.zeros((len(node), 256))
        np.add.at(table, (at, (k & np.uint64(255)).astype(int)), n)
        nodes.append(node)
        tables.append(table)
    return lm.text_logs([lm.lowered(t) for t in texts], *lm.weighted_tree(nodes, tables))


def test_every_context_is_a_node(spark):
    """Scores equal those of the tree of all contexts, also of the many that precede one byte in 100,000."""
    rng = random.Random(3)
    texts = ["".join(rng.choices("abcdefghijklmnop é", k=rng.randrange(3000))) for _ in range(100)] + ["", "never seen: ÄÖ 123"]
    held = [zlib.crc32(str(i).encode()) % 7 == 2 for i in range(len(texts))]
    want = tree_scores(texts, held)
    got = {r.doc_id: r.score for r in lm.lm_scores(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3), in_fold(7, 2)).collect()}
    assert np.allclose([got[i] for i in range(len(texts))], want, rtol=1e-5, atol=1e-3)


# --- near duplicates ---


def shingles(t):
    w = WORD.findall(t or "")
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def classes(rows):
    sets = defaultdict(list)
    for i, t in rows:
        sets[shingles(t)].append(i)
    kinds, holders = list(sets), defaultdict(list)
    for k, s in enumerate(kinds):
        for x in s:
            holders[x].append(k)
    links, parent = Counter(), list(range(len(kinds)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, s in enumerate(kinds):
        for j, n in Counter(j for x in s for j in holders[x] if j < k).items():
            if 5 * n >= 4 * (len(s) + len(kinds[j]) - n):
                links[k] += 1
                links[j] += 1
                parent[root(k)] = root(j)
    heads = defaultdict(list)
    for k, s in enumerate(kinds):
        heads[root(k)] += sets[s]
    low = lambda ids: min(ids, key=lambda i: (i is not None, i or 0))
    return sorted(((i, low(heads[root(k)]), low(sets[s]), len(sets[s]), links[k]) for k, s in enumerate(kinds) for i in sets[s]), key=str)


def edited(n, edits, seed):
    rng = random.Random(seed)
    base = [f"w{i}" for i in range(120)]
    for k in range(n):
        w = list(base)
        for _ in range(rng.randint(0, edits)):
            w[rng.randrange(len(w))] = f"x{rng.randint(0, 30)}"
        yield k, " ".join(w)


def test_jaccard_query(spark):
    sf = "/root/testdata/sf0.01"
    docs = [(d.doc_id, d.text) for d in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert sorted(map(tuple, op8_jaccard_join(spark, sf).collect()), key=str) == classes(docs)


@pytest.mark.parametrize("block", [512, 40])
def test_large_groups_of_near_copies(spark, monkeypatch, block):
    monkeypatch.setattr(jj, "BLOCK", block)
    monkeypatch.setattr(jj, "LABELS", block)
    rows = [*edited(400, 4, 3), (900, "other words entirely in this one here"), (901, "a b"), (902, "a b"), (903, "a c")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert sorted(map(tuple, jj.jaccard_join(docs).collect()), key=str) == classes(rows)


def test_jaccard_awkward_rows(spark):
    docs = cases.frame(spark)
    assert sorted(map(tuple, jj.jaccard_join(docs).collect()), key=str) == classes([(r[0], r[1]) for r in cases.rows()])
    assert jj.jaccard_join(cases.empty(spark)).count() == 0
    one = jj.one_of_each(docs)
    heads = {str(c[1]) for c in classes([(r[0], r[1]) for r in cases.rows()])}
    assert one.count() == len(heads) + 1  # two classes begin with a null id
    cases.same_extras(docs, one, every=False)


def test_prefixes_are_shortened_until_the_recall():
    d = jj.shallowest(0.8)
    assert jj.recall(0.8, d) >= jj.TARGET > jj.recall(0.8, d + 1)
    at = lambda share, n: np.eye(1, jj.SLOTS + 1, round(share * jj.SLOTS), dtype=int)[0] * n
    close, far = at(0.97, 1000), at(0.81, 1000)
    assert jj.estimated_recall(close, jj.DEEPEST, 0.8) >= jj.TARGET > jj.estimated_recall(far, jj.DEEPEST, 0.8)
    assert jj.estimated_recall(far, d, 0.8) >= jj.TARGET and jj.estimated_recall(at(0.5, 9), 5, 0.8) == 0


def test_levels_meet_each_pair_once(spark):
    """Over all levels and tries: exactly the pairs of nodes that share a prefix of the last level in some trie."""
    rng = np.random.default_rng(4)
    bytes_ = rng.integers(0, 256, (60, jj.TREES, jj.DEEPEST), dtype=np.uint8)
    bytes_[20:] = np.where(rng.random((40, jj.TREES, jj.DEEPEST)) < 0.85, bytes_[rng.integers(0, 6, 40)], bytes_[20:])
    labels = bytes_.view(">u8").astype(np.uint64).view(np.int64)[:, :, 0]
    nodes = spark.createDataFrame([(i, [int(v) for v in x]) for i, x in enumerate(labels)], "node long, labels array<long>").repartition(3)
    pairs = {(i, j) for i in range(60) for j in range(i)}
    least = jj.shallowest(0.8)
    meet = {p for p in pairs if ((bytes_[p[0], :, :least] == bytes_[p[1], :, :least]).all(1)).any()}
    got = []
    tries = jj.matched(nodes, least).collect()
    for d in range(jj.DEEPEST, least - 1, -1):
        by = defaultdict(set)
        for r in tries:
            if r.most >= d:
                by[r.tree, r.label >> 8 * (jj.DEEPEST - d)].add(r.node)
        for (tree, _), group in by.items():
            ids = sorted(group)
            new = jj.agreement(labels[ids], d, tree)[1]
            got += [(ids[j], ids[i]) for i, j in np.argwhere(new)]
    assert len(got) == len(set(got)) and set(got) == meet


def test_components(spark):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, rng.randrange(101, 160)) for _ in range(80)] + [(7, 7)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long"), "t", 200).collect()}
    assert {got[i] for i in range(61)} == {0} and {v for k, v in got.items() if k >= 100} == {100}


def test_components_of_a_short_list_take_one_job(spark):
    rng = random.Random(4)
    edges = [(i, i + 1) for i in range(0, 50)] + [(rng.randrange(-500, 0), rng.randrange(-500, 0)) for _ in range(300)] + [(7, 7), (9000, 9000)]
    frame = spark.createDataFrame(edges, "a long, b long")
    spark.sparkContext.setJobGroup("short", "short")
    got = sorted(map(tuple, components(frame, "t", shared.SHORT).collect()))
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("short"))
    spark.sparkContext.setJobGroup("long", "long")
    long = sorted(map(tuple, components(frame, "t", shared.SHORT + 1).collect()))
    assert got == long and jobs == 1 and max(n for n, _ in got) == 50
    assert components(frame.where("a > 10000"), "t", 0).collect() == []


# --- lines ---


def dedup(docs, least):
    """By definition: a run of lines of at least `least` words goes where an equal run occurred before, unless it
    overlaps the first such occurrence. Of long texts only the shortest runs from and to each line are tried."""
    parsed = []
    for i, t in docs:
        lines = t.split("\n")
        parsed.append((i, lines, [(n, x, len(WORD.findall(x))) for n, x in enumerate(lines) if WORD.search(x)]))
    times = Counter(x[1] for _, _, s in parsed for x in s)
    first, out = {}, {}
    for d, (i, lines, s) in enumerate(parsed):
        upto = np.cumsum([0, *(x[2] for x in s)])
        runs = set()
        for p in range(len(s)):
            e = int(np.searchsorted(upto, upto[p] + least))
            if e <= len(s):
                runs |= {(p, q) for q in (range(e, len(s) + 1) if len(s) < 60 else (e,))}
            if upto[p + 1] >= least:
                runs.add((int(np.searchsorted(upto, upto[p + 1] - least, "right")) - 1, p + 1))
        gone = set()
        for p, e in sorted(runs):
            if any(times[x[1]] == 1 for x in s[p:e]):
                continue
            o = first.setdefault(tuple(x[1] for x in s[p:e]), (d, p))
            if o != (d, p) and not (o[0] == d and p < o[1] + e - p):
                gone |= set(range(p, e))
        drop = {n for p in gone for n in range(s[p][0], s[p + 1][0] if p + 1 < len(s) else len(lines))}
        out[i] = ("\n".join(x for n, x in enumerate(lines) if n not in drop), len(drop), sum(s[p][2] for p in gone))
    return out


def compare(spark, rows, least):
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r.doc_id: (r.text, r.deleted_lines, r.deleted_words) for r in ld.line_dedup(docs, least).collect()}
    assert got == dedup(sorted(rows), least)


def test_runs_against_longest_earlier_matches(spark):
    rng = random.Random(5)
    lines = ["a b c", "d e", "f", "g h i j", "", "  ", "k l m n o p", "q"]
    compare(spark, [(i, "\n".join(rng.choice(lines) for _ in range(rng.randint(0, 25)))) for i in range(60)], 12)
    compare(spark, [(i, "\n".join(rng.choice("xy") for _ in range(40))) for i in range(12)], 9)


def test_the_first_whole_run_stays(spark):
    five = "a b c d e"
    rows = [(1, "\n".join([five] * 12)), (2, "\n".join(["f g h i j", "k l m n o"] * 11)), (3, "\n".join(["p q r s t"] * 25))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.text.split("\n") for r in ld.line_dedup(docs).collect()}
    assert got[1] == [five] * 12  # the copies of its first ten lines all overlap them
    assert got[2] == ["f g h i j", "k l m n o"] * 5 and got[3] == ["p q r s t"] * 10
    compare(spark, rows, 50)
    again = spark.createDataFrame([*rows, (4, rows[0][1])], "doc_id long, text string")
    assert {r.doc_id: r.text for r in ld.line_dedup(again).collect()}[4] == ""


def test_intervals_span_partitions(spark):
    """One passage in most texts: its rows lie in several partitions of the suffix array."""
    passage = "\n".join(f"w{i} x y z" for i in range(14))
    rows = [(i, f"begin {i}\n{passage}\nend {i}" if i % 5 else f"own {i}") for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = {r.doc_id: r.text for r in ld.line_dedup(docs).collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert [i for i, t in got.items() if passage in t] == [1]
    assert all(got[i] == (f"begin {i}\nend {i}" if i % 5 else f"own {i}") for i in got if i != 1)


def test_line_query(spark, sf):
    docs = [(d.doc_id, d.text) for d in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = {r.doc_id: r for r in op10_line_dedup(spark, sf).collect()}
    want = dedup(docs, ld.MIN_WORDS)
    assert {i: (r.text, r.deleted_lines, r.deleted_words) for i, r in got.items()} == want
    assert any(v[1] for v in want.values()) and all(min(r.copied_from) <= i for i, r in got.items() if r.deleted_lines)


def test_line_awkward_rows(spark):
    docs = cases.frame(spark)
    got = ld.line_dedup(docs).collect()
    assert len(got) == len(cases.rows())
    by = {(r.doc_id, r.deleted_words > 0): r.text for r in got}
    assert by[40, False] is None and by[41, False] == "" and by[42, False] == " \n\t "
    assert by[47, False] and by[48, True] == ""  # which repeats it
    assert sum(r.doc_id == 49 for r in got) == 3
    cases.same_extras(docs, ld.without_copies(docs))
    assert ld.line_dedup(cases.empty(spark)).count() == 0
