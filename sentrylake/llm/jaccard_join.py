"""N-gram Jaccard join by a MinHash LSH forest, with exact verification.

A document is the set of its runs of five words (all its words, if fewer). Documents with equal sets are copies: one
node stands for them. A node has a label in each of TREES prefix tries: a byte of each of DEEPEST min-hashes, as one
number, so that labels of one prefix stand together in the order of numbers. The tries are sorted by range over the
partitions; a label's longest prefix that another node shares is the one that it shares with a neighbour, and labels
whose longest match is under `shallowest` are done.

Matched prefixes are shortened level by level, from DEEPEST on. At a level, only those prefixes are looked at that
gained labels when they were cut to it; their nodes are compared by their labels' bytes, and each pair of nodes is
counted once, in the first trie and at the deepest level where it meets. The similarities s of the pairs found so far
tell how many a level d has missed, as 1 - (1 - s^d)^TREES of them are found: the recall is found / sum of 1 / that.
The shortening ends when it reaches the target, at `shallowest` at the latest, where it does for any similarities
from the threshold on.

Pairs whose label bytes agree in a share of LOOSE or more are candidate links; the components of these links hold every
pair to find (a pair at the threshold falls below LOOSE less often than two 64-bit hashes are equal by chance). The
sets of a component's nodes are brought together and all its pairs compared exactly, in parts of at most two blocks,
which are bounded in nodes and in bytes and send back counts of links and the components within the part: never
pairs. A component of the exact links is a class.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import block_pairs, components, groups, prepare, regrouped, small_join, some, stored, text_bytes
from .shingles import mix, terms

TREES, DEEPEST, THRESHOLD, TARGET = 32, 8, 0.8, 0.99999
SLOTS = TREES * DEEPEST
#: Labels of a block of a prefix; nodes and shingles of a block of a component; rows up to which a list of nodes is broadcast.
LABELS, BLOCK, BLOCK_TERMS, FEW = 512, 512, 2_000_000, 100_000
#: Under the threshold by this many standard deviations of a share of SLOTS: the odds are about 10^-23.
DEVIATIONS = 10
LOWEST = -(1 << 63)
#: The match with a neighbour in another partition, which isn't known there.
EDGE = DEEPEST + 1


def recall(s, d: int):
    """The share of pairs of similarity s that meet in a prefix of d or more in a trie."""
    return 1 - (1 - s**d) ** TREES


def shallowest(threshold: float, target: float = TARGET) -> int:
    """The longest prefix at which the recall is on target even if all pairs are at the threshold."""
    d = DEEPEST
    while d > 1 and recall(threshold, d) < target:
        d -= 1
    return d


def loose(threshold: float) -> float:
    """The least share of equal bytes of a candidate link."""
    return threshold - DEVIATIONS * (threshold * (1 - threshold) / SLOTS) ** 0.5


def hash_family(n: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20_240_101)
    return rng.integers(0, 1 << 31, n, dtype=np.uint32) * np.uint32(2) + np.uint32(1), rng.integers(0, 1 << 32, n, dtype=np.uint32)


def min_hashes(shingles: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x = (shingles >> np.uint64(32)).astype(np.uint32)
    out = np.full(len(a), 0xFFFFFFFF, np.uint32)
    for at in range(0, len(x), 512):
        np.minimum(out, (x[at : at + 512, None] * a + b).min(0), out=out)
    return out


def labels_of(shingles: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The label of each tree, its first min-hash in the highest byte."""
    m = (min_hashes(shingles, a, b) * np.uint32(0x9E3779B1)) >> np.uint32(24)
    return m.astype(np.uint8).view(">u8").astype(np.uint64).view(np.int64)


def set_hash(shingles: np.ndarray) -> int:
    """The node of a set: a 64-bit hash of its sorted shingles."""
    with np.errstate(over="ignore"):
        place = np.arange(1, len(shingles) + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return int(mix(np.array([mix(shingles ^ place).sum(dtype=np.uint64) + np.uint64(len(shingles))], np.uint64)).view(np.int64)[0])


def signed(docs: DataFrame) -> DataFrame:
    """id, t (hash of the text), node, n_terms, labels (one a tree; none without words)."""
    prepare(docs.sparkSession)

    def run(batches):
        a, b = hash_family(SLOTS)
        for batch in some(batches):
            nodes, sizes, labels = [], [], []
            for text in batch.column(2).to_pylist():
                s, _ = terms(text)
                nodes.append(set_hash(s))
                sizes.append(len(s))
                labels.append(labels_of(s, a, b) if len(s) else np.zeros(0, np.int64))
            arrays = [batch.column(0), batch.column(1), pa.array(nodes, pa.int64()), pa.array(sizes, pa.int64()), pa.array(labels, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(arrays, ["id", "t", "node", "n_terms", "labels"])

    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LOWEST)).alias("id"), F.xxhash64(text_bytes()).alias("t"), text_bytes().alias("text"))
    return rows.mapInArrow(run, "id long, t long, node long, n_terms long, labels array<long>")


# --- the forest ---


def shared_prefix(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """How many leading bytes two labels share."""
    both = (x ^ y).view(np.uint64)
    return sum(((both >> np.uint64(64 - 8 * j)) == 0).astype(np.int8) for j in range(1, DEEPEST + 1))


def matched(nodes: DataFrame, least: int) -> DataFrame:
    """tree, label, node, up, most: the labels whose longest matched prefix (`most`) is `least` or more; `up` is the prefix
    that a label shares with the one above it. Labels at a partition's ends count as matched to the full."""
    entries = nodes.select("node", F.posexplode("labels").alias("tree", "label")).select("tree", "label", "node")
    tries = entries.repartitionByRange("tree", "label", "node").sortWithinPartitions("tree", "label", "node")
    names = ["tree", "label", "node", "up", "most"]

    def run(batches):
        held, up = None, EDGE  # the last row, whose neighbour below isn't known yet, and its match above
        for batch in batches:
            if not batch.num_rows:
                continue
            tree, label, node = (c.to_numpy() for c in batch.columns)
            if held is not None:
                tree, label, node = (np.concatenate([[h], c]).astype(c.dtype) for h, c in zip(held, (tree, label, node), strict=True))
            near = np.where(tree[1:] == tree[:-1], shared_prefix(label[1:], label[:-1]), 0)
            ups = np.concatenate([[up], near])
            most = np.minimum(np.maximum(ups[:-1], near), DEEPEST)
            keep = np.flatnonzero(most >= least)
            arrays = [tree[keep], label[keep], node[keep], ups[keep].astype(np.int32), most[keep].astype(np.int32)]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in arrays], names)
            held, up = (tree[-1], label[-1], node[-1]), int(ups[-1])
        if held is not None:
            arrays = [np.array([h]) for h in held] + [np.array([up], np.int32), np.array([DEEPEST], np.int32)]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in arrays], names)

    return tries.mapInArrow(run, "tree int, label long, node long, up int, most int")


def reached(near, todo: np.ndarray) -> list[np.ndarray]:
    """Connected components among `todo`, given near(i, others) -> mask."""
    out = []
    while len(todo):
        found, frontier, todo = [todo[:1]], list(todo[:1]), todo[1:]
        while frontier and len(todo):
            mask = near(frontier.pop(), todo)
            found.append(todo[mask])
            frontier += list(todo[mask])
            todo = todo[~mask]
        out.append(np.concatenate(found))
    return out


def agreement(labels: np.ndarray, d: int, tree: int) -> tuple[np.ndarray, np.ndarray]:
    """Of nodes' labels, all in one prefix of d of the trie `tree`: the equal bytes of each pair, and whether the pair
    meets here for the first time: at no deeper level, and in no trie before this one."""
    n = len(labels)
    equal, new = np.zeros((n, n), np.int16), np.zeros((n, n), bool)
    flat, shift = labels.view(np.uint8).reshape(n, -1), np.uint64(64 - 8 * d)
    for i in range(n - 1):
        equal[i, i + 1 :] = (flat[i + 1 :] == flat[i]).sum(1)
        x = (labels[i + 1 :] ^ labels[i]).view(np.uint64)
        deeper = (x >> (shift - np.uint64(8)) == 0).any(1) if d < DEEPEST else False
        new[i, i + 1 :] = ~((x[:, :tree] >> shift == 0).any(1) | deeper)
    return equal + equal.T, new


def prefix_links(rows: DataFrame, d: int, threshold: float) -> DataFrame:
    """Of the nodes of a part (part, block, own, tree, node, labels): (a, b) with n = 0: what the new candidate links join, as
    stars; (a, b) with n > 0: n new pairs have a equal bytes."""
    least = loose(threshold) * SLOTS

    def run(batches):
        ends: list[tuple[np.ndarray, np.ndarray]] = []
        found = np.zeros(SLOTS + 1, np.int64)
        for g in groups(batches, "part"):
            node, at = np.unique(g.column("node").to_numpy(), return_index=True)
            if len(node) < 2:
                continue
            labels = g.column("labels").combine_chunks().flatten().to_numpy().reshape(-1, TREES)[at]
            equal, new = agreement(labels, d, g.column("tree")[0].as_py())
            if not g.column("own")[0].as_py():
                block = g.column("block").to_numpy()[at]
                new &= block[:, None] != block
            found += np.bincount(equal[new], minlength=SLOTS + 1)
            # pairs that met before are joined there: one node of each of their components stands for the others
            link, all_ = equal >= least, np.arange(len(node))
            head = all_.copy()
            for c in reached(lambda i, o, x=link & ~(new | new.T): x[i, o], all_):
                head[c] = c.min()
            for c in reached(lambda i, o, x=link: x[i, o], all_):
                if len(kept := np.unique(head[c])) > 1:
                    ends.append((np.full(len(kept) - 1, node[kept[0]]), node[kept[1:]]))
            if len(ends) > 2000:
                yield links_batch(ends, found)
                ends, found = [], np.zeros(SLOTS + 1, np.int64)
        yield links_batch(ends, found)

    return rows.mapInArrow(run, "a long, b long, n long")


def links_batch(ends: list[tuple[np.ndarray, np.ndarray]], found: np.ndarray) -> pa.RecordBatch:
    kinds = np.flatnonzero(found)
    a = np.concatenate([*(e[0] for e in ends), kinds]).astype(np.int64)
    b = np.concatenate([*(e[1] for e in ends), np.zeros(len(kinds), np.int64)])
    n = np.concatenate([np.zeros(len(a) - len(kinds), np.int64), found[kinds]])
    return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(n)], ["a", "b", "n"])


def estimated_recall(found: np.ndarray, d: int, threshold: float) -> float:
    """The share of the pairs over the threshold that levels from d on have found, by the similarities of those found."""
    s = np.clip((np.arange(SLOTS + 1) / SLOTS - 1 / 256) / (1 - 1 / 256), 0, 1)  # unequal hashes share a byte at times
    over = s >= threshold
    return float(found[over].sum() / (found[over] / recall(s[over], d)).sum()) if found[over].any() else 0.0


def candidates(nodes: DataFrame, threshold: float, target: float = TARGET) -> list[DataFrame]:
    """Candidate links (a, b) of nodes (node, labels), a table a level."""
    least, out = shallowest(threshold, target), []
    tries = stored(matched(nodes, least), "tries")
    wanted = tries.select("node").distinct()
    labels = stored(nodes.join(wanted, "node", "left_semi").select("node", "labels"), "labels")
    found = np.zeros(SLOTS + 1, np.int64)
    for d in range(DEEPEST, least - 1, -1):
        key = F.xxhash64("tree", F.shiftright("label", 8 * (DEEPEST - d)))
        fresh = F.lit(True) if d == DEEPEST else (F.col("up") == d) | (F.col("up") == EDGE)
        level = tries.where(F.col("most") >= d).select(key.alias("key"), "tree", "node", fresh.alias("fresh"))
        sizes = level.groupBy("key").agg(F.count("*").alias("size"), F.max("fresh").alias("fresh")).where("size > 1 and fresh")
        level = level.drop("fresh").join(regrouped(sizes, "key"), "key")
        parts = block_pairs(level, "key", F.ceil(F.col("size") / LABELS), "node").select("part", "block", "own", "tree", "node")
        links = stored(prefix_links(dealt(parts.join(labels, "node").select("part", "block", "own", "tree", "node", "labels")), d, threshold), f"links-{d}")
        out.append(links.where("n = 0").select("a", "b"))
        for r in links.where("n > 0").groupBy("a").agg(F.sum("n").alias("n")).collect():  # at most SLOTS + 1 rows
            found[r.a] += r.n
        if estimated_recall(found, d, threshold) >= target:
            break
    return out


# --- exact verification ---


def common(sets: list[np.ndarray], columns: int = 4096, entries: int = 300_000) -> np.ndarray:
    """The sizes of all pairwise intersections of sorted sets, by products of indicator matrices: the shingles are
    taken in ranges of about `entries`, so that memory doesn't grow with the texts."""
    out = np.zeros((len(sets), len(sets)), np.float32)
    ranges = sum(map(len, sets)) // entries + 1
    edges = [int(k * (1 << 64) // ranges) for k in range(1, ranges)]
    cuts = [[0, *np.searchsorted(s, np.array(edges, np.uint64)), len(s)] for s in sets]
    for k in range(ranges):
        part = [s[c[k] : c[k + 1]] for s, c in zip(sets, cuts, strict=True)]
        owner = np.repeat(np.arange(len(sets), dtype=np.int32), [len(s) for s in part])
        kinds, place = np.unique(np.concatenate(part), return_inverse=True)
        order = np.argsort(place, kind="stable")
        owner, place = owner[order], place[order]
        for at in range(0, len(kinds), columns):
            lo, hi = np.searchsorted(place, [at, at + columns])
            m = np.zeros((len(sets), min(columns, len(kinds) - at)), np.float32)
            m[owner[lo:hi], place[lo:hi] - at] = 1
            out += m @ m.T
    return out


def verified(rows: DataFrame, threshold: float) -> DataFrame:
    """node, links, root for each node of a part (part, block, own, node, shingles): its links inside the part that
    this part counts, and the least node that these links reach."""

    def run(batches):
        for g in groups(batches, "part"):
            node, first = np.unique(g.column("node").to_numpy(), return_index=True)
            block = g.column("block").to_numpy()[first]
            sets = [np.frombuffer(x, np.uint64) for x in g.column("shingles").take(pa.array(first)).to_pylist()]
            size = np.array([len(s) for s in sets], np.float32)
            both = common(sets)
            # |A and B| >= threshold |A or B|, in whole numbers
            linked = both >= np.ceil(np.round(threshold * (size[:, None] + size - both), 6))
            np.fill_diagonal(linked, False)
            if not g.column("own")[0].as_py():
                linked &= block[:, None] != block
            root = np.arange(len(node))
            for c in reached(lambda i, o, x=linked: x[i, o], np.arange(len(node))):
                root[c] = c.min()
            yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(linked.sum(1).astype(np.int64)), pa.array(node[root])], ["node", "links", "root"])

    return rows.mapInArrow(run, "node long, links long, root long")


def dealt(rows: DataFrame) -> DataFrame:
    return rows.repartition("part").sortWithinPartitions("part")


def shingled(texts: DataFrame) -> DataFrame:
    """node, shingles of rows (node, text)."""

    def run(batches):
        for batch in some(batches):
            names = batch.schema.names
            sets = [terms(t)[0].tobytes() for t in batch.column(names.index("text")).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(names.index("node")), pa.array(sets, pa.binary())], ["node", "shingles"])

    return texts.mapInArrow(run, "node long, shingles binary")


def classes(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """id, t, node, class_id, class_t (the class's first document), copy_of, n_copies, n_links of each row."""
    prepare(docs.sparkSession)
    rows = stored(signed(docs), "signed")
    first = F.min(F.struct("id", "t", "n_terms", "labels")).alias("first")  # one id and text have one set
    nodes = stored(rows.groupBy("node").agg(first, F.count("*").alias("n_copies")), "nodes")
    edges = None
    for links in candidates(nodes.where("first.n_terms > 0").select("node", "first.labels"), threshold):
        edges = links if edges is None else edges.union(links)
    count = edges.count()
    near = stored(components(edges, "near", count), "near-roots", 2 * count)
    pick = stored(near.join(nodes, "node").select("node", "root", "first.id", "first.t", "first.n_terms"), "picked", 2 * count)
    found = pick.count()
    texts = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LOWEST)).alias("id"), F.xxhash64(text_bytes()).alias("t"), text_bytes().alias("text"))
    sets = shingled(small_join(texts, pick.select("id", "t", "node"), ["id", "t"], found, FEW, "inner").select("node", "text")).dropDuplicates(["node"])
    sizes = pick.groupBy("root").agg(F.count("*").alias("size"), F.sum("n_terms").alias("terms")).where("size > 1")
    blocks = F.ceil(F.greatest(F.col("size") / BLOCK, F.col("terms") / BLOCK_TERMS))
    parts = block_pairs(pick.select("root", "node").join(regrouped(sizes, "root"), "root"), "root", blocks, "node").select("part", "block", "own", "node")
    links = stored(verified(dealt(parts.join(sets, "node").select("part", "block", "own", "node", "shingles")), threshold), "links")
    roots = components(links.select(F.col("root").alias("a"), F.col("node").alias("b")), "classes", links.count())
    nodes = nodes.join(roots, "node", "left").join(links.groupBy("node").agg(F.sum("links").alias("n_links")), "node", "left")
    nodes = stored(nodes.select("node", F.struct("first.id", "first.t").alias("first"), "n_copies", F.coalesce("root", "node").alias("root"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links")), "classed")
    named = nodes.groupBy("root").agg(F.min("first").alias("head"))
    nodes = nodes.join(regrouped(named, "root"), "root").select("node", F.col("head.id").alias("class_id"), F.col("head.t").alias("class_t"), F.col("first.id").alias("copy_of"), "n_copies", "n_links")
    return rows.select("id", "t", "node").join(nodes, "node")


def jaccard_join(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, class_id, copy_of, n_copies, n_links: a row per document.

    class_id: the smallest doc_id of the class, which links of at least `threshold` connect; copy_of: the smallest
    doc_id with an equal set; n_links: how many other sets are linked to the document's. Texts without words (null,
    empty) are copies of each other. Repeated rows are copies; an empty table gives no rows."""
    null = lambda c: F.when(F.col(c) != LOWEST, F.col(c)).alias("doc_id" if c == "id" else c)
    return classes(docs, threshold).select(null("id"), null("class_id"), null("copy_of"), "n_copies", "n_links")


def one_of_each(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The first document of each class, with all its columns."""
    heads = classes(docs, threshold).where("id = class_id and t = class_t").select("id", "t").distinct()
    rows = docs.select(F.struct("*").alias("row"), F.coalesce(F.col("doc_id").cast("long"), F.lit(LOWEST)).alias("id"), F.xxhash64(text_bytes()).alias("t"))
    rows = rows.join(heads, ["id", "t"], "left_semi").dropDuplicates(["id", "t"])
    return rows.select(*(F.col("row").getField(c).alias(c) for c in docs.columns))
