"""Language-model scores: context-tree weighting over bytes, beside an add-one unigram model over words.

Context tree. A text is its UTF-8 bytes after A-Z are lowered, between DEPTH start marks and one end mark. Spark
counts every byte with the DEPTH bytes before it over all training texts; every context that occurs is a node, so the
tree grows with the corpus. Each byte is eight binary decisions; each node has a Krichevsky-Trofimov estimate for each
decision, and the estimates of all depths are mixed with the weights that context-tree weighting gives (half for
stopping at a node, half for its children). Code lengths go up by grouping on the shortened context and the mixture
down by joining on it; no table of the tree is on the driver or broadcast. What occurs only in held-out texts has
count 0, which changes no weight.

Words. The same pass counts every word of the training texts, exactly. Null and empty texts consist of the end alone.

Scores. Texts are taken in batches of about BATCH_BYTES. A batch asks for its distinct bytes in context and its
distinct words, by the part of the tables that has them, and is scored when the answers are back. There are as many
parts as keep a part's table short; a part with many questions is dealt over tasks that each get its table, and
answers them one after another, so no task holds more than a table, a question and a batch. Both numbers follow from
the input, not from session settings.
"""

from __future__ import annotations

import os
from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shared import groups, prepare, some, stored, text_bytes

DEPTH = 4
PAD, STOP = 0xFE, 0xFF  # bytes that UTF-8 never has
#: The end token's hash: no word has white space.
END = xxhash.xxh64_intdigest(b"\n")
#: Bytes of text after which counts are handed on, and bytes of a batch.
COUNTED, BATCH_BYTES = 4_000_000, 4_000_000
LANES = 8192
#: (Context, byte) rows that a task computes at once; a context of DEPTH - 1 bytes has at most 65,536 of them.
CHUNK = 60_000
#: Bytes of a batch's text whose positions are held at once.
PART_BYTES = 1 << 19
#: Rows of a part's table, and bytes of questions to a part that a task answers.
PART_ROWS, ASKED_BYTES = 150_000, 8_000_000


def lowered(text: str) -> bytes:
    return text.encode().lower()  # bytes.lower() lowers A-Z only


def freed(batches):
    """Arrow batches; what Arrow holds of those before is given back first, as a worker would keep it for good."""
    for batch in batches:
        yield batch
        del batch
        pa.default_memory_pool().release_unused()


# --- the context tree ---


def joined(texts: list[bytes]) -> np.ndarray:
    """The bytes of the texts, each between its marks."""
    start, stop = bytes([PAD] * DEPTH), bytes([STOP])
    return np.frombuffer(b"".join(start + t + stop for t in texts), np.uint8)


def places(b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """At each byte after the first DEPTH: (DEPTH bytes, byte) as a number, and whether the byte is no start mark."""
    key = np.zeros(max(len(b) - DEPTH, 0), np.uint64)
    for k in range(DEPTH + 1):
        key <<= np.uint64(8)
        key |= b[k : len(b) - DEPTH + k]
    return key, b[DEPTH:] != PAD


def positions(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """`places` of the texts with their marks."""
    return places(joined(texts))


def grams(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (DEPTH bytes, byte) as sorted numbers, and their counts: by PART_BYTES at a time, of one long text too, so
    that a worker holds the numbers of that many places and what is distinct, never those of all places."""
    b = joined(texts)
    keys, counts, held = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], 0
    for at in range(0, max(len(b) - DEPTH, 0), PART_BYTES):
        key, real = places(b[at : at + PART_BYTES + DEPTH])
        key, n = np.unique(key[real], return_counts=True)
        keys.append(key)
        counts.append(n)
        held += len(key)
        if held > 2 * max(PART_BYTES, len(keys[0])):
            keys, counts = [[x] for x in summed(keys, counts)]
            held = len(keys[0])
    return summed(keys, counts)


def summed(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, sorted, and the sums of their counts."""
    key, place = np.unique(np.concatenate(keys), return_inverse=True)
    return key, np.bincount(place, np.concatenate(counts), len(key)).astype(np.int64)


def distinct(texts: list[bytes]) -> np.ndarray:
    """Distinct (DEPTH bytes, byte) as sorted numbers."""
    return grams(texts)[0]


def log_gamma(x: np.ndarray) -> np.ndarray:
    """Stirling's series, after moving arguments under 8 up."""
    x = np.asarray(x, float)
    shift = np.zeros_like(x)
    for _ in range(8):
        low = x < 8
        if not low.any():
            break
        shift[low] -= np.log(x[low])
        x = np.where(low, x + 1, x)
    return shift + (x - 0.5) * np.log(x) - x + 0.9189385332046727 + 1 / (12 * x) - 1 / (360 * x**3) + 1 / (1260 * x**5)


def decisions(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For rows of 256 byte counts: the zeros and ones of the 255 binary decisions, in heap order."""
    levels = [counts]
    while levels[-1].shape[1] > 1:
        levels.append(levels[-1][:, 0::2] + levels[-1][:, 1::2])
    zeros = np.concatenate([level[:, 0::2] for level in levels[-2::-1]], 1)
    ones = np.concatenate([level[:, 1::2] for level in levels[-2::-1]], 1)
    return zeros, ones


def kt_log(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return log_gamma(a + 0.5) + log_gamma(b + 0.5) - log_gamma(a + b + 1) - np.log(np.pi)


def byte_logs(one: np.ndarray) -> np.ndarray:
    """log10 P of each byte from P(one) of the 255 decisions."""
    out = np.zeros((len(one), 1))
    at = 0
    for bit in range(8):
        p = np.clip(one[:, at : at + (1 << bit)], 1e-12, 1 - 1e-12)
        out = np.stack([out + np.log10(1 - p), out + np.log10(p)], 2).reshape(len(one), 2 << bit)
        at += 1 << bit
    return out


def weighted_tree(nodes: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(next state, log10 P) tables of 256 columns. nodes[d]: sorted contexts of d bytes as numbers (the last byte
    lowest); counts[d]: rows of 256 counts of the byte that follows. The tree of a small corpus in memory: what
    `gram_logs` is held against."""
    depth = len(nodes) - 1
    parent = [None, *(np.searchsorted(nodes[d - 1], nodes[d] & np.uint64((1 << 8 * (d - 1)) - 1)) for d in range(1, depth + 1))]
    inner, rest, stay, below = [None] * (depth + 1), [None] * (depth + 1), [None] * (depth + 1), None
    for d in range(depth, -1, -1):
        own = kt_log(*decisions(counts[d]))
        has = np.zeros(len(nodes[d]), bool)
        left = counts[d].copy()
        split = np.zeros_like(own)
        if d < depth and len(nodes[d + 1]):
            has[parent[d + 1]] = True
            np.subtract.at(left, parent[d + 1], counts[d + 1])
            np.add.at(split, parent[d + 1], below)
        split[has] += kt_log(*decisions(left[has]))
        both = np.logaddexp(own, split) - np.log(2)
        stay[d] = np.where(has[:, None], np.exp(own - np.log(2) - both), 1.0)
        below = np.where(has[:, None], both, own)
        inner[d], rest[d] = has, left
    estimate = lambda c: (lambda z, o: (o + 0.5) / (z + o + 1))(*decisions(c))
    known = [estimate(c) for c in counts]
    logs = []
    for d in range(depth + 1):
        mixed = stay[d] * known[d] + (1 - stay[d]) * np.where(inner[d][:, None], estimate(rest[d]), known[d])
        up = np.arange(len(nodes[d]))
        for e in range(d, 0, -1):
            up = parent[e][up]
            mixed = stay[e - 1][up] * known[e - 1][up] + (1 - stay[e - 1][up]) * mixed
        logs.append(byte_logs(mixed).astype(np.float32))
    first = np.cumsum([0, *map(len, nodes)])
    to = []
    byte = np.arange(256, dtype=np.uint64)
    for d in range(depth + 1):
        longer = (nodes[d][:, None] << np.uint64(8)) | byte
        state = np.zeros(longer.shape, np.int32)
        for e in range(1, min(d + 1, depth) + 1):
            cut = longer & np.uint64((1 << 8 * e) - 1)
            at = np.minimum(np.searchsorted(nodes[e], cut), max(len(nodes[e]) - 1, 0))
            if len(nodes[e]):
                found = nodes[e][at] == cut
                state[found] = (first[e] + at)[found]
        to.append(state)
    return np.concatenate(to), np.concatenate(logs)


def text_logs(texts: list[bytes], to: np.ndarray, logs: np.ndarray) -> np.ndarray:
    """log10 P of each text, its end included."""
    start, stop = bytes([PAD] * DEPTH), bytes([STOP])
    b = np.frombuffer(b"".join(start + t + stop for t in texts), np.uint8)
    n = len(b)
    width = -(-n // min(LANES, n // 64 + 1))
    rows = -(-n // width)
    grid = np.full(DEPTH + rows * width, PAD, np.uint8)
    grid[DEPTH : DEPTH + n] = b
    lanes = np.lib.stride_tricks.as_strided(grid, (rows, width + DEPTH), (width, 1)).T.copy()  # each begins DEPTH bytes early
    out = np.zeros((width, rows), np.float32)
    state, to, logs = np.zeros(rows, np.int64), to.ravel(), logs.ravel()
    for k in range(width + DEPTH):
        key = state * 256 + lanes[k]
        if k >= DEPTH:
            out[k - DEPTH] = logs[key]
        state = to[key].astype(np.int64)
    flat = out.T.ravel()[:n].astype(float)
    flat[b == PAD] = 0
    return np.add.reduceat(flat, np.cumsum([0] + [len(t) + DEPTH + 1 for t in texts[:-1]]))


GRAM, WORD = 0, 1


def counted(docs: DataFrame, training: Column) -> DataFrame:
    """(kind, key, n): GRAM the bytes in context of all texts and their counts in the training texts, WORD the tokens of the
    training texts and their counts."""

    def run(batches):
        def flush():
            k, n = grams(held)
            other = np.setdiff1d(grams(apart)[0], k, assume_unique=True)
            words = Counter()
            for t in held:
                words.update(t.split())
            w = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
            key = np.concatenate([k, other, w, np.array([END], np.uint64)])
            kind = np.repeat(np.array([GRAM, WORD], np.int32), [len(k) + len(other), len(w) + 1])
            n = np.concatenate([n, np.zeros(len(other), np.int64), np.fromiter(words.values(), np.int64, len(words)), [len(held)]])
            return pa.RecordBatch.from_arrays([pa.array(kind), pa.array(key.view(np.int64)), pa.array(n.astype(np.int64))], ["kind", "key", "n"])

        held, apart, size = [], [], 0
        for batch in some(batches):
            for t, train in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                (held if train else apart).append(lowered(t))
                size += len(t)
                if size >= COUNTED:
                    yield flush()
                    held, apart, size = [], [], 0
        if held or apart:
            yield flush()

    rows = docs.select(text_bytes().alias("text"), training.alias("train")).mapInArrow(lambda b: freed(run(b)), "kind int, key long, n long")
    return rows.groupBy("kind", "key").agg(F.sum("n").alias("n"))


def chunks(batches, key: str, rows: int):
    """Of Arrow batches sorted by `key`: tables of about `rows` rows of whole groups."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.num_rows
        if size >= rows:
            got = pa.Table.from_batches(held).combine_chunks()
            k = got.column(key).to_numpy()
            cut = int(np.searchsorted(k, k[-1]))
            if cut:
                yield got.slice(0, cut)
            held = got.slice(cut).to_batches()
            size = len(got) - cut
    if size:
        yield pa.Table.from_batches(held)


def leaves(key: np.ndarray, n: np.ndarray):
    """The decisions of the deepest contexts (context << 8 | place in heap order), their zeros and ones, and for each
    of the eight decisions of each key its place among them and the bit."""
    context, byte = key >> np.uint64(8) << np.uint64(8), key & np.uint64(255)
    node = np.concatenate([context | np.uint64(1 << j) | byte >> np.uint64(8 - j) for j in range(8)])
    bit = np.concatenate([byte >> np.uint64(7 - j) & np.uint64(1) for j in range(8)]).astype(bool)
    node, place = np.unique(node, return_inverse=True)
    n = np.tile(n, 8)
    return node, np.bincount(place, np.where(bit, 0, n), len(node)), np.bincount(place, np.where(bit, n, 0), len(node)), place, bit


def shorter(node: np.ndarray, d: int) -> np.ndarray:
    """Decisions in contexts of `d` bytes, of decisions in longer ones."""
    return node & np.uint64((1 << 8 * (d + 1)) - 1)


NODES = "node long, a long, b long, w double, stay double"


def nodes(node, a, b, split) -> pa.RecordBatch:
    """NODES of inner decisions, `split` being the logarithm of what the children give."""
    own = kt_log(a, b)
    both = np.logaddexp(own, split)
    arrays = [node.view(np.int64), a.astype(np.int64), b.astype(np.int64), both - np.log(2), np.exp(own - both)]
    return pa.RecordBatch.from_arrays([pa.array(x) for x in arrays], ["node", "a", "b", "w", "stay"])


def gram_logs(counts: DataFrame) -> DataFrame:
    """(key, log): log10 P of the byte in its context, of all rows of (key, n)."""
    near = DEPTH - 1
    context = F.shiftrightunsigned("key", 8).bitwiseAND(F.lit((1 << 8 * near) - 1))
    rows = counts.select(context.alias("c"), "key", "n")

    def deepest(batches):
        for t in chunks(batches, "c", CHUNK):
            node, a, b, _, _ = leaves(t.column("key").to_numpy().view(np.uint64), t.column("n").to_numpy())
            up, place = np.unique(shorter(node, near), return_inverse=True)
            yield nodes(up, *(np.bincount(place, x, len(up)) for x in (a, b, kt_log(a, b))))

    def inner(batches):
        for t in batches:
            yield nodes(t.column(0).to_numpy().view(np.uint64), *(t.column(k).to_numpy() for k in (1, 2, 3)))

    most = 8 * counts.count()
    levels = {near: stored(rows.repartition("c").sortWithinPartitions("c").mapInArrow(lambda b: freed(deepest(b)), NODES), "lm-nodes", most)}
    parent = lambda d: F.col("node").bitwiseAND(F.lit((1 << 8 * d) - 1))
    for d in range(near, 0, -1):
        sums = levels[d].groupBy(parent(d).alias("node")).agg(*(F.sum(x).alias(x) for x in ("a", "b", "w")))
        levels[d - 1] = stored(sums.mapInArrow(inner, NODES), "lm-nodes", min(most, 255 << 8 * (d - 1)))
    mixed = None
    for d in range(DEPTH):
        estimate = F.col("stay") * (F.col("b") + 0.5) / (F.col("a") + F.col("b") + 1)
        if mixed is None:
            mixed = levels[0].select("node", estimate.alias("sum"), (1 - F.col("stay")).alias("rest"))
        else:
            above = mixed.select(F.col("node").alias("up"), F.col("sum").alias("sum_up"), F.col("rest").alias("rest_up"))
            both = levels[d].withColumn("up", parent(d)).join(above, "up")
            mixed = both.select("node", (F.col("sum_up") + F.col("rest_up") * estimate).alias("sum"), (F.col("rest_up") * (1 - F.col("stay"))).alias("rest"))

    def last(batches):
        for t in chunks(batches, "c", CHUNK):
            is_node = t.column("n").is_null().to_numpy()
            key = t.column("key").to_numpy().view(np.uint64)
            at = np.flatnonzero(is_node)
            at = at[np.argsort(key[at])]
            total, rest = (t.column(x).to_numpy()[at] for x in ("sum", "rest"))
            known, key = key[at], key[~is_node]
            node, a, b, place, bit = leaves(key, t.column("n").filter(pa.array(~is_node)).to_numpy())
            up = np.searchsorted(known, shorter(node, near))
            one = np.clip(total[up] + rest[up] * (b + 0.5) / (a + b + 1), 1e-12, 1 - 1e-12)[place]
            log = np.log10(np.where(bit, one, 1 - one)).reshape(8, -1).sum(0)
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(log)], ["key", "log"])

    down = mixed.select(F.shiftrightunsigned("node", 8).alias("c"), F.col("node").alias("key"), F.lit(None).cast("long").alias("n"), "sum", "rest")
    both = rows.select("c", "key", "n", F.lit(0.0).alias("sum"), F.lit(0.0).alias("rest")).unionByName(down)
    return both.repartition("c").sortWithinPartitions("c").mapInArrow(lambda b: freed(last(b)), "key long, log double")


# --- scores ---


def part_of(keys: np.ndarray, parts: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return ((keys * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(32)) % np.uint64(parts)).astype(np.int64)


def dealt(keys: np.ndarray, parts: int) -> list[tuple[int, np.ndarray]]:
    """Of sorted keys: the places of those of each part."""
    part = part_of(keys, parts)
    order = np.argsort(part, kind="stable")
    which, first = np.unique(part[order], return_index=True)
    return list(zip(which.tolist(), np.split(order, first[1:]), strict=True)) if len(keys) else []


def squeezed(keys: np.ndarray) -> bytes:
    """Sorted keys in short: their differences, byte by byte place."""
    steps = np.diff(keys, prepend=np.uint64(0))
    raw = steps.view(np.uint8).reshape(-1, 8).T.tobytes()
    return len(keys).to_bytes(8, "little") + pa.compress(raw, "zstd", asbytes=True)


def restored(data: bytes) -> np.ndarray:
    n = int.from_bytes(data[:8], "little")
    raw = pa.decompress(data[8:], 8 * n, "zstd", asbytes=True)
    return np.cumsum(np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(8, n).T).view(np.uint64).ravel(), dtype=np.uint64)


def wanted(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """What a batch asks for: its distinct bytes in context, and its distinct tokens by their hashes, both sorted; and the
    words in the order of the latter (the end token is the empty word)."""
    words = set()
    for t in texts:
        words.update(t.split())
    words = [*words, b""]
    h = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    h[-1] = END
    order = np.argsort(h, kind="stable")
    return distinct(texts), h[order], [words[i] for i in order]


PACKED = "kind int, part long, batch long, a binary, b binary, c binary"
#: The kinds GRAM and WORD: a batch's questions to a part; DOCS: its documents (ids and lengths; training; text).
DOCS = 2


def batches_of(docs: DataFrame, training: Column, parts: tuple[int, int]) -> DataFrame:
    def run(batches):
        def flush():
            batch = int.from_bytes(os.urandom(7), "little")  # any number that no other batch has
            texts = [lowered(t) for t in held["text"]]
            grams_, tokens, _ = wanted(texts)
            rows = [(kind, p, batch, squeezed(keys[at]), b"", b"") for kind, keys in ((GRAM, grams_), (WORD, tokens)) for p, at in dealt(keys, parts[kind])]
            ids = pa.RecordBatch.from_arrays([pa.array(held["doc_id"], pa.int64()), pa.array([len(t) for t in texts], pa.int64())], ["i", "n"])
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, ids.schema) as w:
                w.write_batch(ids)
            rows.append((DOCS, -1, batch, sink.getvalue().to_pybytes(), np.array(held["train"], bool).tobytes(), pa.compress(b"".join(texts), "zstd", asbytes=True)))
            kinds = [pa.int32(), pa.int64(), pa.int64(), *[pa.binary()] * 3]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["kind", "part", "batch", "a", "b", "c"])

        held, size = {"doc_id": [], "text": [], "train": []}, 0
        for b in some(batches):
            for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                for k, v in zip(held, row, strict=True):
                    held[k].append(v)
                size += len(row[1])
                if size >= BATCH_BYTES:
                    yield flush()
                    held, size = {"doc_id": [], "text": [], "train": []}, 0
        if held["text"]:
            yield flush()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes().alias("text"), training.alias("train")).mapInArrow(lambda b: freed(run(b)), PACKED)


ANSWERS = "batch long, kind int, part long, a binary"


def packed(table: DataFrame, kind: int, parts: int) -> DataFrame:
    """Rows (key, value) as (kind, part, a: keys, b: values)."""

    def run(batches):
        for g in batches:
            key, value = g.column(0).to_numpy().view(np.uint64), g.column(1).to_numpy()
            order = np.argsort(key)
            key, value = key[order], value[order]
            spans = dealt(key, parts)
            arrays = [pa.array([kind] * len(spans), pa.int32()), pa.array([p for p, _ in spans], pa.int64())]
            arrays += [pa.array([squeezed(key[at]) for _, at in spans], pa.binary()), pa.array([value[at].tobytes() for _, at in spans], pa.binary())]
            yield pa.RecordBatch.from_arrays(arrays, ["kind", "part", "a", "b"])

    return table.mapInArrow(run, "kind int, part long, a binary, b binary")


def answers(asked: DataFrame, logs: DataFrame, counts: DataFrame, parts: tuple[int, int], tasks: int) -> DataFrame:
    """For the questions (kind, part, batch, a): the values of the keys, in their order; 0 for keys that no table has.

    logs, counts: (key, value) of the kinds GRAM (float) and WORD (long). A part's questions are dealt over `tasks` tasks."""

    def run(batches):
        group, table, keys, values = None, [], None, None
        for g in some(batches):
            out = []
            for kind, part, batch, a, b in zip(*(g.column(x).to_pylist() for x in ("kind", "part", "batch", "a", "b")), strict=True):
                if group != (kind, part):
                    group, table, keys = (kind, part), [], None
                if batch is None:
                    table.append((restored(a), np.frombuffer(b, np.float32 if kind == GRAM else np.int64)))
                    continue
                if keys is None:
                    keys, values = (np.concatenate(x) for x in zip(*table, strict=True)) if table else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
                    order = np.argsort(keys)
                    keys, values, table = keys[order], values[order], []
                mine = restored(a)
                at = np.minimum(np.searchsorted(keys, mine), max(len(keys) - 1, 0))
                found = np.where(keys[at] == mine, values[at], 0) if len(keys) else np.zeros(len(mine), np.int64)
                out.append((batch, kind, part, found.astype(np.float32 if kind == GRAM else np.int64).tobytes()))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), [pa.int64(), pa.int32(), pa.int64(), pa.binary()], strict=True)], ["batch", "kind", "part", "a"])

    table = packed(logs, GRAM, parts[GRAM]).union(packed(counts, WORD, parts[WORD]))
    table = table.select("kind", "part", F.lit(None).cast("long").alias("batch"), "a", "b", F.explode(F.sequence(F.lit(0), F.lit(tasks - 1))).alias("task"))
    rows = asked.select("kind", "part", "batch", "a", F.lit(b"").alias("b"), F.pmod(F.xxhash64("batch"), F.lit(tasks)).cast("int").alias("task"))
    rows = rows.unionByName(table).repartition(tasks * sum(parts), "kind", "part", "task")
    return rows.sortWithinPartitions("kind", "part", "task", F.col("batch").asc_nulls_first()).mapInArrow(lambda b: freed(run(b)), ANSWERS)


def gathered(keys: np.ndarray, parts: int, replies: dict[int, bytes], kind: type) -> np.ndarray:
    """The answers to a batch's sorted keys, in their order."""
    out = np.zeros(len(keys), kind)
    for p, at in dealt(keys, parts):
        out[at] = np.frombuffer(replies[p], kind)
    return out


def text_scores(texts: list[bytes], known: np.ndarray, log: np.ndarray) -> np.ndarray:
    """log10 P of each text, its end included; `log` has that of each of `known`, the distinct bytes in context."""
    b, out = joined(texts), np.zeros(len(texts))
    starts = np.cumsum([0] + [len(t) + DEPTH + 1 for t in texts[:-1]])
    for at in range(DEPTH, len(b), PART_BYTES):
        key, real = places(b[at - DEPTH : at + PART_BYTES])
        real = np.flatnonzero(real).astype(np.uint64)
        key = np.sort(key[real] << np.uint64(24) | real)  # with their places, so that those of one key are looked up once, in order
        place = key & np.uint64((1 << 24) - 1)
        key >>= np.uint64(24)
        first = np.flatnonzero(np.diff(key, prepend=~key[:1]))
        flat = np.zeros(min(PART_BYTES, len(b) - at))
        flat[place] = np.repeat(log[np.searchsorted(known, key[first])], np.diff(first, append=len(key)))
        lo, hi = np.searchsorted(starts, at, "right") - 1, np.searchsorted(starts, at + len(flat))
        out[lo:hi] += np.add.reduceat(flat, np.maximum(starts[lo:hi] - at, 0))
    return out


RESULT = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def lm_scores(docs: DataFrame, held_out: Column) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Learns from the rows for which `held_out` (a condition on doc_id) does not hold. Repeated rows count and score
    each for itself; an empty table gives no rows; without training texts every count is 0 and the tree is its prior."""
    prepare(docs.sparkSession)
    counts = stored(counted(docs, ~held_out), "lm-counts")
    sizes = {r.kind: r for r in counts.groupBy("kind").agg(F.count("*").alias("rows"), F.sum("n").alias("n"), F.sum((F.col("n") > 0).cast("long")).alias("kinds")).collect()}
    parts = tuple(sizes[k].rows // PART_ROWS + 1 if k in sizes else 1 for k in (GRAM, WORD))
    tokens, kinds = (sizes[WORD].n, sizes[WORD].kinds) if WORD in sizes else (0, 0)
    rows = stored(batches_of(docs, ~held_out, parts), "lm-batches")
    asked = rows.where(F.col("kind") != DOCS)
    most = asked.groupBy("kind", "part").agg(F.sum(F.octet_length("a")).alias("n")).agg(F.max("n")).first()[0] or 0
    logs = gram_logs(counts.where(F.col("kind") == GRAM).select("key", "n")).select("key", F.col("log").cast("float"))
    floor = np.log10(tokens + kinds + 1)
    replies = answers(asked, logs, counts.where(F.col("kind") == WORD).select("key", "n"), parts, most // ASKED_BYTES + 1)

    def run(batches):
        for g in groups(batches, "batch"):
            kind, part, a = (g.column(x).to_pylist() for x in ("kind", "part", "a"))
            head = kind.index(DOCS)
            back = ({p: x for k, p, x in zip(kind, part, a, strict=True) if k == which} for which in (GRAM, WORD))
            ids, sizes = pa.ipc.open_stream(a[head]).read_all().columns
            ends = np.cumsum(sizes.to_numpy())
            text = pa.decompress(g.column("c")[head].as_py(), int(ends[-1]), "zstd", asbytes=True)
            texts = [text[lo:hi] for lo, hi in zip([0, *ends], ends, strict=False)]
            known, tokens_, words = wanted(texts)
            score = text_scores(texts, known, gathered(known, parts[GRAM], next(back), np.float32))
            count = gathered(tokens_, parts[WORD], next(back), np.int64)
            value = dict(zip(words, np.log10(count + 1).tolist(), strict=True))
            new = {w for w, c in zip(words, count.tolist(), strict=True) if not c}
            n_tokens, n_known, base = [], [], []
            for t in texts:
                w = [*t.split(), b""]
                n_tokens.append(len(w))
                n_known.append(len(w) - (sum(map(new.__contains__, w)) if new else 0))
                base.append(sum(map(value.__getitem__, w)) - len(w) * floor)
            train = np.frombuffer(g.column("b")[head].as_py(), bool)
            arrays = [ids.combine_chunks(), pa.array(~train), pa.array(n_tokens, pa.int64()), pa.array(n_known, pa.int64()), pa.array(np.full(len(texts), tokens)), pa.array(base, pa.float64()), pa.array(score)]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    none = F.lit(None).cast("binary")
    own = rows.where(F.col("kind") == DOCS).select("batch", "kind", "part", "a", "b", "c")
    back = replies.select("batch", "kind", "part", "a", none.alias("b"), none.alias("c"))
    return own.unionByName(back).repartition("batch").sortWithinPartitions("batch").mapInArrow(lambda b: freed(run(b)), RESULT)
