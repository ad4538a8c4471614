"""Vector codes: product quantisation whose Lloyd rounds keep their parts in heaps.

Vectors become integers and are cut into PARTS equal parts; each part position has a codebook of ENTRIES entries. A
round assigns every part to its nearest entry and replaces each entry by the mean of its parts, rounded down.

Vectors are gathered once into blocks of BLOCK rows, which are the rows of a stored table. A block has a heap for each
entry of each position, which holds the parts assigned to it, keyed by how much nearer the entry was than the second
nearest (the lower bound of the others' distance minus the upper bound of the own) plus the entry's drift so far. The
drift grows each round by how far the entry moved and how far any other of its codebook moved at most. As long as a
part's key is above the entry's drift, no other entry can have come as near, so a round pops the parts at the top of
each heap whose keys the drift has reached, scans only those exactly and pushes them to the heap of the entry
they belong to now. Sums and counts change by the parts that moved. A task sends back one row of changes, and their
sum, a row for each component of the codebooks, is all that the driver holds besides the codebooks.

Distances are exact: integers, in floating point where they stay under 2^53. Keys are rounded down.
"""

from __future__ import annotations

import hashlib
import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import prepare, small_join, stored

PARTS, ENTRIES, ROUNDS, SCALE, BLOCK = 16, 64, 2, 256, 8192
#: Components are held within this bound (a million in thousands of units), so that errors fit in a long.
BOUND = 1 << 27
#: What rounding may add to a drift or a key.
SLACK = 1e-5
STATE = "ids array<bigint>, labels array<string>, points binary, width int, owners binary, sizes binary, keys binary, members binary, changes array<bigint>"
CODES = "vec_id long, label string, code string, error long"


def distances(x: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Squared distances of rows of x to the entries."""
    if max(np.abs(x).max(initial=0), np.abs(entries).max(initial=0)) < 1 << 20:
        a, b = x.astype(np.float64), entries.astype(np.float64)
        return ((a * a).sum(1)[:, None] - 2 * (a @ b.T) + (b * b).sum(1)).astype(np.int64)
    out = np.zeros((len(x), len(entries)), np.int64)
    for k in range(x.shape[1]):
        out += (x[:, k, None].astype(np.int64) - entries[None, :, k]) ** 2
    return out


def nearest(x: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest entry of each row, the first of several, and how much farther the second nearest is."""
    d = distances(x, entries)
    owner = d.argmin(1)
    if len(entries) == 1:
        return owner, np.full(len(x), np.inf)
    two = np.sqrt(np.partition(d, 1, 1)[:, :2].astype(np.float64))
    return owner, two[:, 1] - two[:, 0]


def rounded_down(keys: np.ndarray) -> np.ndarray:
    return np.nextafter(keys.astype(np.float32), np.float32(-np.inf))


class Block:
    """Vectors of one task's block with the heaps of their parts.

    points: (vectors, positions, components of a part); owners: the entry of each part; heaps[position][entry]: keys and
    members in the order of a heap, as two arrays, or as a list of pairs where this round has touched it."""

    def __init__(self, points: np.ndarray, owners: np.ndarray, heaps: list[list]):
        self.points, self.owners, self.heaps, self.scanned = points, owners, heaps, 0

    @classmethod
    def assigned(cls, points: np.ndarray, codebooks: np.ndarray) -> Block:
        """Every part scanned; a sorted heap is one."""
        owners, heaps = np.zeros(points.shape[:2], np.uint16), []
        for p, entries in enumerate(codebooks):
            owner, gap = nearest(points[:, p], entries)
            order = np.lexsort((gap, owner))
            cuts = np.searchsorted(owner[order], np.arange(len(entries) + 1))
            keys = rounded_down(gap)
            heaps.append([(keys[order[lo:hi]], order[lo:hi].astype(np.uint32)) for lo, hi in zip(cuts, cuts[1:], strict=False)])
            owners[:, p] = owner
        return cls(points, owners, heaps)

    def heap(self, p: int, e: int) -> list:
        h = self.heaps[p][e]
        if isinstance(h, tuple):
            h = self.heaps[p][e] = list(zip(h[0].tolist(), h[1].tolist(), strict=True))
        return h

    def violated(self, p: int, drift: np.ndarray) -> list[int]:
        """Pop the members of a position whose keys the entries' drift has reached."""
        out = []
        for e, reached in enumerate(drift + SLACK):
            first = self.heaps[p][e][:1]  # the top pair, or all keys
            if not len(first) or not len(first[0]) or first[0][0] > reached:
                continue
            h = self.heap(p, e)
            while h and h[0][0] <= reached:
                out.append(heapq.heappop(h)[1])
        return out

    def reassign(self, codebooks: np.ndarray, drift: np.ndarray, changes: Changes) -> None:
        """Scan what the drift (positions, entries) has violated; what moves is noted in `changes`."""
        for p, entries in enumerate(codebooks):
            members = np.array(self.violated(p, drift[p]), np.int64)
            if not len(members):
                continue
            self.scanned += len(members)
            x = self.points[members, p]
            owner, gap = nearest(x, entries)
            old = self.owners[members, p].astype(np.int64)
            changes.add(p, x[owner != old], owner[owner != old], 1)
            changes.add(p, x[owner != old], old[owner != old], -1)
            self.owners[members, p] = owner
            keys = rounded_down(gap + drift[p, owner])
            for e, key, m in zip(owner.tolist(), keys.tolist(), members.tolist(), strict=True):
                heapq.heappush(self.heap(p, e), (key, m))

    def errors(self, codebooks: np.ndarray) -> np.ndarray:
        """Exact squared distances to the assigned entries, summed over a vector's parts."""
        out = np.zeros(len(self.points), np.int64)
        for p, entries in enumerate(codebooks):
            out += ((self.points[:, p].astype(np.int64) - entries[self.owners[:, p]]) ** 2).sum(1)
        return out

    def packed(self) -> dict:
        flat = [(np.array([k for k, _ in h], np.float32), np.array([m for _, m in h], np.uint32)) if isinstance(h, list) else h for row in self.heaps for h in row]
        narrow = np.abs(self.points).max(initial=0) < 1 << 15
        return {
            "points": self.points.astype(np.int16 if narrow else np.int32).tobytes(),
            "width": 2 if narrow else 4,
            "owners": self.owners.tobytes(),
            "sizes": np.array([len(k) for k, _ in flat], np.uint32).tobytes(),
            "keys": np.concatenate([k for k, _ in flat]).tobytes(),
            "members": np.concatenate([m for _, m in flat]).tobytes(),
        }

    @classmethod
    def unpacked(cls, row: dict, codebooks: np.ndarray) -> Block:
        parts, entries, size = codebooks.shape
        points = np.frombuffer(row["points"], np.int16 if row["width"] == 2 else np.int32).astype(np.int32).reshape(-1, parts, size)
        cuts = np.concatenate([[0], np.cumsum(np.frombuffer(row["sizes"], np.uint32).astype(np.int64))])
        keys, members = np.frombuffer(row["keys"], np.float32), np.frombuffer(row["members"], np.uint32)
        heaps = [[(keys[cuts[p * entries + e] : cuts[p * entries + e + 1]], members[cuts[p * entries + e] : cuts[p * entries + e + 1]]) for e in range(entries)] for p in range(parts)]
        return cls(points, np.frombuffer(row["owners"], np.uint16).reshape(-1, parts).copy(), heaps)


class Changes:
    """By how much the sums and counts of the entries change."""

    def __init__(self, shape: tuple[int, int, int]):
        self.sums, self.counts = np.zeros(shape, np.int64), np.zeros(shape[:2], np.int64)

    def add(self, p: int, x: np.ndarray, owner: np.ndarray, sign: int) -> None:
        np.add.at(self.sums[p], owner, sign * x.astype(np.int64))
        self.counts[p] += sign * np.bincount(owner, minlength=self.counts.shape[1])

    def row(self) -> list[int]:
        return np.concatenate([self.sums.ravel(), self.counts.ravel()]).tolist()


def kept(embeddings: DataFrame, parts: int = PARTS) -> DataFrame:
    """vec_id, label (as text), embedding of the rows whose vector is whole: not null, of finite components only."""
    x = F.col("embedding")
    bad = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    rows = embeddings.where(x.isNotNull() & ~bad & (F.size(x) > 0) & (F.size(x) % parts == 0))
    return rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), x.cast("array<double>").alias("embedding"))


def integers(vectors: np.ndarray, parts: int, scale: int) -> np.ndarray:
    return np.clip(np.floor(scale * vectors), -BOUND, BOUND).astype(np.int32).reshape(len(vectors), parts, -1)


def state_batch(rows: list[dict]) -> pa.RecordBatch:
    kinds = {"ids": pa.list_(pa.int64()), "labels": pa.list_(pa.string()), "width": pa.int32(), "changes": pa.list_(pa.int64())}
    names = [f.split(" ")[0] for f in STATE.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r.get(n) for r in rows], kinds.get(n, pa.binary())) for n in names], names)


def rows_of(batches):
    """One block at a time."""
    for batch in batches:
        for k in range(batch.num_rows):
            yield batch.slice(k, 1).to_pylist()[0]


def first_round(vectors: DataFrame, codebooks: np.ndarray, scale: int, block: int) -> DataFrame:
    """Blocks of all vectors, every part assigned, and a row of changes from each task."""

    def run(batches):
        changes, held, n = Changes(codebooks.shape), [], 0

        def blocks(least):
            nonlocal held, n
            while n >= least:
                table = pa.Table.from_batches(held)
                ids, labels, x = (c.combine_chunks() for c in table.slice(0, block).columns)
                held, n = table.slice(block).to_batches(), max(0, n - block)
                points = integers(x.flatten().to_numpy(zero_copy_only=False).reshape(len(x), -1), len(codebooks), scale)
                made = Block.assigned(points, codebooks)
                for p in range(len(codebooks)):
                    changes.add(p, points[:, p], made.owners[:, p].astype(np.int64), 1)
                yield state_batch([{"ids": ids.to_pylist(), "labels": labels.to_pylist(), **made.packed()}])

        for batch in batches:
            held, n = [*held, batch], n + batch.num_rows
            yield from blocks(block)
        yield from blocks(1)
        yield state_batch([{"changes": changes.row()}])

    return vectors.mapInArrow(run, STATE)


def next_round(state: DataFrame, codebooks: np.ndarray, drift: np.ndarray) -> DataFrame:
    """The blocks after the entries moved, and a row of changes from each task."""

    def run(batches):
        changes = Changes(codebooks.shape)
        for row in rows_of(batches):
            made = Block.unpacked(row, codebooks)
            made.reassign(codebooks, drift, changes)
            yield state_batch([{"ids": row["ids"], "labels": row["labels"], **made.packed()}])
        yield state_batch([{"changes": changes.row()}])

    return state.where("changes is null").mapInArrow(run, STATE)


def last_round(state: DataFrame, codebooks: np.ndarray, drift: np.ndarray) -> DataFrame:
    """vec_id, label, code, error after the last assignment."""

    def run(batches):
        for row in rows_of(batches):
            made = Block.unpacked(row, codebooks)
            made.reassign(codebooks, drift, Changes(codebooks.shape))
            codes = ["".join(f"{e:02x}" for e in r) for r in made.owners.tolist()]
            yield pa.RecordBatch.from_arrays([pa.array(row["ids"], pa.int64()), pa.array(row["labels"], pa.string()), pa.array(codes, pa.string()), pa.array(made.errors(codebooks))], ["vec_id", "label", "code", "error"])

    return state.where("changes is null").mapInArrow(run, CODES)


def total(state: DataFrame, shape: tuple[int, int, int]) -> Changes:
    """The sum of all tasks' changes: a row for each component of the codebooks reaches the driver."""
    rows = state.where("changes is not null").select(F.posexplode("changes").alias("at", "x")).groupBy("at").agg(F.sum("x").alias("x")).collect()
    out, flat = Changes(shape), np.zeros(np.prod(shape) + shape[0] * shape[1], np.int64)
    for at, x in rows:
        flat[at] = x
    out.sums, out.counts = flat[: np.prod(shape)].reshape(shape), flat[np.prod(shape) :].reshape(shape[:2])
    return out


def drifts(before: np.ndarray, after: np.ndarray) -> np.ndarray:
    """By entry: how far it moved, and how far any other of its codebook did at most."""
    moved = np.sqrt(((after - before).astype(np.float64) ** 2).sum(2))
    order = np.sort(moved, 1)
    second = order[:, -2:-1] if moved.shape[1] > 1 else np.zeros((len(moved), 1))
    return moved + np.where(moved == order[:, -1:], second, order[:, -1:])


def compress(embeddings: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE, block: int = BLOCK) -> tuple[DataFrame, np.ndarray]:
    """Rows of vec_id, label, code, error, and the codebooks (parts, entries, components of a part).

    The codebooks begin as the parts of the `entries` smallest vec_ids (null ids last, repeated ones by their vectors);
    of fewer vectors, there are as many entries. Vectors that are null, not finite, not of whole parts or not as long
    as that of the smallest vec_id are dropped; components beyond BOUND / scale count as that. Rows that repeat a
    vec_id each get their code. An empty table gives no rows and codebooks without entries."""
    spark = embeddings.sparkSession
    prepare(spark)
    rows = kept(embeddings, parts)
    first = [r.embedding for r in rows.orderBy(F.asc_nulls_last("vec_id"), "embedding").limit(entries).collect()]
    if not first:
        return spark.createDataFrame([], CODES), np.zeros((parts, 0, 0), np.int64)
    rows = rows.where(F.size("embedding") == len(first[0]))
    first = np.array([v for v in first if len(v) == len(first[0])])
    codebooks = integers(first, parts, scale).transpose(1, 0, 2).astype(np.int64)
    drift, sums = np.zeros(codebooks.shape[:2]), Changes(codebooks.shape)
    state = stored(first_round(rows, codebooks, scale, block), "codes-0")
    for k in range(rounds):
        new = total(state, codebooks.shape)
        sums.sums, sums.counts = sums.sums + new.sums, sums.counts + new.counts
        used = sums.counts[:, :, None]
        after = np.where(used > 0, sums.sums // np.maximum(used, 1), codebooks)
        drift, codebooks = drift + drifts(codebooks, after), after
        state = stored((next_round if k + 1 < rounds else last_round)(state, codebooks, drift), f"codes-{k + 1}")
    return state, codebooks


def codebooks_sha256(codebooks: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, codebooks.ravel().tolist())).encode()).hexdigest()


def vector_codes(embeddings: DataFrame) -> DataFrame:
    """vec_id, code, error, label_error (the errors of all rows of that label, nulls together), codebooks_sha256."""
    codes, codebooks = compress(embeddings)
    codes = codes.withColumn("key", F.coalesce(F.concat(F.lit("="), "label"), F.lit("")))
    totals = stored(codes.groupBy("key").agg(F.sum("error").alias("label_error")), "label-errors")
    out = small_join(codes, totals, ["key"], totals.count())
    return out.select("vec_id", "code", "error", "label_error", F.lit(codebooks_sha256(codebooks)).alias("codebooks_sha256"))
