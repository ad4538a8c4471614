"""Best-fit packing with swap-based local search.

Documents become token ids followed by a separator; longer ones than a sequence are cut into full pieces, the first
piece taking what is over. Full pieces are sequences of their own. The others are packed in rounds of shards of
about SHARD pieces each, dealt by a hash: a shard is packed best fit, longest first; then local search raises the
sum of squared fills: the fullest bins that still have room take a piece from the emptiest bins (a move), exchange a
piece for a longer one (one for one) or for two that are longer together (two for one), and what is left of the
emptiest bins is packed again, from more and more of the bins, until no bin empties. Full bins are closed; the pieces
of the others go to the next round, dealt anew over as few shards as they need. The rounds end with a single shard,
or with one that makes no fewer sequences of its pieces than they had.
"""

from __future__ import annotations

import bisect
import json
import re
import zlib
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .byte_bpe import ByteBpe
from .token_counts import byte_letters
from ._shared import groups, prepare, some, stored, text_bytes

CAPACITY, SHARD = 2048, 16_384
#: Words kept with their ids by a worker.
KEPT = 300_000


class TokenIds:
    """A byte-level `tokenizers` file's ids, as bytes of little-endian unsigned 32-bit numbers.

    Words between spaces are encoded once and kept: the pattern never matches across the boundary between a
    character that isn't white space and a space that is followed by another."""

    def __init__(self, path: str, pattern: str):
        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        letters = byte_letters()
        self.bpe = ByteBpe({bytes(letters[c] for c in t): i for t, i in file["model"]["vocab"].items()}, pattern)
        made = [file["model"]["vocab"]["".join(m.split(" ") if isinstance(m, str) else m)] for m in file["model"]["merges"]]
        if file["pre_tokenizer"]["type"] != "ByteLevel" or file["normalizer"] is not None or any(a >= b for a, b in zip(made, made[1:], strict=False)):
            raise ValueError(f"{path}: its ids are not those of byte-level merges in the order of their ranks")
        self.special = {a["content"]: a["id"] for a in file["added_tokens"]}
        names = sorted(self.special, key=len, reverse=True)  # the first to begin counts, and of those the longest
        self.names = re.compile("|".join(map(re.escape, names)) or r"(?!)")
        self.kept: dict[str, bytes] = {}

    def plain(self, text: str) -> bytes:
        return array("I", self.bpe.encode(text)).tobytes()

    def part(self, text: str) -> bytes:
        first, *words = text.split(" ")
        if not words or first and first[-1].isspace():
            return self.plain(text)
        last = words.pop()
        if not last or last[0].isspace():
            return self.plain(text)
        kept = self.kept
        found = list(map(kept.get, words))
        if None in found:
            if len(kept) > KEPT:
                kept.clear()
            for k, w in enumerate(words):
                if found[k] is None:
                    if not w or w[0].isspace() or w[-1].isspace():
                        return self.plain(text)
                    found[k] = kept[w] = self.plain(" " + w)
        return b"".join((self.plain(first), *found, self.plain(" " + last)))

    def __call__(self, text: str) -> bytes:
        """The ids of the text; a special token's string in it is that token, the library's default."""
        if not any(name in text for name in self.special):
            return self.part(text)
        out, at = [], 0
        for m in self.names.finditer(text):
            out += [self.part(text[at : m.start()]), array("I", [self.special[m.group()]]).tobytes()]
            at = m.end()
        return b"".join((*out, self.part(text[at:])))


@lru_cache(maxsize=2)
def load(path: str, pattern: str) -> TokenIds:
    return TokenIds(path, pattern)


def pieces(docs: DataFrame, path: str, pattern: str, separator: int = 0, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every document's pieces."""
    prepare(docs.sparkSession)

    def run(batches):
        ids = load(path, pattern)
        end = array("I", [separator]).tobytes()
        for batch in some(batches):
            rows = []
            for doc_id, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                b = ids(text) + end
                n = len(b) // 4
                cuts = [0, *range(n % capacity or capacity, n + 1, capacity)]
                rows += [(doc_id, k, lo, hi - lo, zlib.crc32(b[4 * lo : 4 * hi])) for k, (lo, hi) in enumerate(zip(cuts, cuts[1:], strict=False))]
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True) if rows else [()] * 5, kinds, strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes().alias("text")).mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def best_fit(items: list[tuple[int, int]], capacity: int) -> list[list[tuple[int, int]]]:
    """Bins of (length, item), each item put where the least room is left."""
    rooms: list[tuple[int, int]] = []
    bins: list[list[tuple[int, int]]] = []
    for length, item in sorted(items, reverse=True):
        at = bisect.bisect_left(rooms, (length, -1))
        if at == len(rooms):
            bins.append([(length, item)])
            room, b = capacity - length, len(bins) - 1
        else:
            room, b = rooms.pop(at)
            bins[b].append((length, item))
            room -= length
        if room:
            bisect.insort(rooms, (room, b))
    return bins


class Search:
    """Local search between the bins with room: `full` bins receive, the pieces of the emptiest bins are the pool."""

    def __init__(self, pool: list[tuple[int, int]], capacity: int):
        self.capacity = capacity
        self.by = [[] for _ in range(capacity + 1)]
        self.count = np.zeros(capacity + 1, np.int32)
        for length, item in pool:
            self.put(length, item)

    def put(self, length: int, item: int) -> None:
        self.by[length].append(item)
        self.count[length] += 1

    def take(self, length: int) -> tuple[int, int]:
        self.count[length] -= 1
        return length, self.by[length].pop()

    def longest(self, low: int, high: int) -> int:
        """The greatest length in (low, high] that the pool has; 0 if none."""
        at = np.flatnonzero(self.count[low + 1 : high + 1])
        return int(at[-1]) + low + 1 if len(at) else 0

    def two(self, low: int, high: int) -> tuple[int, int] | None:
        """Two lengths of the pool with the greatest sum in (low, high]."""
        if high < 2:
            return None
        n = min(high, self.capacity + 1)
        place = np.arange(n)
        there = self.count[:n] > 0
        near = np.maximum.accumulate(np.where(there, place, 0))  # the greatest length up to each
        a = np.flatnonzero(there[: high // 2 + 1])  # the smaller of the two
        b = near[np.minimum(high - a, n - 1)]
        b = np.where((b == a) & (self.count[a] < 2), 0, b)
        total = np.where(b >= a, a + b, 0)
        if not len(a) or total.max() <= low:
            return None
        k = int(total.argmax())
        return int(a[k]), int(b[k])

    def fill(self, bin_: list[tuple[int, int]], room: int) -> int:
        """Improve one bin as long as an exchange gains; what is left of its room."""
        while room:
            best = (self.longest(0, room), None, ())  # a move
            for k, (x, _) in enumerate(bin_):
                if best[0] == room:
                    break
                if (y := self.longest(x, x + room)) and y - x > best[0]:
                    best = (y - x, k, (y,))
            if best[0] < room:
                for k, (x, _) in enumerate(bin_):
                    if (p := self.two(x + best[0], x + room)) and sum(p) - x > best[0]:
                        best = (sum(p) - x, k, p)
                        if best[0] == room:
                            break
            gain, k, new = best
            if not gain:
                break
            if k is None:
                bin_.append(self.take(gain))
            else:
                old = bin_.pop(k)
                bin_ += [self.take(y) for y in new]
                self.put(*old)
            room -= gain
        return room

    def pool(self) -> list[tuple[int, int]]:
        return [(length, i) for length in np.flatnonzero(self.count).tolist() for i in self.by[length]]


def packed(lengths: list[int], capacity: int = CAPACITY) -> list[list[tuple[int, int]]]:
    """Bins of (length, place in `lengths`)."""
    fill = lambda b: sum(n for n, _ in b)
    done, rest = [], best_fit([(n, i) for i, n in enumerate(lengths)], capacity)
    share = 0.1
    while share < 1:
        done += [b for b in rest if fill(b) == capacity]
        rest = sorted((b for b in rest if fill(b) < capacity), key=fill)
        need = -(-sum(map(fill, rest)) // capacity)
        if len(rest) <= need:
            break
        donors = max(1, min(len(rest) - 1, max(int(share * len(rest)), 2 * (len(rest) - need))))
        search = Search([x for b in rest[:donors] for x in b], capacity)
        kept = [list(b) for b in reversed(rest[donors:])]  # the fullest first
        for b in kept:
            search.fill(b, capacity - fill(b))
        again = kept + best_fit(search.pool(), capacity)
        if len(again) < len(rest):
            rest = again
        else:  # no bin emptied: open more bins
            share *= 1.5
    return done + rest


ROWS = "doc_id long, piece int, start long, length long, ids_crc32 long"
PLACED = f"{ROWS}, sequence_id long, offset long, open boolean"


def packing_round(rows: DataFrame, number: int, shards: int, capacity: int) -> DataFrame:
    def run(batches):
        for g in groups(batches, "shard"):
            g = g.combine_chunks()
            shard, lengths = g.column("shard")[0].as_py(), g.column("length").to_pylist()
            order, sequence, offset, is_open = [], [], [], []
            for k, b in enumerate(packed(lengths, capacity)):
                at, left = 0, capacity - sum(n for n, _ in b)
                for n, i in b:
                    order.append(i)
                    sequence.append(number << 56 | shard << 24 | k)
                    offset.append(at)
                    is_open.append(shards > 1 and left > 0)
                    at += n
            out = g.drop_columns(["shard"]).take(pa.array(order, pa.int64()))
            for name, v in (("sequence_id", pa.array(sequence, pa.int64())), ("offset", pa.array(offset, pa.int64())), ("open", pa.array(is_open))):
                out = out.append_column(name, v)
            yield from out.to_batches()

    shard = F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32", F.lit(number)), F.lit(shards)).cast("long")
    dealt = rows.withColumn("shard", shard).repartition(shards, "shard").sortWithinPartitions("shard", "length", "doc_id", "piece", "ids_crc32")
    return dealt.mapInArrow(run, PLACED)


def pack(docs: DataFrame, path: str, pattern: str, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece.

    A null or empty text is the separator alone; rows of one doc_id are packed each for itself; an empty table gives
    no rows. Texts are read and encoded once; only lengths and check sums are shuffled."""
    rows = stored(pieces(docs, path, pattern, capacity=capacity), "pieces")
    whole = rows.where(F.col("length") == capacity).withColumn("sequence_id", -1 - F.monotonically_increasing_id()).withColumn("offset", F.lit(0).cast("long"))
    left, parts, number, before = rows.where(F.col("length") < capacity), [whole], 0, None
    sequences = lambda placed: placed.where("open").agg(F.count("*"), F.sum((F.col("offset") == 0).cast("long"))).first()
    n = left.count()
    while n:
        shards = -(-n // SHARD)
        placed = stored(packing_round(left, number, shards, capacity), f"packed-{number}")
        if before is not None:
            made = placed.where("offset = 0").count()
            if made >= before[1]:  # no sequence less than these pieces had: they stay as they were
                parts.append(before[0].where("open").drop("open"))
                break
        parts.append(placed.where("not open").drop("open"))
        n, some_open = sequences(placed)
        left, before, number = placed.where("open").drop("open", "sequence_id", "offset"), (placed, some_open), number + 1
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
