"""Document fingerprints by consistent weighted sampling.

A text's terms are its runs of five words (all its words, if fewer), weighted by how often they occur. For each slot
and term, r and c are Gamma(2,1) and beta is uniform, all drawn from a hash of term and slot; with
t = floor(ln w / r + beta) the term of the least ln c - r (t - beta) - r is sampled together with t. Two texts sample
the same pair with a probability equal to their generalised Jaccard similarity, so the share of equal slots
estimates it. A slot keeps 16 bits. Texts without words have an all-zero fingerprint, like each other and like
nothing else.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._shared import prepare, some, stored, text_bytes
from .shingles import M1, M2, M3, U, mix, terms

SLOTS = 64
#: Bytes of text in a range of ids, and ranges at most (they are read as streams).
RANGE_BYTES, MOST_RANGES = 4_000_000, 16_384
SEEDS = (np.arange(1, SLOTS + 1, dtype=np.uint64) * M3) ^ (np.arange(1, SLOTS + 1, dtype=np.uint64) << U(17))
LOWEST = np.iinfo(np.int64).min


def sampled(sets: list[tuple[np.ndarray, np.ndarray]], chunk: int = 2048) -> np.ndarray:
    """The signatures (uint16, one row each) of several weighted term sets; a (term, weight) that they share is
    evaluated once."""
    keys = np.concatenate([k for k, _ in sets])
    weights = np.concatenate([w for _, w in sets]).astype(np.int64)
    owner = np.repeat(np.arange(len(sets)), [len(k) for k, _ in sets])
    order = np.lexsort((weights, keys))
    k, w = keys[order], weights[order]
    new = np.ones(len(k), bool)
    new[1:] = (k[1:] != k[:-1]) | (w[1:] != w[:-1])
    place = np.empty(len(k), np.int64)
    place[order] = np.cumsum(new) - 1
    k, w = k[new], np.log(w[new]).astype(np.float32)
    low = np.full((len(sets), SLOTS), np.inf, np.float32)
    out = np.zeros((len(sets), SLOTS), np.uint16)
    slot = np.arange(SLOTS)
    for at in range(0, len(k), chunk):
        x = mix(k[at : at + chunk, None] ^ SEEDS)
        y = (x ^ (x >> U(29))) * M3
        z = ((x * M2) ^ y) >> U(40)
        unit = lambda v: (v.astype(np.float32) + np.float32(0.5)) * np.float32(2.0**-32)
        r = -np.log(unit(x >> U(32)) * unit(x & U(0xFFFFFFFF)))
        c = -np.log(unit(y >> U(32)) * unit(y & U(0xFFFFFFFF)))
        beta = z.astype(np.float32) * np.float32(2.0**-24)
        t = np.floor(w[at : at + chunk, None] / r + beta)
        a = np.log(c) - r * (t - beta) - r
        for s in range(len(sets)):
            mine = place[owner == s]
            mine = mine[(mine >= at) & (mine < at + chunk)] - at
            if not len(mine):
                continue
            sub = a[mine]
            best = sub.argmin(0)
            value = sub[best, slot]
            better = value < low[s]
            who = mine[best]
            mark = mix(k[at + who] ^ (t[who, slot].astype(np.int64).view(np.uint64) * M1) ^ SEEDS)
            out[s, better] = (mark >> U(48)).astype(np.uint16)[better]
            low[s, better] = value[better]
    return out


def likeness(a: np.ndarray, b: np.ndarray, a_has: bool, b_has: bool) -> float:
    """The share of equal slots; 1 for two texts without words, 0 for one."""
    return float((a == b).mean()) if a_has and b_has else float(a_has == b_has)


def written(signature: np.ndarray) -> str:
    return signature.astype(">u2").tobytes().hex()


def fingerprint_column(text):
    """The fingerprint of a text column."""

    @F.pandas_udf("string")
    def fingerprint(texts: pd.Series) -> pd.Series:
        return pd.Series([written(sampled([terms(t or "")])[0]) for t in texts])

    return fingerprint(text)


def edited_text(text: str, after: str) -> str:
    """The last quarter (rounded down) replaced by as much of the start of the next text."""
    n = len(text) // 4
    return text[: len(text) - n] + after[:n]


def bucket_count(docs: DataFrame) -> int:
    """How many ranges of ids the texts are dealt over: one for about RANGE_BYTES, as far as MOST_RANGES."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return int(min(max(size // RANGE_BYTES, 7) + 1, MOST_RANGES))


def with_successor(docs: DataFrame, buckets: int) -> DataFrame:
    """Rows (bucket, mark, doc_id, text) in runs ordered by doc_id, then text: each bucket holds a range of ids and
    ends with a marked copy of the row that follows it (after the last: the first). One shuffle of the texts; ranges
    come from approximate quantiles, so they only affect balance. A null doc_id comes first. A bucket is read as a
    stream, so its size bounds no memory."""
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(LOWEST))
    rows = docs.select(key.alias("k"), F.col("doc_id").cast("long").alias("doc_id"), text_bytes().alias("text"))
    cuts = np.unique(docs.select(F.col("doc_id").cast("double").alias("k")).approxQuantile("k", [i / buckets for i in range(1, buckets)], 0.2 / buckets))

    @F.pandas_udf("int")
    def bucket(k: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(cuts, k.to_numpy(), side="right").astype(np.int32))

    rows = rows.withColumn("bucket", bucket("k"))
    heads = stored(rows.groupBy("bucket").agg(F.min("k").alias("k")), "heads", 1)  # one row a bucket
    order = Window.orderBy("bucket")
    before = heads.select("bucket", "k", F.coalesce(F.lag("bucket").over(order), F.max("bucket").over(Window.partitionBy(F.lit(0)))).alias("ahead"))
    first = rows.join(F.broadcast(before), ["bucket", "k"]).groupBy("ahead", "k", "doc_id").agg(F.min("text").alias("text"))
    ends = first.select(F.col("ahead").alias("bucket"), F.lit(1).alias("mark"), "k", "doc_id", "text")
    all_rows = rows.select("bucket", F.lit(0).alias("mark"), "k", "doc_id", "text").unionByName(ends)
    return all_rows.repartition(buckets, "bucket").sortWithinPartitions("bucket", "mark", "k", "text")


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    Null texts are empty; the only row's next document is itself; rows of one doc_id follow each other by text; an
    empty table gives no rows. Other columns are not read."""
    spark = docs.sparkSession
    prepare(spark)
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    kinds = ["long", "long", "string", "string", "string", "double", "double"]
    arrow = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]

    def run(batches):
        prev = wait = None  # the row whose successor isn't known; the row whose successor's fingerprint isn't

        for batch in some(batches):
            out = []
            for bucket, mark, _, doc_id, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                own = terms(text)
                if prev is not None:
                    i, t, mine = prev
                    edited = edited_text(t, text)
                    other = terms(edited)
                    sig, changed = sampled([mine, other])
                    if wait is not None:
                        out.append((*wait[0], likeness(wait[1], sig, wait[2], len(mine[0]) > 0)))
                    near = likeness(sig, changed, len(mine[0]) > 0, len(other[0]) > 0)
                    wait = ((i, len(t), hashlib.sha256(edited.encode()).hexdigest(), written(sig), written(changed), near), sig, len(mine[0]) > 0)
                if mark:
                    out.append((*wait[0], likeness(wait[1], sampled([own])[0], wait[2], len(own[0]) > 0)))
                    prev = wait = None
                else:
                    prev = (doc_id, text, own)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else [()] * 7, arrow, strict=True)], names)

    schema = ", ".join(f"{n} {k}" for n, k in zip(names, kinds, strict=True))
    return with_successor(docs, bucket_count(docs)).mapInArrow(run, schema)
