"""Frequency baselines: how often was this seen, and how rare is it therefore?"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ladders import KEYS, KINDS, READ_KINDS

ALPHA = 0.5
#: Keys of a profile up to which it is broadcast.
FEW = 200_000


def counts(events: DataFrame) -> DataFrame:
    """(kind, key, n, first_seen) of events with their key columns: one pass and one grouping for all kinds."""
    pairs = F.array(*(F.struct(F.lit(k).alias("kind"), F.col(c).alias("key")) for k, (c, _) in zip(KINDS, KEYS, strict=True)))
    rows = events.select("ordinal", F.explode(pairs).alias("p")).where("p.key is not null")
    return rows.groupBy("p.kind", "p.key").agg(F.count("*").alias("n"), F.min("ordinal").alias("first_seen"))


def totals(profile: DataFrame) -> DataFrame:
    """(kind, total, cardinality)."""
    return profile.groupBy("kind").agg(F.sum("n").alias("total"), F.count("*").alias("cardinality"))


def top_keys(profile: DataFrame, most: int = 5000) -> DataFrame:
    """The most frequent keys of each kind; of equally frequent ones those first seen."""
    w = Window.partitionBy("kind").orderBy(F.desc("n"), "first_seen")
    return profile.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most)


def frequency(profile: DataFrame, asked: DataFrame) -> DataFrame:
    """How often each asked (kind, key) was seen: `n`, 0 where it is unknown or null."""
    return asked.join(profile.select("kind", "key", "n"), ["kind", "key"], "left").na.fill(0, ["n"])


def rarity(n: Column, total: Column, cardinality: Column) -> Column:
    """Smoothed surprise between 0 (always) and 1 (never seen)."""
    weight = total + ALPHA * (cardinality + 1)
    top = -F.log(F.lit(ALPHA) / weight)
    seen = -F.log((n + ALPHA) / weight)
    return F.when(top <= 0, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), seen / top)))


def with_rarity(events: DataFrame, profile: DataFrame, kept: DataFrame | None = None, sums: DataFrame | None = None) -> DataFrame:
    """Adds rarity_<kind> of the five kinds that features read. `kept`: the keys to look up (all of `profile` unless a
    capped one is given, whose cardinality then counts). `sums`: kind, total, cardinality, where they are known apart from
    the keys. Null keys and empty tables give one half."""
    look = profile if kept is None else kept
    if sums is None:
        sums = profile.groupBy("kind").agg(F.sum("n").alias("total")).join(look.groupBy("kind").agg(F.count("*").alias("cardinality")), "kind")
    known = {r.kind: (r.total, r.cardinality) for r in sums.select("kind", "total", "cardinality").collect()}  # one row a kind
    small = look.limit(FEW + 1).count() <= FEW if kept is not None else sum(c for _, c in known.values()) <= FEW
    for kind, (column, _) in zip(KINDS, KEYS, strict=True):
        if kind not in READ_KINDS:
            continue
        if kind not in known:
            events = events.withColumn(f"rarity_{kind}", F.lit(0.5))
            continue
        side = look.where(F.col("kind") == kind).select(F.col("key").alias(column), F.col("n").alias("__n"))
        events = events.join(F.broadcast(side) if small else side, column, "left")
        total, cardinality = known[kind]
        value = rarity(F.coalesce("__n", F.lit(0)), F.lit(total), F.lit(cardinality))
        events = events.withColumn(f"rarity_{kind}", F.when(F.col(column).isNull(), 0.5).otherwise(value)).drop("__n")
    return events
