"""A frequency profile that grows batch by batch, in bounded room.

Of each kind, the `most` keys that were seen most are kept with their counts; totals are exact, and the number of distinct
keys is estimated by a mergeable sketch. A batch is counted by one grouping and joined to the kept keys; what is over
goes, and the kind's bound is raised to the largest count that went. So a key that is not kept was never seen more often
than the bound, and a kept key's count is exact unless it had gone before: then `error`, the bound when it came again, says
how many sightings may be missing. As long as no more than `most` keys of a kind are seen, all is exact.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..plans.session import Folder
from .baseline import counts

MOST = 5000
KEYS = "kind string, key string, n long, error long, first_seen long"
SUMS = "kind string, total long, bound long, sketch binary"
#: Groups that a kind's keys are ranked in first, so that no task ranks all of them.
SHARDS = 64


def folded(keys: DataFrame, sums: DataFrame, batch: DataFrame, most: int) -> tuple[DataFrame, DataFrame]:
    """The keys and sums after a batch of counted keys (kind, key, n, first_seen); the keys as candidates with `rank`."""
    new_sums = batch.groupBy("kind").agg(F.sum("n").alias("m"), F.hll_sketch_agg("key", F.lit(14)).alias("more"))
    both = sums.join(new_sums, "kind", "full")
    union = F.when(F.col("sketch").isNull(), F.col("more")).when(F.col("more").isNull(), F.col("sketch")).otherwise(F.hll_union("sketch", "more"))
    sums = both.select("kind", (F.coalesce("total", F.lit(0)) + F.coalesce("m", F.lit(0))).alias("total"), F.coalesce("bound", F.lit(0)).alias("bound"), union.alias("sketch"))
    found = keys.join(batch.select("kind", "key", F.col("n").alias("m"), F.col("first_seen").alias("came")), ["kind", "key"], "full")
    found = found.join(F.broadcast(sums.select("kind", "bound")), "kind")  # one row a kind
    n, seen = F.coalesce("n", F.lit(0)) + F.coalesce("m", F.lit(0)), F.least("first_seen", "came")
    rows = found.select("kind", "key", n.alias("n"), F.coalesce("error", "bound").alias("error"), seen.alias("first_seen"))
    order = [F.desc("n"), F.asc("first_seen"), F.asc("key")]
    shard = F.pmod(F.xxhash64("key"), F.lit(SHARDS))
    near = rows.withColumn("near", F.row_number().over(Window.partitionBy("kind", shard).orderBy(*order)))
    top = near.where(F.col("near") <= most).withColumn("rank", F.row_number().over(Window.partitionBy("kind").orderBy(*order)))
    return top.unionByName(near.where(F.col("near") > most).withColumn("rank", F.lit(most + 1))).drop("near"), sums


class Profile:
    """The profile in a folder: versions of its keys and sums, the last two of which stay."""

    def __init__(self, spark: SparkSession, path: str, most: int = MOST):
        self.spark, self.path, self.most, self.folder = spark, path.rstrip("/"), most, Folder(spark, path)

    def state(self) -> dict | None:
        text = self.folder.latest("current")
        return json.loads(text) if text else None

    def _tables(self, state: dict | None) -> tuple[DataFrame, DataFrame]:
        if state is None:
            return self.spark.createDataFrame([], KEYS), self.spark.createDataFrame([], SUMS)
        at = f"{self.path}/{state['version']}"
        return self.spark.read.schema(KEYS).parquet(f"{at}/keys"), self.spark.read.schema(SUMS).parquet(f"{at}/sums")

    def add(self, events: DataFrame, batch: int) -> bool:
        """Add a batch of events with their key columns; one whose number isn't above the last is known (False)."""
        return self.add_counts(counts(events), batch)

    def add_counts(self, batch_counts: DataFrame, batch: int) -> bool:
        state = self.state()
        if state is not None and batch <= state["batch"]:
            return False
        version = f"v-{batch:012d}-{uuid.uuid4().hex[:8]}"
        at = f"{self.path}/{version}"
        batch_counts.write.parquet(f"{at}/batch")
        rows, sums = folded(*self._tables(state), self.spark.read.schema("kind string, key string, n long, first_seen long").parquet(f"{at}/batch"), self.most)
        rows.write.parquet(f"{at}/ranked")
        ranked = self.spark.read.schema(f"{KEYS}, rank int").parquet(f"{at}/ranked")
        ranked.where(F.col("rank") <= self.most).drop("rank").coalesce(8).write.parquet(f"{at}/keys")  # `most` keys a kind
        gone = ranked.where(F.col("rank") > self.most).groupBy("kind").agg(F.max(F.col("n") + F.col("error")).alias("gone"))
        sums = sums.join(gone, "kind", "left").withColumn("bound", F.greatest("bound", F.coalesce("gone", F.lit(0)))).select("kind", "total", "bound", "sketch")
        sums.coalesce(1).write.parquet(f"{at}/sums")  # one row a kind
        for name in ("batch", "ranked"):
            self.folder.delete(f"{version}/{name}")
        self.folder.publish("current", json.dumps({"version": version, "batch": batch}))
        kept = {json.loads(self.folder.read(n))["version"] for n in self.folder.versions("current")}
        for name in self.folder.names():
            if name.startswith("v-") and name not in kept and name < version:
                self.folder.delete(name)
        return True

    def keys(self) -> DataFrame:
        """kind, key, n, error, first_seen."""
        return self._tables(self.state())[0]

    def sums(self) -> DataFrame:
        """kind, total, cardinality (an estimate), bound (no key that isn't kept was seen more often)."""
        return self._tables(self.state())[1].select("kind", "total", F.hll_sketch_estimate("sketch").alias("cardinality"), "bound")
