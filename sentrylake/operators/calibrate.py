"""Raw model scores to percentiles, anomaly scores, labels and confidences."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..config import ANOMALY_THRESHOLD
from ..plans.session import stored

POINTS = 1001


@dataclass(frozen=True)
class Calibration:
    """A sketch of the training scores: evenly spaced quantiles, population deviation, offset."""

    quantiles: tuple[float, ...]
    mean: float
    std: float
    n: int
    offset: float = -0.5


def fit(scores: DataFrame, column: str, points: int = POINTS, offset: float = -0.5) -> Calibration:
    """Interpolated quantiles of scores at nine decimals, so that equal scores stay equal.

    Distinct scores are counted, sorted by range over the partitions and numbered by a prefix sum of the partitions'
    counts; only the scores at the sketch's places come to the driver, two of each."""
    rows = scores.select(F.round(column, 9).alias("s")).where("s is not null")
    n, mean, std = rows.agg(F.count("s"), F.avg("s"), F.stddev_pop("s")).first()
    if not n:
        return Calibration((), 0.0, 1.0, 0, offset)
    if n == 1:
        return Calibration((float(rows.first().s),) * points, mean, 1.0, 1, offset)
    laid = stored(rows.groupBy("s").agg(F.count("*").alias("k")).repartitionByRange("s").withColumn("pid", F.spark_partition_id()), "scores")
    sizes = laid.groupBy("pid").agg(F.sum("k").alias("n"))  # one row a partition
    before = sizes.select("pid", (F.sum("n").over(Window.orderBy("pid")) - F.col("n")).alias("before"))
    upto = F.col("before") + F.sum("k").over(Window.partitionBy("pid").orderBy("s").rowsBetween(Window.unboundedPreceding, 0))
    ranked = laid.join(F.broadcast(before), "pid").withColumn("upto", upto)
    # point i lies at place i (n - 1) / (points - 1); a score at the places [low, high) is asked for by the points from
    # the one whose place, or the next, is low to the last one below high
    low, high, steps, last = F.col("upto") - F.col("k"), F.col("upto"), F.lit(points - 1), F.lit(n - 1)
    first_i = F.greatest(F.lit(0), F.call_function("div", (low - 1) * steps + last - 1, last))
    last_i = F.least(steps, F.call_function("div", high * steps - 1, last))
    point = ranked.withColumn("a", first_i).withColumn("b", last_i).where("a <= b").select("s", low.alias("low"), high.alias("high"), F.explode(F.sequence("a", "b")).alias("i"))
    place = F.call_function("div", F.col("i") * last, steps)
    found = point.select("s", "low", "high", F.explode(F.array(place, place + 1)).alias("p")).where("p >= low and p < high")
    at = {r.p: r.s for r in found.select("p", "s").distinct().collect()}  # two places a point at most
    places = [divmod(i * (n - 1), points - 1) for i in range(points)]  # the place below, and how far on to the next
    between = lambda a, b, share: a + (b - a) * share
    quantiles = (round(between(at[low], at[low + (rest > 0)], rest / (points - 1)), 9) for low, rest in places)
    return Calibration(tuple(quantiles), mean, std or 1.0, n, offset)


#: Size of a score sketch; its ranks are then off by SKETCH_ERROR at most, in 99 of 100 sketches.
SKETCH = 16_384
SKETCH_ERROR = 2.296 / SKETCH**0.9021
STATE = "n long, mean double, m2 double, least double, most double, sketch binary"


def sketch(scores: DataFrame, column: str, size: int = SKETCH) -> DataFrame:
    """One row of STATE: what a batch of scores adds to a calibration. A KLL sketch and moments, made in each task and
    merged, so that no score is shuffled; null scores don't count."""
    s = F.round(F.col(column).cast("double"), 9)
    rows = scores.select(s.alias("s")).where("s is not null and not isnan(s)")
    m2 = F.coalesce(F.var_pop("s"), F.lit(0.0)) * F.count("s")
    return rows.agg(F.count("s").alias("n"), F.coalesce(F.avg("s"), F.lit(0.0)).alias("mean"), m2.alias("m2"), F.min("s").alias("least"), F.max("s").alias("most"), F.kll_sketch_agg_double("s", size).alias("sketch"))


def merged(states: DataFrame) -> DataFrame:
    """One row of STATE of many; batches without scores change nothing."""
    n, mean = F.sum("n"), F.sum(F.col("n") * F.col("mean")) / F.sum("n")
    square = F.sum(F.col("m2") + F.col("n") * F.col("mean") * F.col("mean"))
    return states.where("n > 0").agg(n.alias("n"), mean.alias("mean"), F.greatest(square - n * mean * mean, F.lit(0.0)).alias("m2"), F.min("least").alias("least"), F.max("most").alias("most"), F.kll_merge_agg_double("sketch").alias("sketch"))


def add_batch(scores: DataFrame, column: str, path: str, batch: int | str, size: int = SKETCH) -> None:
    """Keep a batch's state in a folder, under its number: a batch that comes again replaces itself."""
    sketch(scores, column, size).coalesce(1).write.mode("overwrite").parquet(f"{path}/batch={batch}")


def from_states(states: DataFrame, points: int = POINTS, offset: float = -0.5) -> Calibration:
    """The calibration of all merged states (`read_states`): the quantiles' ranks are off by SKETCH_ERROR at most."""
    ranks = F.array(*(F.lit(i / (points - 1)) for i in range(points)))
    row = merged(states).select("n", "mean", "m2", F.when(F.col("n") > 0, F.kll_sketch_get_quantile_double("sketch", ranks)).alias("q")).first()
    if not row.n:
        return Calibration((), 0.0, 1.0, 0, offset)
    return Calibration(tuple(row.q), row.mean, float(np.sqrt(row.m2 / row.n)) or 1.0, row.n, offset)


def read_states(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(STATE).parquet(path)


def percentile(score: Column, cal: Calibration) -> Column:
    """The share of the sketch at or below a score; one half without a sketch. A binary search over Arrow batches."""
    if not cal.quantiles:
        return F.lit(0.5)
    sketch = np.array(cal.quantiles)

    @F.pandas_udf("double")
    def share(scores: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(sketch, scores.to_numpy(float), side="right") / len(sketch)).where(scores.notna().to_numpy(), None)

    return share(F.round(score, 9))


def with_anomaly(rows: DataFrame, raw: str, cal: Calibration, threshold: float = ANOMALY_THRESHOLD) -> DataFrame:
    """Adds anomaly_score (1 - percentile, four decimals), prediction (-1 where it reaches the threshold before
    rounding) and confidence (logistic in the score's deviations)."""
    a = 1 - F.col("at.share")
    confidence = 1 / (1 + F.exp(F.lit(2.0) * F.col("row." + raw) / F.lit(cal.std or 1.0)))
    both = rows.select(F.struct("*").alias("row"), F.struct(percentile(F.col(raw), cal).alias("share")).alias("at"))
    return both.select("row.*", F.round(a, 4).alias("anomaly_score"), F.when(a >= threshold, -1).otherwise(1).alias("prediction"), F.round(confidence, 4).alias("confidence"))
