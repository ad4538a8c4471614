"""Distribution reports over alert rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as X

ACTIONABLE = 20


def top_values(rows: DataFrame, column: str, most: int = 40) -> DataFrame:
    """The most frequent values with their share of all rows; equally frequent ones by value."""
    total = rows.agg(F.count("*").alias("total"))
    top = rows.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("n")).orderBy(F.desc("n"), column).limit(most)
    return top.join(F.broadcast(total)).select(column, "n", F.round(F.col("n") / F.col("total"), 6).alias("share"))  # one row


def number_stats(rows: DataFrame, *columns: str) -> DataFrame:
    """count, min, avg, max of each column, a row each."""
    pairs = F.array(*(F.struct(F.lit(c).alias("field"), F.col(c).cast("double").alias("v")) for c in columns))
    long = rows.select(F.explode(pairs).alias("p")).select("p.*")
    return long.groupBy("field").agg(F.count("v").alias("n"), F.round(F.min("v"), 6).alias("least"), F.round(F.avg("v"), 6).alias("mean"), F.round(F.max("v"), 6).alias("most"))


def actionable(alerts: DataFrame, most: int = 40) -> DataFrame:
    return top_values(alerts.where(F.col("risk_score") >= ACTIONABLE), "risk_score", most)


def histogram(rows: DataFrame, column: str, width: float = 0.1) -> DataFrame:
    """Fixed-width bins by number, gaps included; 32-bit values are widened as they are."""
    found = rows.where(F.col(column).isNotNull()).groupBy(F.floor(F.col(column).cast("double") / F.lit(width)).cast("bigint").alias("bin")).agg(F.count("*").alias("n"))
    span = found.agg(F.min("bin").alias("lo"), F.max("bin").alias("hi")).where("lo is not null")
    return span.select(F.explode(F.sequence("lo", "hi")).alias("bin")).join(found, "bin", "left").select("bin", F.round(F.col("bin") * width, 6).alias("low"), F.coalesce("n", F.lit(0)).alias("n"))


def spread(alerts: DataFrame) -> DataFrame:
    """One row: actionable alerts, distinct scores, the share of the most common score."""
    per = alerts.where(F.col("risk_score") >= ACTIONABLE).groupBy("risk_score").agg(F.count("*").alias("n"))
    return per.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("actionable"), F.count("*").alias("distinct_scores"), F.round(F.coalesce(F.try_divide(F.max("n"), F.sum("n")), F.lit(0.0)), 6).alias("top_share"))


def check_spread(alerts: DataFrame, most: float) -> bool:
    """Whether no score holds more than `most` of the actionable alerts."""
    return spread(alerts).first().top_share <= most


def as_text(alerts: DataFrame, width: int = 30) -> str:
    """A report to read: numbers, severities, the most common scores with bars, techniques. Its parts are short."""
    out = [f"{'field':<16}{'n':>10}{'least':>10}{'mean':>10}{'most':>10}"]
    number = lambda v: "-" if v is None else f"{v:.2f}"
    out += [f"{r.field:<16}{r.n:>10}{number(r.least):>10}{number(r.mean):>10}{number(r.most):>10}" for r in number_stats(alerts, "risk_score", "anomaly_score").orderBy("field").collect()]
    for title, rows in (("severity", top_values(alerts, "severity", 10)), ("risk_score", actionable(alerts))):
        out += ["", title]
        found = rows.orderBy(F.desc("n"), title).withColumn("bar", X.bar(F.col("share"), width)).collect()
        out += [f"{r[title]!s:<16}{r.n:>10}{100 * r.share:>8.1f} % {r.bar}" for r in found]
    s = spread(alerts).first()
    out += ["", f"actionable {s.actionable}, distinct scores {s.distinct_scores}, share of the most common {100 * s.top_share:.1f} %", "", "technique"]
    out += [f"{r.technique_id:<16}{r.n:>10}" for r in technique_counts(alerts).orderBy(F.desc("n"), "technique_id").collect()]
    return "\n".join(out) + "\n"


def technique_counts(alerts: DataFrame, field: str = "technique_id", most: int = 15) -> DataFrame:
    tags = alerts.select("alert_id", F.explode("mitre").alias("m")).select("alert_id", F.col(f"m.{field}").alias(field))
    return tags.groupBy(field).agg(F.count_distinct("alert_id").alias("n")).orderBy(F.desc("n"), field).limit(most)
