"""Queries over alert rows: filters, sort, pages, search and the fixed aggregates."""

from __future__ import annotations

import base64
import json
from dataclasses import dataclass
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from ..config import SEVERITIES
from ..functions import text as X
from .text_index import TextIndex

INTERVALS = {"5m": 300, "15m": 900, "1h": 3600, "3h": 10_800, "12h": 43_200, "1d": 86_400}
SORTS = {"risk_score": "risk_score", "detected_at": "scored_at", "event_time": "event_ts"}
RANGES = {"1h": 1, "6h": 6, "24h": 24, "7d": 168, "30d": 720}
WINDOW, MOST_ROWS, MOST_TECHNIQUES = 10_000, 100, 50


class BadQuery(ValueError):
    """A parameter that can't be used: a client's error."""


class NotFound(LookupError):
    """No alert of that id."""


@dataclass(frozen=True)
class AlertQuery:
    severities: tuple[str, ...] = ()
    least_risk: int | None = None
    most_risk: int | None = None
    least_anomaly: float | None = None
    anomalies_only: bool = False
    host: str | None = None
    user: str | None = None
    event_type: str | None = None
    technique: str | None = None
    since: datetime | None = None
    until: datetime | None = None
    text: str | None = None
    sort: str = "risk_score"
    descending: bool = True
    start: int = 0
    rows: int = 20

    def filters(self, text: bool = True) -> list[Column]:
        out: list[Column] = []
        if names := [s.strip().lower() for s in self.severities if s.strip()]:
            out.append(F.col("severity").isin(*names))
        if self.least_risk is not None:
            out.append(F.col("risk_score") >= self.least_risk)
        if self.most_risk is not None:
            out.append(F.col("risk_score") <= self.most_risk)
        if self.least_anomaly is not None:
            out.append(F.col("anomaly_score") >= F.lit(self.least_anomaly).cast("float"))
        if self.anomalies_only:
            out.append(F.col("prediction") == -1)
        if self.host:
            out.append(F.col("host") == self.host)
        if self.user:
            out.append((F.col("user_name") == self.user) | (F.col("audit_name") == self.user))
        if self.event_type:
            out.append(F.col("event_type") == self.event_type.upper())
        if self.technique:
            out.append(F.exists("mitre", lambda m: m["technique_id"] == self.technique))
        out += time_range(self.since, self.until)
        if self.text and text:
            out.append(matches(self.text, ("summary", "title", "command_line", "log.log_original", "log.log_message")))
        return out

    def run(self, alerts: DataFrame, index: TextIndex | None = None) -> DataFrame:
        """The hits; words are looked up in an index of the alerts' texts, if there is one."""
        if not self.text or index is None:
            return where_all(alerts, self.filters())
        hits = index.search(self.text).select(F.col("id").alias("alert_id"))
        return where_all(alerts, self.filters(text=False)).join(hits, "alert_id", "left_semi")

    def order(self) -> list[tuple[str, bool]]:
        """Columns and whether they descend; missing values are last."""
        return [(SORTS[self.sort], self.descending), ("scored_at", True), ("alert_id", False)]

    def page_after(self, alerts: DataFrame, token: str | None = None, index: TextIndex | None = None) -> tuple[list[Row], str | None]:
        """The next `rows` hits after the one that a token stands for (None: from the start), and the token of the last.
        However far it is, no hit before it is sorted or skipped, and hits that come or go meanwhile move no page."""
        hits = self.run(alerts, index)
        if token is not None:
            hits = hits.where(self.behind(token))
        keys = [F.col(c).desc_nulls_last() if down else F.col(c).asc_nulls_last() for c, down in self.order()]
        got = hits.orderBy(*keys).limit(self.rows).collect()  # a page
        return got, self.token(got[-1]) if len(got) == self.rows else None

    def token(self, row: Row) -> str:
        values = [row[c] for c, _ in self.order()]
        text = json.dumps([self.sort, self.descending, *(v.isoformat() if isinstance(v, datetime) else v for v in values)])
        return base64.urlsafe_b64encode(text.encode()).decode()

    def behind(self, token: str) -> Column:
        """Whether a hit lies behind a token's."""
        try:
            sort, down, *values = json.loads(base64.urlsafe_b64decode(token.encode()))
        except (ValueError, UnicodeEncodeError):
            raise BadQuery("the page token can't be read") from None
        if (sort, down) != (self.sort, self.descending) or len(values) != 3:
            raise BadQuery("the page token is of another order")
        out, same = F.lit(False), F.lit(True)
        for (name, falls), v in zip(self.order(), values, strict=True):
            value = F.lit(v).cast("timestamp") if name in ("scored_at", "event_ts") and v is not None else F.lit(v)
            column = F.col(name)
            if v is not None:
                out = out | (same & ((column < value if falls else column > value) | column.isNull()))
            same = same & column.eqNullSafe(value)
        return F.coalesce(out, F.lit(False))

    def page(self, alerts: DataFrame) -> tuple[int, DataFrame]:
        """(number of all hits, the page): missing sort values last, then the latest scored, then by id."""
        hits = self.run(alerts)
        return hits.count(), self.ordered(hits)

    def ordered(self, hits: DataFrame) -> DataFrame:
        key = F.col(SORTS[self.sort])
        key = key.desc_nulls_last() if self.descending else key.asc_nulls_last()
        return hits.orderBy(key, F.col("scored_at").desc_nulls_last(), "alert_id").offset(self.start).limit(self.rows)


def where_all(rows: DataFrame, filters: list[Column]) -> DataFrame:
    for f in filters:
        rows = rows.where(f)
    return rows


def time_range(since: datetime | None, until: datetime | None) -> list[Column]:
    """Both ends inclusive at whole seconds: the last second counts in full."""
    out = []
    if since:
        out.append(F.col("event_ts") >= F.lit(since.replace(microsecond=0)))
    if until:
        out.append(F.col("event_ts") < F.lit(until.replace(microsecond=0)) + F.expr("interval 1 second"))
    return out


def matches(query: str, fields: tuple[str, ...]) -> Column:
    """Any word of the query in any field."""
    words = X.search_tokens(F.lit(query))
    out = F.lit(False)
    for f in fields:
        out = out | F.arrays_overlap(X.search_tokens(F.col(f)), words)
    return out


def from_params(params: dict[str, str]) -> AlertQuery:
    """A validated query from text parameters; BadQuery names the one that is wrong."""

    def whole(name: str, low: int | None = None, high: int | None = None) -> int | None:
        if not (v := params.get(name, "").strip()):
            return None
        try:
            n = int(v)
        except ValueError:
            raise BadQuery(f"{name} is no whole number") from None
        if low is not None and n < low:
            raise BadQuery(f"{name} is under {low}")
        return min(n, high) if high is not None else n

    def when(name: str) -> datetime | None:
        if not (v := params.get(name, "").strip()):
            return None
        try:
            t = datetime.fromisoformat(v)
        except ValueError:
            raise BadQuery(f"{name} is no time") from None
        return t.astimezone(timezone.utc).replace(tzinfo=None) if t.tzinfo else t

    severities = tuple(s.strip().lower() for s in params.get("severity", "").split(",") if s.strip())
    if bad := set(severities) - set(SEVERITIES):
        raise BadQuery(f"no such severity: {', '.join(sorted(bad))}")
    sort, order = params.get("sort") or "risk_score", (params.get("order") or "desc").lower()
    if sort not in SORTS or order not in ("asc", "desc"):
        raise BadQuery("sort or order is unknown")
    anomaly = params.get("min_anomaly", "").strip()
    try:
        least = float(anomaly) if anomaly else None
    except ValueError:
        raise BadQuery("min_anomaly is no number") from None
    only = (params.get("anomalies_only") or "false").lower()
    if only not in ("true", "false", "1", "0"):
        raise BadQuery("anomalies_only is neither true nor false")
    rows, start = whole("size", 1, MOST_ROWS) or 20, whole("from", 0) or 0
    if start + rows > WINDOW:
        raise BadQuery(f"only the first {WINDOW} hits can be paged")
    return AlertQuery(
        severities, whole("min_risk"), whole("max_risk"), least, only in ("true", "1"), params.get("host") or None, params.get("user") or None, params.get("event_type") or None,
        params.get("technique") or None, when("from_time"), when("to_time"), params.get("q") or None, sort, order == "desc", start, rows,
    )


def get(alerts: DataFrame, alert_id: str) -> DataFrame:
    return alerts.where(F.col("alert_id") == alert_id)


def get_one(alerts: DataFrame, alert_id: str):
    row = get(alerts, alert_id).first()
    if row is None:
        raise NotFound(alert_id)
    return row


def stats(alerts: DataFrame, as_of: Column) -> DataFrame:
    """One row: totals, risk, and alerts scored in the last day before `as_of`."""
    return alerts.agg(
        F.count("*").alias("total"),
        F.count_if(F.col("prediction") == -1).alias("anomalies"),
        X.rounded(F.coalesce(F.avg("risk_score"), F.lit(0.0)), 1).alias("avg_risk"),
        F.coalesce(F.max("risk_score"), F.lit(0)).alias("max_risk"),
        F.count_if(F.col("scored_at") >= as_of - F.expr("interval 24 hours")).alias("last_day"),
    )


def severity_counts(alerts: DataFrame) -> DataFrame:
    """All five severities, the highest first by `place`, with shares."""
    names = alerts.sparkSession.createDataFrame(list(enumerate(SEVERITIES)), "place int, severity string")
    found = alerts.groupBy("severity").agg(F.count("*").alias("n"))
    total = alerts.agg(F.count("*").alias("total"))
    out = names.join(F.broadcast(found), "severity", "left").join(F.broadcast(total))  # one row
    return out.select("place", "severity", F.coalesce("n", F.lit(0)).alias("n"), X.rounded(F.coalesce(F.try_divide(F.coalesce("n", F.lit(0)) * 100.0, "total"), F.lit(0.0)), 1).alias("percent"))


def timeline(rows: DataFrame, interval: str, ts: str = "event_ts", **counts: Column) -> DataFrame:
    """Counts per interval (aligned to the epoch, UTC) from the first to the last, empty ones included."""
    if interval not in INTERVALS:
        raise BadQuery(f"interval is none of {', '.join(INTERVALS)}")
    step = INTERVALS[interval]
    rows = rows.where(F.col(ts).isNotNull())
    start = F.timestamp_seconds(F.floor(F.unix_seconds(F.col(ts).cast("timestamp")) / step) * step)
    found = rows.groupBy(start.alias("bucket")).agg(F.count("*").alias("total"), *(F.count_if(c).alias(n) for n, c in counts.items()))
    span = found.agg(F.min("bucket").alias("lo"), F.max("bucket").alias("hi")).where("lo is not null")
    calendar = span.select(F.explode(F.sequence("lo", "hi", F.expr(f"interval {step} seconds"))).alias("bucket"))
    return calendar.join(found, "bucket", "left").na.fill(0)


def anomaly_timeline(alerts: DataFrame, interval: str = "1h") -> DataFrame:
    return timeline(alerts, interval, anomalies=F.col("prediction") == -1, high=F.col("severity").isin("high", "critical"))


BANDS = ((0, 20, "0-19 informational"), (20, 40, "20-39 low"), (40, 60, "40-59 medium"), (60, 80, "60-79 high"), (80, 101, "80-100 critical"))


def bands(rows: DataFrame, value: str, ranges=BANDS) -> DataFrame:
    """Counts of half-open ranges (low, high, label), all of them."""
    names = rows.sparkSession.createDataFrame(list(ranges), "low int, high int, label string")
    label = F.coalesce(*(F.when((F.col(value) >= lo) & (F.col(value) < hi), F.lit(name)) for lo, hi, name in ranges))
    found = rows.groupBy(label.alias("label")).agg(F.count("*").alias("n")).where("label is not null")
    return names.join(F.broadcast(found), "label", "left").select("label", F.col("low").alias("from"), (F.col("high") - 1).alias("to"), F.coalesce("n", F.lit(0)).alias("n"))


def techniques(alerts: DataFrame, most: int = 20, since: datetime | None = None, until: datetime | None = None, flat: bool = False) -> DataFrame:
    """Techniques by the number of alerts that carry them: name, tactic, greatest confidence.

    `flat`: name, tactic and confidence come from all tags of those alerts, as in an index that flattens lists of
    objects: a technique that occurs beside this one can supply them."""
    if not 1 <= most <= MOST_TECHNIQUES:
        raise BadQuery(f"size is not between 1 and {MOST_TECHNIQUES}")
    rows = where_all(alerts.where(F.size("mitre") > 0), time_range(since, until)).select("alert_id", "mitre")
    tags = rows.select("alert_id", "mitre", F.explode("mitre").alias("m"))
    id_ = F.col("m.technique_id").alias("technique_id")
    counted = tags.groupBy(id_).agg(F.count_distinct("alert_id").alias("n"))
    top = counted.orderBy(F.desc("n"), "technique_id").limit(most)
    inner = tags.select(id_, "alert_id", F.explode("mitre").alias("x")) if flat else tags.select(id_, "alert_id", F.col("m").alias("x"))
    inner = inner.join(F.broadcast(top.select("technique_id")), "technique_id", "left_semi")  # at most MOST_TECHNIQUES rows

    def most_common(field: str) -> DataFrame:
        per = inner.groupBy("technique_id", F.col(f"x.{field}").alias("v")).agg(F.count_distinct("alert_id").alias("c"))
        return per.groupBy("technique_id").agg(F.min_by("v", F.struct(-F.col("c"), "v")).alias(field))

    strongest = inner.groupBy("technique_id").agg(X.rounded(F.max(F.col("x.confidence").cast("float").cast("double")), 2).alias("max_confidence"))
    return top.join(most_common("technique_name"), "technique_id").join(most_common("tactic"), "technique_id").join(strongest, "technique_id")


def legacy(alerts: DataFrame) -> DataFrame:
    """The earlier flat shape of an alert."""
    message = F.coalesce(*(F.nullif(F.col(c), F.lit("")) for c in ("command_line", "log.log_original", "log.log_message")), F.lit(""))
    return alerts.select(
        F.col("alert_id").alias("id"), F.col("event_ts").alias("timestamp"), F.col("host").alias("hostname"), F.coalesce("user_name", F.lit("")).alias("username"), F.coalesce("process_name", F.lit("")).alias("process"),
        message.alias("message"), "event_type", "risk_score", "severity", F.col("anomaly_score").alias("score"), (F.col("prediction") == -1).alias("is_anomaly"),
    )


def shown(alerts: DataFrame) -> DataFrame:
    """What a list shows: the user's login name where there is one, three techniques and how many more."""
    ids = F.transform("mitre", lambda m: m["technique_id"])
    return alerts.select("alert_id", F.coalesce(F.nullif("audit_name", F.lit("")), "user_name").alias("user"), F.array_join(F.slice(ids, 1, 3), ", ").alias("techniques"), F.greatest(F.size("mitre") - 3, F.lit(0)).alias("more"), "risk_score", X.band(F.col("risk_score")).alias("severity"))


def compact(n: Column) -> Column:
    """1234 -> 1.2k, 2500000 -> 2.5M."""
    short = lambda unit, mark: F.concat(F.regexp_replace(F.format_number(F.floor(n / unit * 10) / 10, 1), r"\.0$", ""), F.lit(mark))
    return F.when(n >= 1_000_000, short(1_000_000, "M")).when(n >= 1000, short(1000, "k")).otherwise(n.cast("string"))
