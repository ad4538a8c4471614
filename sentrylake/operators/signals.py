"""Short-horizon signals: event-time windows over normalised events."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

FAILURES, PORTS, SLICE, UNTIMED = 600_000_000, 300_000_000, 3_600_000_000, 1024


def in_slices(events: DataFrame, reach: int, size: int = SLICE) -> DataFrame:
    """Each event in its own hour (`size` microseconds) and, where it lies within `reach` of the next, also there as context: windows can
    then be partitioned by key and hour, and a busy key is split by time. Events without a time count nothing; they are
    dealt over UNTIMED slices under zero."""
    untimed = -1 - F.pmod(F.xxhash64("ordinal"), F.lit(UNTIMED))
    own, later = (F.coalesce(F.floor(t / size), untimed) for t in (F.col("us"), F.col("us") + reach))
    rows = events.withColumn("own_slice", own)
    return rows.withColumn("slice", F.explode(F.array_distinct(F.array(own, later))))


def own(rows: DataFrame) -> DataFrame:
    return rows.where(F.col("own_slice") == F.col("slice")).drop("own_slice", "slice")


def with_signals(events: DataFrame, batch: str | None = None, compat: bool = False, instant: bool = False) -> DataFrame:
    """Adds recent_auth_failures (of host and account, ten minutes, both ends included) and recent_distinct_ports (of
    the host, five minutes) as they stood when the event arrived: events of the same instant count in arrival order, or,
    with `instant`, all of them. Without a time both are 0. `batch`: a column whose values start afresh; `compat`: ports
    are not counted.

    Rows are shuffled once, by host and hour; both signals sort them there. Of the hour before, only what counts comes."""
    keys = [batch] if batch else []
    known = F.col("us").isNotNull()
    named = F.when(F.col("auid") >= 0, F.col("auid").cast("string"))
    unnamed = F.when(F.col("uid") >= 0, F.col("uid").cast("string"))
    account = F.coalesce(F.nullif("acct", F.lit("")), F.nullif("auid_name", F.lit("")), named, F.nullif("user_name", F.lit("")), unnamed, F.lit("unknown"))
    rows = in_slices(events.withColumn("account", account), FAILURES)
    counts = F.coalesce(F.col("is_auth_failure"), F.lit(False)) | F.coalesce(F.col("dest_port") > 0, F.lit(False))
    rows = rows.where((F.col("own_slice") == F.col("slice")) | counts).repartition(*keys, "host", "slice")
    failed = F.col("is_auth_failure").cast("int")
    w = Window.partitionBy(*keys, "host", "account", "slice")
    total = F.sum(failed).over(w.orderBy("us").rangeBetween(-FAILURES, 0))
    if not instant:
        total -= F.coalesce(F.sum(failed).over(Window.partitionBy(*keys, "host", "account", "slice", "us").orderBy("ordinal").rowsBetween(1, Window.unboundedFollowing)), F.lit(0))
    rows = rows.withColumn("recent_auth_failures", F.when(known, total).otherwise(0).cast("bigint"))
    if compat:
        return own(rows).withColumn("recent_distinct_ports", F.lit(0).cast("bigint"))
    return own(with_ports(rows, [*keys, "host", "slice"], instant))


def with_ports(rows: DataFrame, keys: list[str], instant: bool = False) -> DataFrame:
    """Adds recent_distinct_ports by a sweep. The sightings of a port are merged into stretches in which it is never
    out of sight for longer than PORTS; a stretch adds one at its first sighting and takes it back just after its last
    has aged out, so a running sum counts the ports in sight. No list of sightings is made."""
    names = rows.columns
    seen = F.col("dest_port") > 0
    port = F.when(seen, F.col("dest_port")).otherwise(-1 - F.pmod(F.xxhash64("ordinal"), F.lit(UNTIMED)))  # others: of no port, dealt
    w = Window.partitionBy(*keys, "port").orderBy("us", "ordinal")
    begins = seen & F.coalesce(F.lag("us").over(w) < F.col("us") - PORTS, F.lit(True))
    ends = seen & F.coalesce(F.lead("us").over(w) > F.col("us") + PORTS, F.lit(True))
    rows = rows.withColumn("port", port).withColumn("begins", begins).withColumn("ends", ends)
    step = lambda us, place, change, event: F.struct(us.alias("us"), place.alias("place"), change.alias("change"), event.alias("event"))
    up = step(F.col("us"), F.col("ordinal"), F.col("begins").cast("int"), F.lit(True))
    down = F.when(F.col("ends"), step(F.col("us") + PORTS + 1, F.lit(-(1 << 63)).cast("long"), F.lit(-1), F.lit(False)))
    rows = rows.withColumn("step", F.explode(F.array_compact(F.array(up, down))))
    w = Window.partitionBy(*keys)
    upto = w.orderBy("step.us").rangeBetween(Window.unboundedPreceding, 0) if instant else w.orderBy("step.us", "step.place").rowsBetween(Window.unboundedPreceding, 0)
    count = F.sum("step.change").over(upto)
    known = F.col("us").isNotNull() & F.col("host").isNotNull()
    rows = rows.withColumn("recent_distinct_ports", F.when(known, count).otherwise(0).cast("bigint")).where("step.event")
    return rows.select(*names, "recent_distinct_ports")
