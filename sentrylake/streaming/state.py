"""What spans micro-batches: child records that come apart from their event, and the ports in sight of a host.

Both keep their state in Spark's state store (RocksDB), by keys that split hot hosts and give each micro-batch few
groups; timers of the watermark close what no later record can change.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions.constants import CHILD_TYPES
from ..operators.correlate import CHILD, with_child_fields
from ..operators.signals import PORTS, UNTIMED, in_slices

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Groups that the events of a micro-batch are dealt over.
BUCKETS = 256
#: Microseconds of a host in a group of `port_signals`.
PORT_SLICE = 900_000_000
#: Events of a result batch.
PIECE = 50_000
STAMP = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "ignoreNullFields": "false"}
HELD = f"closes long, whole string, {CHILD}".replace("address struct<ip:string,port:long>", "ip string, port long")
SLOTS = "whole string, argv array<string>, e_proctitle string, e_cwd string, paths array<string>, dest struct<ip:string,port:long>"


def stateful(spark: SparkSession) -> None:
    """The state store that these operators need."""
    if spark.conf.get("spark.sql.streaming.stateStore.providerClass") != PROVIDER:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)


def gathered(kids: list[Row]) -> tuple:
    """argv, e_proctitle, e_cwd, paths, dest of an event's children, as `correlate.slots` has them."""
    kids = sorted(kids, key=lambda k: k.ordinal)
    argued = [k for k in kids if k.args]
    titled = [k.title for k in kids if k.title is not None]
    title = titled[-1] if titled else " ".join(argued[0].args) if argued else None
    dirs = [k.dir for k in kids if k.record_type == "CWD"]
    found = [(k.ip, k.port) for k in kids if k.ip is not None]
    return argued[-1].args if argued else None, title, dirs[-1] if dirs else None, [k.path for k in kids if k.path], found[-1] if found else None


class Correlation(StatefulProcessor):
    """Holds the records of events that are still open; an event closes when the watermark has passed its last record
    by `wait` milliseconds."""

    def __init__(self, wait: int):
        self.wait = wait

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.names = handle, [c.split()[0] for c in HELD.split(", ")]
        self.held = handle.getListState("held", HELD)

    def swept(self, new: list[tuple], now: int) -> Iterator[Row]:
        Held = Row(*self.names)
        events: dict[str, list[Row]] = {}
        for values in (*self.held.get(), *new):
            row = Held(*values)
            events.setdefault(row.event_id, []).append(row)
        kept, closing = [], []
        for rows in events.values():
            closes = max(r.closes for r in rows)
            if closes > now:
                kept += rows
                closing.append(closes)
                continue
            kids = [r for r in rows if r.record_type in CHILD_TYPES]
            for r in rows:
                if r.whole is not None:
                    argv, title, dir_, paths, dest = gathered(kids) if kids else (None,) * 5
                    yield Row(whole=r.whole, argv=argv, e_proctitle=title, e_cwd=dir_, paths=paths, dest=dest and Row(ip=dest[0], port=dest[1]))
        if kept:
            self.held.put([tuple(r) for r in kept])
            if min(closing) not in set(self.handle.listTimers()):
                self.handle.registerTimer(min(closing))
        else:
            self.held.clear()

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        now = max(timerValues.getCurrentWatermarkInMs(), 0)
        new = [((now if r.ms is None else r.ms) + self.wait, *(getattr(r, n) for n in self.names[1:])) for r in rows]
        yield from self.swept(new, now)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:
        yield from self.swept([], timerValues.getCurrentWatermarkInMs())

    def close(self) -> None:
        pass


def correlation_stream(rows: DataFrame, late: str = "1 minute", wait: int = 5_000, buckets: int = BUCKETS) -> DataFrame:
    """Of streamed parsed records the scorable ones with argv, e_proctitle, e_cwd, paths and dest of their children, in
    whatever micro-batches these came: `correlate.correlated` over a stream.

    An event is given out once, when the watermark (the latest time less `late`) has passed its last record's time by
    `wait` milliseconds; a child that comes after that finds no event and goes, like a record later than the watermark.
    Records without a time count as of the watermark when they come; events without an id have no children.
    Events are dealt over `buckets` groups by a hash of their id, so no host or time makes a group large."""
    spark = rows.sparkSession
    stateful(spark)
    names, schema = rows.columns, rows.schema
    ids = F.coalesce("event_id", F.concat(F.lit("none "), F.col("ordinal").cast("string")))
    whole = F.when(~F.col("record_type").isin(*CHILD_TYPES), F.to_json(F.struct(*names), STAMP))
    both = with_child_fields(rows.withWatermark("ts", late)).withColumn("whole", whole).withColumn("event_id", ids)
    both = both.withColumns({"ip": F.col("address.ip"), "port": F.col("address.port").cast("long"), "ms": F.unix_millis("ts")})
    both = both.select("ts", "ms", *(c.split()[0] for c in HELD.split(", ")[1:]))
    both = both.withColumn("bucket", F.pmod(F.xxhash64("event_id"), F.lit(buckets)))
    out = both.groupBy("bucket").transformWithState(Correlation(wait), SLOTS, "append", "eventtime")
    return out.select(F.from_json("whole", schema, STAMP).alias("r"), "argv", "e_proctitle", "e_cwd", "paths", "dest").select("r.*", "argv", "e_proctitle", "e_cwd", "paths", "dest")


PORT_SIGNALS = "host string, ordinal long, us long, recent_distinct_ports long"


def in_sight(us: np.ndarray, ordinal: np.ndarray, seen: tuple[np.ndarray, np.ndarray, np.ndarray], reach: int = PORTS, instant: bool = False) -> np.ndarray:
    """How many ports of the sightings (port, us, ordinal) each event has in sight: a port counts from a sighting, of
    that instant by place (`instant`: wherever it stands), until `reach` after it. Sightings that follow each other
    within the reach are one stretch."""
    order = np.lexsort((seen[2], seen[1], seen[0]))
    port, at, place = (x[order] for x in seen)
    new = np.ones(len(at), bool)
    new[1:] = (port[1:] != port[:-1]) | (at[1:] > at[:-1] + reach)
    starts, ends = (at[new], place[new]), np.sort(at[np.roll(new, -1)] if len(at) else at) + reach
    first, place = np.repeat([0, 1], [len(starts[0]), len(us)]), np.concatenate([starts[1], ordinal])
    both = np.lexsort((place, first, np.concatenate([starts[0], us])) if instant else (first, place, np.concatenate([starts[0], us])))
    begun = np.empty(len(both), np.int64)
    begun[both] = np.cumsum(both < len(starts[0]))
    return begun[len(starts[0]) :] - np.searchsorted(ends, us, side="left")


class Ports(StatefulProcessor):
    """Of a host's slice of time: port -> its sightings that events not yet late can have in sight."""

    def __init__(self, instant: bool = False):
        self.instant = instant

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.sightings = handle.getMapState("sightings", "port long", "us array<long>, places array<long>")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        host, slice_ = key
        if host is None or slice_ < 0:  # nothing is in sight
            for b in rows:
                b = b[b["own"]]
                yield self.result(host, b["ordinal"].to_numpy(np.int64), b["us"].astype("Int64"), np.zeros(len(b), np.int64))
            return
        us, ordinal, port, own = (np.concatenate(x) for x in zip(*((b["us"].to_numpy(np.int64), b["ordinal"].to_numpy(np.int64), b["dest_port"].fillna(-1).to_numpy(np.int64), b["own"].to_numpy(bool)) for b in rows), strict=True))
        known = {p: (t, o) for (p,), (t, o) in self.sightings.iterator()}
        old = [np.array([p for p, (t, _) in known.items() for _ in t], np.int64), *(np.array([x for v in known.values() for x in v[k]], np.int64) for k in (0, 1))]
        seen = tuple(np.concatenate([a, b]) for a, b in zip(old, (port[port > 0], us[port > 0], ordinal[port > 0]), strict=True))
        count = in_sight(us[own], ordinal[own], seen, instant=self.instant)
        now = max(timerValues.getCurrentWatermarkInMs(), 0)
        open_ = seen[1] >= now * 1000 - PORTS
        fresh = np.arange(len(open_)) >= len(old[0])
        for p in np.unique(seen[0][fresh | ~open_]).tolist():  # the others are as they were
            mine = open_ & (seen[0] == p)
            if mine.any():
                self.sightings.updateValue((p,), (seen[1][mine].tolist(), seen[2][mine].tolist()))
            else:
                self.sightings.removeKey((p,))
        ends = int(slice_ + 1) * PORT_SLICE // 1000
        if ends > now and ends not in set(self.handle.listTimers()):
            self.handle.registerTimer(ends)
        ordinal, us = ordinal[own], us[own]
        for k in range(0, len(us), PIECE):
            yield self.result(host, ordinal[k : k + PIECE], us[k : k + PIECE], count[k : k + PIECE])

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        self.sightings.clear()
        yield self.result(None, *[np.zeros(0, np.int64)] * 3)

    @staticmethod
    def result(host: str | None, ordinal: np.ndarray, us: Any, count: np.ndarray) -> pd.DataFrame:
        return pd.DataFrame({"host": pd.Series([host] * len(ordinal), dtype=object), "ordinal": ordinal, "us": pd.array(us, "Int64"), "recent_distinct_ports": count})

    def close(self) -> None:
        pass


def port_signals(events: DataFrame, late: str = "1 minute", instant: bool = False) -> DataFrame:
    """Distinct destination ports of the host in the five minutes up to each event, across micro-batches (ts, host,
    ordinal, us, dest_port); 0 without a time or a host. A group is PORT_SLICE of a host, with the sightings of the five
    minutes before it as context, so that a busy host is split by time; without a host, events are dealt by hash.

    An event counts what lies at or before its own place (time, then arrival; `instant`: time alone) and has arrived by
    then; a late one doesn't count what lies after it."""
    stateful(events.sparkSession)
    rows = in_slices(events.withWatermark("ts", late), PORTS, PORT_SLICE)
    rows = rows.withColumn("own", F.col("own_slice") == F.col("slice")).where(F.col("own") | (F.col("dest_port") > 0))
    dealt = F.when(F.col("host").isNull(), -1 - F.pmod(F.xxhash64("ordinal"), F.lit(UNTIMED))).otherwise(F.col("slice"))
    rows = rows.where(F.col("host").isNotNull() | F.col("own")).withColumn("slice", dealt).select("ts", "host", "slice", "ordinal", "us", "dest_port", "own")
    return rows.groupBy("host", "slice").transformWithStateInPandas(Ports(instant), PORT_SIGNALS, "append", "eventtime")
