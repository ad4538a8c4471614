"""Child records onto their event: an aggregate per event id, joined back."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.constants import CHILD_TYPES
from .normalize import field, scorable


CHILD = "event_id string, ordinal long, record_type string, args array<string>, title string, dir string, path string, address struct<ip:string,port:long>"


def with_child_fields(rows: DataFrame) -> DataFrame:
    """Parsed records with what a child record tells of its event: the columns of CHILD, null for other records."""
    log, kv = field("log"), field("kv")
    get = lambda name: F.coalesce(F.nullif(log(name), F.lit("")), kv(name))
    is_a = lambda t: F.col("record_type") == t
    fields = F.map_concat(F.coalesce("kv", F.expr("cast(map() as map<string,string>)")), F.coalesce("log", F.expr("cast(map() as map<string,string>)")))
    return rows.withColumns(
        {
            "args": F.when(is_a("EXECVE"), X.execve_args(fields)),
            "title": F.when(is_a("PROCTITLE"), X.proctitle(get("proctitle"))),
            "dir": F.when(is_a("CWD"), X.hex_decode(get("cwd"))),
            "path": F.when(is_a("PATH"), X.hex_decode(get("name"))),
            "address": F.when(is_a("SOCKADDR"), X.socket_address(get("saddr"))),
        }
    )


TOLD = ("args", "title", "dir", "path", "address")


def slim(rows: DataFrame) -> DataFrame:
    """Parsed records with no more than `correlated` needs: child records keep what they tell of their event, others the
    rest; the raw text goes, which `message` or `original` has."""
    child = F.col("record_type").isin(*CHILD_TYPES)
    rest = [c for c in rows.columns if c not in ("ordinal", "ts", "record_type", "event_id", "raw_text")]
    rows = with_child_fields(rows).drop("raw_text")
    return rows.withColumns({c: F.when(~child, F.col(c)) for c in rest})


def slots(rows: DataFrame) -> DataFrame:
    """event_id, argv, e_proctitle, e_cwd, paths, dest of parsed records.

    By arrival: the last EXECVE with arguments sets argv and stands in for a missing title; the last decodable
    PROCTITLE and SOCKADDR and the last CWD count; PATHs are collected in order."""
    kids = rows.where(F.col("record_type").isin(*CHILD_TYPES) & F.col("event_id").isNotNull())
    kids = (kids if TOLD[0] in rows.columns else with_child_fields(kids)).select(*(c.split()[0] for c in CHILD.split(", ")))
    is_a = lambda t: F.col("record_type") == t
    last = lambda value, when: F.max_by(value, F.when(when, F.col("ordinal")))
    titled = F.col("title").isNotNull()
    argued = F.size("args") > 0
    out = kids.groupBy("event_id").agg(
        last("args", argued).alias("argv"),
        F.coalesce(last("title", titled), F.min_by(F.array_join("args", " "), F.when(argued, F.col("ordinal")))).alias("e_proctitle"),
        last("dir", is_a("CWD")).alias("e_cwd"),
        F.array_sort(F.collect_list(F.when(F.col("path") != "", F.struct("ordinal", "path")))).alias("p"),
        last("address", F.col("address.ip").isNotNull()).alias("dest"),
    )
    return out.select("event_id", "argv", "e_proctitle", "e_cwd", F.transform("p", lambda s: s["path"]).alias("paths"), "dest")


def correlated(rows: DataFrame) -> DataFrame:
    """The scorable parsed records (`slim` or whole) with the enrichment of their event id."""
    return scorable(rows).drop(*TOLD).join(slots(rows), "event_id", "left")
