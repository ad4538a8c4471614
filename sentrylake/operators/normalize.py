"""Raw records to normalised events: one wide projection in which the first filled source of a field wins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.constants import CHILD_TYPES

EVENT_COLUMNS = (
    "ordinal", "ts", "us", "hour_utc", "weekday", "event_id", "host", "host_ip", "record_type", "action", "category", "module", "uid", "euid", "auid",
    "user_name", "auid_name", "exe", "comm", "proctitle", "argv_text", "n_args", "path_text", "cwd", "session", "tty", "remote_addr", "acct", "success",
    "audit_key", "pid", "ppid", "syscall", "dest_ip", "dest_port", "log_original", "log_message", "log_fields",
)


def parsed(raw: DataFrame) -> DataFrame:
    """Adds the raw text, its fields (kv), the record type and the event id; parses each text once."""
    line = F.coalesce(F.nullif("message", F.lit("")), F.nullif("original", F.lit("")), F.lit(""))
    rows = raw.withColumn("raw_text", line).withColumn("kv", X.kv_map(F.col("raw_text")))
    log, kv = field("log"), field("kv")
    generic = F.when(F.col("action") != "syscall", F.col("action"))
    call = X.filled(log("SYSCALL"), kv("SYSCALL"), generic)
    rows = rows.withColumn("call", call).withColumn("record_type", F.upper(F.coalesce(X.filled(log("record_type"), kv("type"), F.upper("call")), F.lit("UNKNOWN"))))
    return rows.withColumn("event_id", X.event_id(F.col("raw_text"), X.iso_text(F.col("ts")), log("sequence")))


def field(name: str):
    """name -> its value in a map column, null where there is none."""
    return lambda key: F.try_element_at(F.col(name), F.lit(key))


def paths_of(log, kv) -> Column:
    """Paths of a record itself: `paths` or `path`, then `name`; hex decoded, empty ones dropped."""
    found = F.transform(F.array_compact(F.array(X.filled(log("paths"), log("path")), log("name"))), X.hex_decode)
    return F.filter(found, lambda p: p != "")


def normalize(rows: DataFrame) -> DataFrame:
    """Events of parsed records that carry their enrichment columns (argv, e_proctitle, e_cwd, paths, dest)."""
    log, kv = field("log"), field("kv")
    first = X.filled
    uid = X.to_id(first(F.col("user_id"), log("uid"), kv("uid")))
    argv = F.coalesce("argv", F.array().cast("array<string>"))
    paths = F.when(F.size("paths") > 0, F.col("paths")).otherwise(paths_of(log, kv))
    micros = F.unix_micros("ts")
    rows = rows.withColumn("uid", uid)
    return rows.select(
        "ordinal",
        "ts",
        micros.alias("us"),
        F.hour("ts").alias("hour_utc"),
        F.weekday("ts").alias("weekday"),
        "event_id",
        first(F.col("hostname"), F.col("host_name")).alias("host"),
        F.coalesce("host_ip", F.array().cast("array<string>")).alias("host_ip"),
        "record_type",
        F.col("call").alias("action"),
        F.coalesce("category", F.array().cast("array<string>")).alias("category"),
        "module",
        "uid",
        X.to_id(first(F.col("effective_id"), log("euid"), kv("euid"))).alias("euid"),
        X.to_id(first(F.col("audit_id"), log("auid"), kv("auid"))).alias("auid"),
        F.coalesce(X.clean_name(log("UID")), X.clean_name(kv("UID")), X.uid_name(F.col("uid"))).alias("user_name"),
        F.coalesce(X.clean_name(log("AUID")), X.clean_name(kv("AUID"))).alias("auid_name"),
        first(F.col("executable"), log("exe"), kv("exe")).alias("exe"),
        first(F.col("process_name"), log("comm"), kv("comm")).alias("comm"),
        F.coalesce(F.nullif("e_proctitle", F.lit("")), X.proctitle(log("proctitle")), X.proctitle(kv("proctitle"))).alias("proctitle"),
        F.nullif(F.array_join(argv, " "), F.lit("")).alias("argv_text"),
        F.size(argv).alias("n_args"),
        F.array_join(F.coalesce(paths, F.array().cast("array<string>")), "\n").alias("path_text"),
        first(F.col("e_cwd"), X.hex_decode(log("cwd")), X.hex_decode(kv("cwd"))).alias("cwd"),
        first(log("ses"), kv("ses")).alias("session"),
        first(log("tty"), kv("tty"), kv("terminal")).alias("tty"),
        first(log("addr"), kv("addr")).alias("remote_addr"),
        first(log("acct"), kv("acct")).alias("acct"),
        X.success(F.col("log"), F.col("kv")).alias("success"),
        X.clean_key(first(log("key"), kv("key"))).alias("audit_key"),
        X.to_id(first(F.col("pid"), log("pid"), kv("pid"))).alias("pid"),
        X.to_id(first(F.col("ppid"), log("ppid"), kv("ppid"))).alias("ppid"),
        first(log("SYSCALL"), kv("syscall")).alias("syscall"),
        F.col("dest.ip").alias("dest_ip"),
        F.coalesce("dest.port", F.lit(-1)).cast("bigint").alias("dest_port"),
        F.col("original").alias("log_original"),
        F.col("message").alias("log_message"),
        F.col("log").alias("log_fields"),
    )


def scorable(rows: DataFrame) -> DataFrame:
    """Without the child records."""
    return rows.where(~F.col("record_type").isin(*CHILD_TYPES))
