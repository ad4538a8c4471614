"""Alert documents, their deterministic ids, and the sink that upserts them."""

from __future__ import annotations

import json
import re

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import BANDS, Bands
from ..functions import text as X
from ..plans.session import Folder, tidy
from .ladders import EXPLAIN, FACTOR_TEXT, SUMMARY, apply, risk_stages


def explained(rows: DataFrame, weights: dict | None = None, bands: Bands = BANDS) -> DataFrame:
    """Adds risk, factors and explanation to scored, tagged events."""
    rows = apply(rows, *risk_stages(weights, bands), FACTOR_TEXT)
    marked = F.filter(F.split("path_text", "\n"), lambda p: F.exists(F.array(*map(F.lit, _sensitive())), lambda m: F.contains(F.lower(p), m)))
    rows = rows.withColumn("sensitive_list", F.array_join(F.slice(marked, 1, 3), ", ")).withColumn("type_title", X.title_words("record_type"))
    return apply(rows, EXPLAIN, SUMMARY)


def _sensitive() -> tuple[str, ...]:
    from ..functions.constants import SENSITIVE

    return SENSITIVE


def alert_id():
    """host:time:event:type, with stand-ins for what is missing."""
    ts = F.coalesce(X.iso_text(F.col("ts")), F.lit("nots"))
    return F.concat_ws(":", F.coalesce(F.nullif("host", F.lit("")), F.lit("nohost")), ts, F.coalesce("event_id", F.lit("noid")), "record_type")


#: The version of the rules, risk model and alert layout.
DETECTION_VERSION = "1"


def alert_rows(rows: DataFrame, scored_at: str, model_version: str = "none") -> DataFrame:
    """One flat row an alert: what queries filter, sort and aggregate on, and the raw record in `log`. Scores are 32-bit
    floats there. `model_version`: of the artifacts that scored the rows."""
    single = lambda c: F.col(c).cast("float").alias(c)
    percent = lambda c: F.concat(F.floor(F.round(F.col(c) * 100, 6) + 0.5).cast("int").cast("string"), F.lit("%"))
    fact = lambda label, value: F.struct(F.lit(label).alias("label"), value.alias("value"))
    factors = F.array_compact(
        F.array(
            fact("Anomaly confidence", percent("confidence")),
            fact("Anomaly score", percent("anomaly_score")),
            fact("Behaviour rarity", F.col("rarity_word")),
            fact("Privilege context", F.col("privilege_phrase")),
            F.when(F.col("host").isNotNull(), fact("Host", F.concat("host", F.lit(" (criticality "), F.format_number("criticality", 1), F.lit(")")))),
            F.when(F.col("recent_auth_failures") > 0, fact("Recent auth failures", F.col("recent_auth_failures").cast("string"))),
            F.when(F.col("technique_1").isNotNull(), fact("MITRE ATT&CK", F.col("technique_list"))),
            fact("Risk score", F.concat(F.col("risk_score").cast("string"), F.lit(" ("), F.initcap("severity"), F.lit(")"))),
        )
    )
    known = lambda c: F.when(F.col(c) != -1, F.col(c))
    network = F.when(F.col("dest_ip").isNotNull() | (F.col("dest_port") != -1) | F.col("remote_addr").isNotNull(), F.struct(F.col("dest_ip").alias("destination_ip"), known("dest_port").alias("destination_port"), F.col("remote_addr").alias("source_ip"), F.when(F.col("has_addr"), "inbound").otherwise("outbound").alias("direction")))
    parts = [n for s in risk_stages()[0] for n in [s[0]] if n != "rarity"] + ["rarity", "technique_severity", "technical_severity"]
    components = F.map_from_arrays(F.array(*(F.lit(p.replace("_", ".", 1) if p.startswith(("impact_", "exploit_")) else p) for p in parts)), F.array(*(F.round(p, 3) for p in parts)))
    return rows.select(
        "ordinal", alert_id().alias("alert_id"), F.lit(scored_at).cast("timestamp").alias("scored_at"), F.col("ts").alias("event_ts"), "event_id", F.col("record_type").alias("event_type"),
        F.coalesce(F.nullif("action", F.lit("")), "syscall").alias("action"), "category", "module", F.when(F.col("success"), "success").when(~F.col("success"), "failure").alias("outcome"), "host", "host_ip", single("criticality"),
        known("uid").alias("user_id"), "user_name", known("auid").alias("audit_id"), F.col("auid_name").alias("audit_name"), "is_root", "privilege_transition", "process_name", "exe", "command_line", known("pid").alias("pid"), known("ppid").alias("parent_pid"),
        F.lit("isolation_forest").alias("model"), F.lit(model_version).alias("model_version"), F.lit(DETECTION_VERSION).alias("detection_version"), F.struct("log_original", "log_message", "log_fields").alias("log"),
        "cwd", "audit_key", network.alias("network"), single("anomaly_score"), F.col("raw_score").cast("float").alias("raw_score"), single("confidence"), "prediction", "risk_score", "severity", single("impact"), single("exploitability"),
        single("context_modifier"), components.alias("components"), F.split("factor_text", " ").alias("risk_factors"), "mitre", "title", "summary", factors.alias("factors"), "recent_auth_failures", "recent_distinct_ports",
    )


def newest() -> list[Column]:
    return [F.desc_nulls_last("scored_at"), F.desc_nulls_last("ordinal")]


def latest(rows: DataFrame) -> DataFrame:
    """Of each alert_id the last written row. Only the columns that are asked for are sorted."""
    return first_of(rows, ["alert_id"], *newest())


def first_of(rows: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return rows.withColumn("__place", place).where("__place = 1").drop("__place")


def upsert(path: str, batch: DataFrame) -> None:
    """Merge a batch into a Parquet table by day, reading and writing only the days that the batch touches (an alert's id
    holds its time, so its versions share a day). Of a day that the table hasn't got, the batch is written once.

    Each call writes to folders of its own and then creates the next manifest, day -> folder: readers and repeated
    batches see whole tables. Of several writers that are ready at once one creates it; the others merge what has
    changed under them, of the days that they touch, and try again: none loses an alert, and of one that two write the
    last to be published stays. Folders that neither this manifest nor the one before it names are deleted, so a
    reader has until the next but one batch; what failed calls have left goes when it is LEFT old."""
    spark, folder = batch.sparkSession, Folder(batch.sparkSession, path)
    number = _claim(folder)
    fresh_in, target, tries = f"incoming-{number}", f"data-{number}", 0
    keyed = batch.withColumn("event_day", F.coalesce(F.to_date("event_ts").cast("string"), F.lit("none")))
    _write(keyed, f"{path}/{fresh_in}", *newest())
    fresh = {n.removeprefix("event_day="): fresh_in for n in folder.names(fresh_in) if n.startswith("event_day=")}
    merged: dict[str, tuple[str, str]] = {}  # day -> the folder that it was merged with, the folder of the result
    while True:
        last, days = _manifest(folder)
        stale = [d for d in fresh if d in days and merged.get(d, ("", ""))[0] != days[d]]
        if stale:
            new, old = (_days(spark, path, {d: where[d] for d in stale}, keyed.schema) for where in (fresh, days))
            whole = old.withColumn("__new", F.lit(0)).unionByName(new.withColumn("__new", F.lit(1)))
            _write(whole, f"{path}/{target}", F.desc("__new"))
            merged |= {d: (days[d], target) for d in stale}
        for d in [d for d in fresh if d not in days and fresh[d] == fresh_in]:
            folder.move(f"{fresh_in}/event_day={d}", f"{target}/event_day={d}")
            fresh[d] = target
        now = {**days, **{d: merged[d][1] if d in days else where for d, where in fresh.items()}}
        if folder.create(f"manifest-{last + 1:012d}", json.dumps({"days": now, "schema": keyed.schema.jsonValue()})):
            break
        tries += 1
        target = f"data-{number}-{tries}"
    folder.delete(fresh_in)
    _clean(folder)


def _write(rows: DataFrame, path: str, *order: Column) -> None:
    """By day, and in a day by ranges of ids, with Bloom filters of them: a look-up reads the one file that has its id. Of
    each id the first row by `order` (an id's rows share its day): found in the ranges, so rows are shuffled once."""
    keys = ["event_day", "alert_id"]
    rows = first_of(rows.repartitionByRange(*keys), keys, *order).drop("__new").sortWithinPartitions(*keys)
    with tidy(rows.sparkSession):
        rows.write.partitionBy("event_day").option("parquet.bloom.filter.enabled#alert_id", "true").parquet(path)


def lookup(spark: SparkSession, path: str, alert_id: str) -> DataFrame | None:
    """The alert of an id in the table: the day is that of the time in the id (`alert_id`), so that one day is looked at;
    without a time, the alerts without one."""
    folder = Folder(spark, path)
    names = [n for n in folder.names() if n.startswith("manifest-")]
    if not names:
        return None
    got = json.loads(folder.read(names[-1]))
    stamp = re.search(r":(\d{4}-\d\d-\d\d)T\d\d:\d\d:\d\d", alert_id)
    days = {d: where for d, where in got["days"].items() if d == (stamp[1] if stamp else "none")}
    schema = T.StructType.fromJson(got["schema"])
    rows = _days(spark, path, days, schema)
    rows = spark.createDataFrame([], schema) if rows is None else rows
    return rows.where(F.col("alert_id") == alert_id)


#: Milliseconds after which what failed calls have left is deleted.
LEFT = 86_400_000


def _claim(folder: Folder) -> int:
    """A number that no other call has."""
    taken = [int(n.rpartition("-")[2]) for n in folder.names() if n.startswith((".claim-", "manifest-"))]
    number = max(taken, default=0) + 1
    while not folder.create(f".claim-{number:012d}", ""):
        number += 1
    return number


def _clean(folder: Folder) -> None:
    """Deletes the manifests before the last two with what they alone name, and old leavings."""
    names = folder.names()
    manifests = [n for n in names if n.startswith("manifest-")]
    tables = {n: _read(folder, n) for n in manifests}
    used = {(where, day) for n in manifests[-2:] for day, where in tables[n].items()}
    for n in manifests[:-2]:
        for day, where in tables[n].items():
            if (where, day) not in used:
                folder.delete(f"{where}/event_day={day}")
                if not any(p.startswith("event_day=") for p in folder.names(where)):
                    folder.delete(where)
        folder.delete(n)
    known = {where for where, _ in used}
    for n in names:
        if n not in known and n.startswith(("incoming-", "data-", ".claim-")) and folder.age(n) > LEFT:
            folder.delete(n)


def _read(folder: Folder, name: str) -> dict[str, str]:
    """The days of a manifest; none if another call has deleted it."""
    try:
        return json.loads(folder.read(name))["days"]
    except Py4JJavaError:
        if folder.exists(name):
            raise
        return {}


def _manifest(folder: Folder) -> tuple[int, dict[str, str]]:
    """Number and days of the last manifest."""
    names = [n for n in folder.names() if n.startswith("manifest-")]
    return (int(names[-1][9:]), json.loads(folder.read(names[-1]))["days"]) if names else (0, {})


def _days(spark: SparkSession, path: str, days: dict[str, str], schema: T.StructType) -> DataFrame | None:
    out = None
    for where in sorted(set(days.values())):  # a folder holds the days of one call
        mine = [f"{path}/{where}/event_day={d}" for d, w in days.items() if w == where]
        part = spark.read.schema(schema).option("basePath", f"{path}/{where}").parquet(*mine)
        out = part if out is None else out.unionByName(part)
    return out


def day_folders(spark: SparkSession, path: str) -> dict[str, str]:
    """Day -> the folder that holds its alerts now; another one once an upsert has touched the day."""
    return _manifest(Folder(spark, path))[1]


def read_days(spark: SparkSession, path: str, days: dict[str, str]) -> DataFrame:
    """The alerts of some days with `event_day`, from the folders that `day_folders` named."""
    folder = Folder(spark, path)
    last = [n for n in folder.names() if n.startswith("manifest-")][-1]
    return _days(spark, path, days, T.StructType.fromJson(json.loads(folder.read(last))["schema"]))


def read_table(spark: SparkSession, path: str) -> DataFrame | None:
    """The alerts as of the last manifest; None where there is none."""
    folder = Folder(spark, path)
    names = [n for n in folder.names() if n.startswith("manifest-")]
    if not names:
        return None
    got = json.loads(folder.read(names[-1]))
    schema = T.StructType.fromJson(got["schema"])
    rows = _days(spark, path, got["days"], schema)
    return spark.createDataFrame([], schema) if rows is None else rows
