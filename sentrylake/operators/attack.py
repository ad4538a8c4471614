"""Technique tags from the rule columns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.constants import TACTICS, TECHNIQUES
from .ladders import LEAST_CONFIDENCE, RULE_COLUMNS, apply, technique_terms


def with_techniques(events: DataFrame) -> DataFrame:
    """Adds `mitre` (tags, the most confident first, then in the order of the rules), technique_1, technique_2, ... and
    technique_severity."""
    rows = apply(events, RULE_COLUMNS)
    tags = []
    for t, best, place in technique_terms():
        tactic, name, base = TECHNIQUES[t]
        fields = {"tactic": TACTICS[tactic], "tactic_id": tactic, "technique_id": t, "technique_name": name}
        value = F.expr(best)
        tag = F.struct((-value).alias("down"), F.expr(place).alias("place"), *(F.lit(v).alias(k) for k, v in fields.items()), F.lit(base).alias("base_severity"), F.round(value, 2).alias("confidence"))
        tags.append(F.when(value >= LEAST_CONFIDENCE, tag))
    names = ["tactic", "tactic_id", "technique_id", "technique_name", "base_severity", "confidence"]
    rows = rows.withColumn("mitre", F.transform(F.array_sort(F.array_compact(F.array(*tags))), lambda s: F.struct(*(s[n].alias(n) for n in names))))
    rows = rows.drop(*(n for n, _ in RULE_COLUMNS))
    ids = F.transform("mitre", lambda s: s["technique_id"])
    severity = F.array_max(F.transform("mitre", lambda s: s["base_severity"] * (0.5 + 0.5 * s["confidence"])))
    return rows.select(
        "*",
        F.get(ids, F.lit(0)).alias("technique_1"),
        F.get(ids, F.lit(1)).alias("technique_2"),
        F.get("mitre", F.lit(0))["technique_name"].alias("technique_1_name"),
        F.nullif(F.array_join(F.slice(ids, 1, 3), ", "), F.lit("")).alias("technique_list"),
        F.coalesce(severity, F.lit(0.0)).alias("technique_severity"),
    )
