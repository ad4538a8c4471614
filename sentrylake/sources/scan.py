"""Incremental and sampled reads of an event table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.alert_query import WINDOW


def after_cursor(rows: DataFrame, cursor: str | None, size: int, ts: str = "ts", ordinal: str = "ordinal") -> DataFrame:
    """The next `size` rows strictly after the cursor's time, the earliest first."""
    if cursor is not None:
        rows = rows.where(F.col(ts) > F.lit(cursor).cast(rows.schema[ts].dataType))
    return rows.orderBy(ts, ordinal).limit(min(size, WINDOW))


def hash_sample(rows: DataFrame, size: int, seed: int, id_column: str) -> DataFrame:
    """Exactly `size` rows (or all), the same for the same seed."""
    return rows.orderBy(F.md5(F.concat_ws(":", F.col(id_column).cast("string"), F.lit(str(seed)))), id_column).limit(size)
