"""Shapes shared by the registered queries: results rounded and counted alike on both sides."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def tidy(df: DataFrame) -> DataFrame:
    """Doubles rounded to six places, counts as bigint, times without zone."""
    out = []
    for f in df.schema.fields:
        kind = f.dataType.simpleString()
        c = F.col(f"`{f.name}`")
        out.append((F.round(c.cast("double"), 6) if kind in ("double", "float") or kind.startswith("decimal") else c.cast("bigint") if kind in ("int", "smallint", "tinyint") else c.cast("timestamp_ntz") if kind == "timestamp" else c).alias(f.name))
    return df.select(*out)
