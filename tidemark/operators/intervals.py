"""Rows of an entity against many segments of it: bins first, then the bounds themselves."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _level(length: Column) -> Column:
    """The least power of two that is not below the length."""
    return F.when(length <= 1, F.lit(0)).otherwise(F.ceil(F.log2(length.cast("double")))).cast("int")


def _bin(at: Column, level: Column) -> Column:
    return F.floor(at.cast("double") / F.pow(F.lit(2.0), level)).cast("long")


def around(rows: DataFrame, segments: DataFrame, entity: list[str], at: str = "rn", start: str = "start_rn", end: str = "end_rn", margin: int = 0) -> DataFrame:
    """Each row with each segment of its entity for which start - margin <= at < end + margin, and the segment's columns.

    A segment falls into two or three bins of its own size, a power of two, and a row into one bin of every size in use;
    they meet by entity, size and bin, and the bounds are checked. So the work follows rows and pairs that are near, not
    the product of an entity's rows and segments. Places are whole numbers below 2^52; an empty segment is near its margin alone.
    Columns of the segments other than the entity must not clash with those of the rows.
    """
    low, high = F.col(start) - margin, F.col(end) + margin
    held = segments.where(high > low).withColumn("_level", _level(high - low))
    bins = F.sequence(_bin(low, F.col("_level")), _bin(high - 1, F.col("_level")))
    held = held.withColumn("_bin", F.explode(bins))
    levels = sorted(r["_level"] for r in held.select("_level").distinct().collect())  # 53 at most
    if not levels:
        levels = [0]
    each = rows.withColumn("_level", F.explode(F.array(*[F.lit(x) for x in levels]))).withColumn("_bin", _bin(F.col(at), F.col("_level")))
    out = each.join(held, [*entity, "_level", "_bin"])
    return out.where((F.col(at) >= low) & (F.col(at) < high)).drop("_level", "_bin")

