"""Count-based windows over ordered rows of an entity.

All windows of one entity and order share one Exchange and one Sort, as they use the same partitioning.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.scalars import aggregate


def numbered(df: DataFrame, entity: list[str], order: list[str], name: str = "rn") -> DataFrame:
    """Rows with their 1-based place in the entity; `order` must be total."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*entity).orderBy(*order)))


def sliding(df: DataFrame, values: list[str], size: int, stride: int = 1, how: str = "mean", entity: list[str] = (), order: list[str] = ("ts",), keep: list[str] = (), number: str | None = None) -> DataFrame:
    """One row for each full window: aggregates of `values`; entity, order and `keep` columns of its last row.
    With `number`, a column of this name has the 1-based number of the window in its entity.

    The first window ends at row max(size, stride), the next ones `stride` rows later each. Windows count
    rows: gaps in time do not matter. Entities with fewer rows give nothing.
    """
    by = Window.partitionBy(*entity).orderBy(*order)
    frame = by.rowsBetween(-(size - 1), 0)
    first = max(size, stride)
    agg = aggregate(how)
    out = df.select(*df.columns, F.row_number().over(by).alias("_rn"), *[agg(F.col(c)).over(frame).alias(f"_w_{c}") for c in values])
    out = out.where((F.col("_rn") >= first) & ((F.col("_rn") - first) % stride == 0))
    rest = [c for c in dict.fromkeys([*entity, *order, *keep]) if c not in values]
    at = [(F.floor((F.col("_rn") - first) / stride) + 1).cast("int").alias(number)] if number else []
    return out.select(*rest, *[F.col(f"_w_{c}").alias(c) for c in values], *at)


def expected_windows(rows: Column, size: int, stride: int) -> Column:
    """How many windows so many rows give, for stride <= size."""
    return F.when(rows < size, F.lit(0)).otherwise(F.floor((rows - size) / F.lit(stride)) + 1).cast("long")


def rolling_zscore(df: DataFrame, value: str, size: int, entity: list[str], order: list[str]) -> DataFrame:
    """df with `z`: distance from the rolling mean in rolling sample deviations; null before a full window."""
    by = Window.partitionBy(*entity).orderBy(*order)
    frame = by.rowsBetween(-(size - 1), 0)
    full = F.row_number().over(by) >= size
    sd = F.stddev_samp(value).over(frame)
    return df.withColumn("z", F.when(full & (sd > 0), (F.col(value) - F.avg(value).over(frame)) / sd))
