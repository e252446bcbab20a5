"""Windows over ordered rows that do not hold an entity in one task.

Rows are dealt to ranges of the first order column, whose bounds are quantiles of the whole table. Counts of each entity
in each range, summed over the ranges before, number its rows; the last rows of a range go along into the ranges after,
as far as a window that ends there can reach back. So a window is complete in one range, an entity of any size is spread
over all ranges, and what is moved twice is at most `before` rows for each entity and range.
"""

from __future__ import annotations

import math

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.scalars import aggregate

ACCURACY = 10_000  # ranges are within 1 / ACCURACY of all rows of their intended size


def _number(df: DataFrame, column: str) -> Column:
    kind = df.schema[column].dataType
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return F.unix_micros(F.col(column).cast("timestamp")).cast("double")
    if isinstance(kind, T.NumericType):
        return F.col(column).cast("double")
    raise ValueError(f"{column}: the first order column is a number or a time, not {kind.simpleString()}")


def in_ranges(df: DataFrame, order: str, parts: int | None = None) -> DataFrame:
    """df with `_range`, the number of each row's range. Equal values share a range; null comes before all, NaN after.

    The driver holds the bounds, one for each range.
    """
    parts = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keyed = df.withColumn("_at", _number(df, order))
    steps = [i / parts for i in range(1, parts)]
    known = keyed.where("not isnan(_at)").agg(F.percentile_approx("_at", F.lit(steps), F.lit(ACCURACY))).first()[0] if steps else None
    bounds = sorted({float(x) for x in known or []} - {math.inf, -math.inf})
    if not bounds:
        return keyed.withColumn("_range", F.when(F.col("_at").isNull(), -1).when(F.isnan("_at"), 1).otherwise(0)).drop("_at")
    place = Bucketizer(splits=[-math.inf, *bounds, math.inf], inputCol="_at", outputCol="_range", handleInvalid="keep")
    return place.transform(keyed).withColumn("_range", F.coalesce(F.col("_range").cast("int"), F.lit(-1))).drop("_at")


def placed(df: DataFrame, entity: list[str], order: list[str], before: int = 0, parts: int | None = None) -> DataFrame:
    """df with `_range`, `rn`, the 1-based place of a row in its entity, and `_ahead`: (range, first rn) of later ranges.

    `order` must be total within an entity. `_ahead` has the ranges of the entity that begin at most `before` rows
    after the end of this one.
    """
    rows = in_ranges(df, order[0], parts)
    by = Window.partitionBy(*entity).orderBy("_range")
    counts = rows.groupBy(*entity, "_range").agg(F.count("*").alias("_n"))
    counts = counts.withColumn("_first", F.coalesce(F.sum("_n").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) + 1)
    ahead = F.collect_list(F.struct("_range", "_first")).over(by.rowsBetween(1, before)) if before else F.array().cast("array<struct<_range:int,_first:bigint>>")
    counts = counts.withColumn("_ahead", F.filter(ahead, lambda x: x["_first"] - F.col("_first") - F.col("_n") < before))
    counts = counts.select(*[F.col(c).alias(f"_e_{c}") for c in entity], F.col("_range").alias("_e_range"), "_first", "_ahead")
    here = F.col("_range") == F.col("_e_range")
    for c in entity:
        here = here & F.col(c).eqNullSafe(F.col(f"_e_{c}"))
    joined = rows.join(counts, here).drop("_e_range", *[f"_e_{c}" for c in entity])
    local = F.row_number().over(Window.partitionBy(*entity, "_range").orderBy(*order))
    return joined.withColumn("rn", (local + F.col("_first") - 1).cast("long")).drop("_first")


def with_halo(df: DataFrame, entity: list[str], order: list[str], before: int, parts: int | None = None) -> tuple[DataFrame, Window]:
    """(rows, window): df with `rn` and `_own`, and the window for frames of up to `before` rows back.

    Results are right on rows with `_own`; the others are there for the sake of these alone.
    """
    rows = placed(df, entity, order, before, parts)
    reached = F.filter("_ahead", lambda x: x["_first"] - F.col("rn") <= before)
    own = F.struct(F.col("_range").alias("_to"), F.lit(True).alias("_own"))
    to = F.concat(F.array(own), F.transform(reached, lambda x: F.struct(x["_range"].alias("_to"), F.lit(False).alias("_own"))))
    out = rows.withColumn("_go", F.explode(to)).select(*df.columns, "rn", "_go.*")
    return out, Window.partitionBy(*entity, "_to").orderBy("rn")


def sliding(df: DataFrame, values: list[str], size: int, stride: int = 1, how: str = "mean", entity: list[str] = (), order: list[str] = ("ts",), keep: list[str] = (), parts: int | None = None) -> DataFrame:
    """As windows.sliding, for entities of any size."""
    needed = list(dict.fromkeys([*entity, *order, *keep, *values]))
    rows, by = with_halo(df.select(*needed), list(entity), list(order), size - 1, parts)
    first, agg = max(size, stride), aggregate(how)
    out = rows.select("*", *[agg(F.col(c)).over(by.rowsBetween(-(size - 1), 0)).alias(f"_w_{c}") for c in values])
    out = out.where(F.col("_own") & (F.col("rn") >= first) & ((F.col("rn") - first) % stride == 0))
    return out.select(*[c for c in needed if c not in values], *[F.col(f"_w_{c}").alias(c) for c in values])


def rolling_zscore(df: DataFrame, value: str, size: int, entity: list[str], order: list[str], parts: int | None = None) -> DataFrame:
    """As windows.rolling_zscore, for entities of any size."""
    rows, by = with_halo(df, entity, order, size - 1, parts)
    frame = by.rowsBetween(-(size - 1), 0)
    sd = F.stddev_samp(value).over(frame)
    z = F.when((F.col("rn") >= size) & (sd > 0), (F.col(value) - F.avg(value).over(frame)) / sd)
    return rows.withColumn("z", z).where("_own").select(*df.columns, "z")


def before(df: DataFrame, columns: list[str], entity: list[str], order: list[str], parts: int | None = None) -> DataFrame:
    """df with before_<column>: the value in the row before of the entity, null in its first row."""
    rows, by = with_halo(df, entity, order, 1, parts)
    out = rows.select("*", *[F.lag(c).over(by).alias(f"before_{c}") for c in columns])
    return out.where("_own").select(*df.columns, *[f"before_{c}" for c in columns])


def chunk_rows(alpha: float) -> int:
    """Rows of a chunk, over which a weight falls by a factor of about 1e-150: the cube of it is 0 in a double."""
    return max(1, math.floor(150 * math.log(10) / -math.log1p(-alpha)))


def _terms(values: dict[str, Column], alpha: float, rn: Column) -> tuple[Column, Column, list[Column]]:
    """A row's chunk, its place in it, and what it adds to the running sums of its chunk."""
    size = chunk_rows(alpha)
    chunk, place = F.floor((rn - 1) / size).cast("long"), F.pmod(rn - 1, F.lit(size)).cast("double")
    weight = F.when(rn == 1, F.lit(1.0)).otherwise(F.lit(float(alpha))) * F.pow(F.lit(1.0 - alpha), -place)
    return chunk, place, [(F.coalesce(v.cast("double"), F.lit(float("nan"))) * weight).alias(f"_t_{k}") for k, v in values.items()]


def _smooth(k: str, alpha: float, one: Column, two: Column, spoiled: Column) -> Column:
    """The smoothed value, from the chunk's running sum and the ends of the two chunks before."""
    beta, fall = 1.0 - alpha, (1.0 - alpha) ** chunk_rows(alpha)
    carried = F.coalesce(one, F.lit(0.0)) + F.lit(fall) * F.coalesce(two, F.lit(0.0))
    own = F.pow(F.lit(beta), F.col("_place")) * F.col(f"_s_{k}")
    return F.when(F.coalesce(spoiled, F.lit(False)), F.lit(float("nan"))).otherwise(own + F.pow(F.lit(beta), F.col("_place") + 1) * carried)


def smoothed(df: DataFrame, values: dict[str, Column], alpha: float, entity: list[str], order: list[str]) -> DataFrame:
    """df with exponentially smoothed columns: the first value, then alpha * value + (1 - alpha) * the one before.

    NaN stays NaN from then on, and null counts as NaN. The recurrence is a composition of maps x -> a x + b: chunks of
    consecutive rows compose theirs by a running sum of values weighted by powers of 1 / (1 - alpha), and a chunk starts
    from the ends of the two before it; the third before would weigh less than the least double. Any alpha in (0, 1].
    """
    if alpha >= 1:
        return df.select("*", *[F.coalesce(v.cast("double"), F.lit(float("nan"))).alias(k) for k, v in values.items()]) if values else df
    by = Window.partitionBy(*entity).orderBy(*order)
    rows = df.withColumn("_rn", F.row_number().over(by))
    chunk, place, terms = _terms(values, alpha, F.col("_rn"))
    rows = rows.select("*", chunk.alias("_chunk"), place.alias("_place"), *terms)
    inside = Window.partitionBy(*entity, "_chunk").orderBy("_rn")
    rows = rows.select("*", *[F.sum(f"_t_{k}").over(inside).alias(f"_s_{k}") for k in values])
    last = F.col("_place") == chunk_rows(alpha) - 1
    rows = rows.select("*", *[F.when(last, F.pow(F.lit(1.0 - alpha), F.col("_place")) * F.col(f"_s_{k}")).alias(f"_l_{k}") for k in values])
    chunks = Window.partitionBy(*entity).orderBy("_chunk")
    out = [_smooth(k, alpha, F.max(f"_l_{k}").over(chunks.rangeBetween(-1, -1)), F.max(f"_l_{k}").over(chunks.rangeBetween(-2, -2)), F.max(F.isnan(f"_l_{k}")).over(chunks.rangeBetween(Window.unboundedPreceding, -1))).alias(k) for k in values]
    return rows.select(*df.columns, *out)


def smoothed_ranges(df: DataFrame, values: list[str], alpha: float, entity: list[str], order: list[str], parts: int | None = None) -> DataFrame:
    """df with smooth_<value>: as smoothed, for entities of any size. A chunk is a group of its own; their ends are joined."""
    named = {v: F.col(v) for v in values}
    if alpha >= 1:
        return df.select("*", *[F.coalesce(F.col(v).cast("double"), F.lit(float("nan"))).alias(f"smooth_{v}") for v in values])
    rows = placed(df, entity, order, 0, parts)
    chunk, place, terms = _terms(named, alpha, F.col("rn"))
    rows = rows.select(*df.columns, "rn", chunk.alias("_chunk"), place.alias("_place"), *terms)
    inside = Window.partitionBy(*entity, "_chunk").orderBy("rn")
    rows = rows.select("*", *[F.sum(f"_t_{v}").over(inside).alias(f"_s_{v}") for v in values])
    last = F.col("_place") == chunk_rows(alpha) - 1
    ends = rows.where(last).select(*entity, "_chunk", *[(F.pow(F.lit(1.0 - alpha), F.col("_place")) * F.col(f"_s_{v}")).alias(f"_l_{v}") for v in values])
    by = Window.partitionBy(*entity).orderBy("_chunk")
    carried = [x for v in values for x in (F.col(f"_l_{v}").alias(f"_1_{v}"), F.lag(f"_l_{v}").over(by).alias(f"_2_{v}"), (F.max(F.isnan(f"_l_{v}")).over(by.rowsBetween(Window.unboundedPreceding, 0))).alias(f"_x_{v}"))]
    ends = ends.select(*[F.col(c).alias(f"_e_{c}") for c in entity], (F.col("_chunk") + 1).alias("_e_chunk"), *carried)
    here = F.col("_chunk") == F.col("_e_chunk")
    for c in entity:
        here = here & F.col(c).eqNullSafe(F.col(f"_e_{c}"))
    out = rows.join(ends, here, "left")
    return out.select(*df.columns, *[_smooth(v, alpha, F.col(f"_1_{v}"), F.col(f"_2_{v}"), F.col(f"_x_{v}")).alias(f"smooth_{v}") for v in values])
