"""Frames to plot: series thinned to a width in pixels without losing their extremes, and shaded intervals."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.islands import runs


def thinned(df: DataFrame, values: list[str], entity: list[str], pixels: int, order: str = "rn", flags: list[str] = ()) -> DataFrame:
    """(entity, pixel, start, end, n_rows, min_, max_, first_, last_<value>..., n_<flag>...): a row for each pixel with any rows.

    Rows are dealt to pixels by their place in the entity: pixel = (place - 1) * pixels // rows. Drawing a line from
    first over min and max to last of every pixel gives the picture of the whole series at that width. Null and NaN
    values do not count as least or greatest.
    """
    whole = Window.partitionBy(*entity)
    place = F.row_number().over(whole.orderBy(order)).cast("long")
    rows = df.select("*", place.alias("_place"), F.count("*").over(whole).alias("_rows"))
    rows = rows.withColumn("pixel", F.floor((F.col("_place") - 1) * pixels / F.col("_rows")).cast("int"))
    each = []
    for v in values:
        sound = F.when(~F.isnan(v), F.col(v))
        each += [F.min(sound).alias(f"min_{v}"), F.max(sound).alias(f"max_{v}"), F.min_by(v, order).alias(f"first_{v}"), F.max_by(v, order).alias(f"last_{v}")]
    return rows.groupBy(*entity, "pixel").agg(F.min("ts").alias("start"), F.max("ts").alias("end"), F.count("*").alias("n_rows"), *each, *[F.sum(F.col(f).cast("long")).alias(f"n_{f}") for f in flags])


def shaded(df: DataFrame, entity: list[str], flags: dict[str, str], order: str = "rn") -> DataFrame:
    """(entity, kind, start_rn, end_rn, start_ts, end_ts, n_rows): the intervals to shade under each kind's flag."""
    each = F.array(*[F.struct(F.lit(kind).alias("kind"), F.col(flag).cast("boolean").alias("_on")) for kind, flag in flags.items()])
    rows = df.select(*entity, order, "ts", F.explode(each).alias("_f")).select(*entity, order, "ts", "_f.*")
    return runs(rows, "_on", [*entity, "kind"], order).drop("run_id")
