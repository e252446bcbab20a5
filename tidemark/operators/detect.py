"""Seasonal baseline, scores, smoothing and alerts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.config import DetectorSettings
from tidemark.functions.scalars import bucket_key, over, trigger, zscore
from tidemark.operators.islands import persisted
from tidemark.operators.ranges import smoothed


def split(df: DataFrame, warmup_rows: int, order: str = "rn") -> tuple[DataFrame, DataFrame]:
    """Training rows are the first warmup_rows of each entity; test rows are renumbered from 1."""
    return df.where(F.col(order) <= warmup_rows), df.where(F.col(order) > warmup_rows).withColumn(order, F.col(order) - warmup_rows)


def bucket_stats(train: DataFrame, kpis: list[str], minutes: int, entity: list[str]) -> DataFrame:
    """A row for each entity and bucket: n, and mean, population deviation and whether constant for each KPI."""
    each = [x for k in kpis for x in (F.avg(k).alias(f"mu_{k}"), F.stddev_pop(k).alias(f"sd_{k}"), (F.min(k) < F.max(k)).alias(f"varies_{k}"))]
    return train.withColumn("bucket", bucket_key(F.col("ts"), minutes)).groupBy(*entity, "bucket").agg(F.count("*").alias("n"), *each)


def global_stats(train: DataFrame, kpis: list[str], entity: list[str]) -> DataFrame:
    return train.groupBy(*entity).agg(*[x for k in kpis for x in (F.avg(k).alias(f"g_mu_{k}"), F.stddev_pop(k).alias(f"g_sd_{k}"))])


def _raw(kpis: list[str], settings: DetectorSettings) -> list[Column]:
    """raw_<kpi>: z-scores against the bucket, or the whole training part. A bucket counts for a KPI if it has min_samples rows that are not all equal."""
    z = []
    for k in kpis:
        own = (F.col("n") >= settings.min_samples) & F.col(f"varies_{k}")
        mu = F.when(own, F.col(f"mu_{k}")).otherwise(F.col(f"g_mu_{k}"))
        sd = F.when(own, F.col(f"sd_{k}")).otherwise(F.col(f"g_sd_{k}"))
        z.append(zscore(F.col(k), mu, sd).alias(f"raw_{k}"))
    return z


def scored(rows: DataFrame, train: DataFrame, kpis: list[str], settings: DetectorSettings, entity: list[str]) -> DataFrame:
    """rows with bucket and raw_<kpi>, learned from another frame.

    Join sides grow with the number of entities, so the choice of broadcasting them is left to the size seen at run time.
    """
    stats = bucket_stats(train, kpis, settings.bucket_minutes, entity)
    whole = global_stats(train, kpis, entity)
    out = rows.withColumn("bucket", bucket_key(F.col("ts"), settings.bucket_minutes))
    out = out.join(stats, [*entity, "bucket"], "left").join(whole, entity, "left")
    return out.select(*rows.columns, "bucket", *_raw(kpis, settings))


def scored_after(frame: DataFrame, kpis: list[str], settings: DetectorSettings, entity: list[str], naive: bool = False, order: str = "rn") -> DataFrame:
    """As scored, for the rows after the first warmup_rows of each entity, learned from those; the frame is read once.

    The moments are windows over the entity and its buckets, which need no other partitioning than the entity's own.
    With `naive`, m_<kpi> and s_<kpi> come along: mean and sample deviation of the training part.
    """
    early = F.col(order) <= settings.warmup_rows
    rows = frame.withColumn("bucket", bucket_key(F.col("ts"), settings.bucket_minutes))
    own, whole = Window.partitionBy(*entity, "bucket"), Window.partitionBy(*entity)
    seen = {k: F.when(early, F.col(k)) for k in kpis}
    stats = [F.count(F.when(early, 1)).over(own).alias("n")]
    for k, v in seen.items():
        stats += [F.avg(v).over(own).alias(f"mu_{k}"), F.stddev_pop(v).over(own).alias(f"sd_{k}"), (F.min(v).over(own) < F.max(v).over(own)).alias(f"varies_{k}")]
        stats += [F.avg(v).over(whole).alias(f"g_mu_{k}"), F.stddev_pop(v).over(whole).alias(f"g_sd_{k}")]
        stats += [F.stddev_samp(v).over(whole).alias(f"s_{k}")] if naive else []
    out = rows.select("*", *stats).where(~early).withColumn(order, F.col(order) - settings.warmup_rows)
    more = [x for k in kpis for x in (F.col(f"g_mu_{k}").alias(f"m_{k}"), F.col(f"s_{k}"))] if naive else []
    return out.select(*frame.columns, "bucket", *_raw(kpis, settings), *more)


def _any(flags: list[Column]) -> Column:
    flags = [f.cast("int") for f in flags]
    return F.greatest(*flags) if len(flags) > 1 else flags[0]


def alerts(scores: DataFrame, kpis: list[str], settings: DetectorSettings, entity: list[str], order: str = "rn", naive_z: float | None = None) -> DataFrame:
    """Scored rows with z_<kpi> (smoothed) in place of raw_<kpi>, alert (0 or 1) and trigger, the KPIs that fire, in the order given.

    With naive_z, naive_alert too: any KPI beyond so many sample deviations of the training part, without season.
    """
    by = Window.partitionBy(*entity).orderBy(order)
    out = smoothed(scores, {f"z_{k}": F.col(f"raw_{k}") for k in kpis}, settings.alpha, entity, [order])
    out = out.select("*", *[persisted(over(F.col(f"z_{k}"), settings.z_threshold), settings.persistence, by).alias(f"_f_{k}") for k in kpis])
    flags = {k: F.col(f"_f_{k}") for k in kpis}
    out = out.withColumn("alert", _any(list(flags.values()))).withColumn("trigger", trigger(flags))
    if naive_z is not None:
        out = out.withColumn("naive_alert", _any([over(zscore(F.col(k), F.col(f"m_{k}"), F.col(f"s_{k}")), naive_z) for k in kpis]))
    gone = {"bucket", *(f"{x}_{k}" for x in ("_f", "raw", "m", "s") for k in kpis)}
    return out.select(*[c for c in out.columns if c not in gone])


def detect(rows: DataFrame, train: DataFrame, kpis: list[str], settings: DetectorSettings, entity: list[str], order: str = "rn") -> DataFrame:
    """rows with z_<kpi>, alert and trigger, by a baseline learned from another frame."""
    return alerts(scored(rows, train, kpis, settings, entity), kpis, settings, entity, order)


def detect_after(frame: DataFrame, kpis: list[str], settings: DetectorSettings, entity: list[str], naive_z: float | None = None, order: str = "rn") -> DataFrame:
    """The rows after the warm-up with z_<kpi>, alert and trigger, and naive_alert with naive_z; the frame is read once."""
    return alerts(scored_after(frame, kpis, settings, entity, naive_z is not None, order), kpis, settings, entity, order, naive_z)


def detect_naive(rows: DataFrame, train: DataFrame, kpis: list[str], z_threshold: float, entity: list[str]) -> DataFrame:
    """rows with alert: any KPI beyond z_threshold sample deviations of the training part, without season."""
    stats = train.groupBy(*entity).agg(*[x for k in kpis for x in (F.avg(k).alias(f"_m_{k}"), F.stddev_samp(k).alias(f"_s_{k}"))])
    flags = [over(zscore(F.col(k), F.col(f"_m_{k}"), F.col(f"_s_{k}")), z_threshold) for k in kpis]
    return rows.join(stats, entity, "left").select(*rows.columns, _any(flags).alias("alert"))
