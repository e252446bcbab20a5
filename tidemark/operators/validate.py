"""Checks of a labelled series before it is used."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.scalars import bad_sign


def saturation(df: DataFrame, limits: dict[str, tuple[float, float]], by: list[str]) -> DataFrame:
    """(by, kpi, n_low, n_high): rows at the ends of each KPI's range."""
    each = [x for k, (lo, hi) in limits.items() for x in (F.count_if(F.col(k) <= lo + 1e-9).alias(f"_l_{k}"), F.count_if(F.col(k) >= hi - 1e-9).alias(f"_h_{k}"))]
    cells = F.array(*[F.struct(F.lit(k).alias("kpi"), F.col(f"_l_{k}").alias("n_low"), F.col(f"_h_{k}").alias("n_high")) for k in limits])
    return df.groupBy(*by).agg(*each).select(*by, F.explode(cells).alias("c")).select(*by, "c.*")


def bad_deviation(df: DataFrame, directions: dict[str, str], entity: list[str]) -> DataFrame:
    """(entity, scenario, kpi, deviation): the furthest that a KPI goes the wrong way, in sample deviations of normal rows."""
    normal = df.where("scenario = ''").groupBy(*entity).agg(*[x for k in directions for x in (F.avg(k).alias(f"_m_{k}"), F.stddev_samp(k).alias(f"_s_{k}"))])
    inside = df.where("scenario <> ''").join(normal, entity)
    far = [F.max(F.when(F.col(f"_s_{k}") > 0, bad_sign(d) * (F.col(k) - F.col(f"_m_{k}")) / F.col(f"_s_{k}"))).alias(k) for k, d in directions.items()]
    cells = F.array(*[F.struct(F.lit(k).alias("kpi"), F.col(k).alias("deviation")) for k in directions])
    return inside.groupBy(*entity, "scenario").agg(*far).select(*entity, "scenario", F.explode(cells).alias("c")).select(*entity, "scenario", "c.*")


def separation(deviation: DataFrame, load: list[str], by: list[str]) -> DataFrame:
    """(by, least_load, most_quality, ok): under a pure load scenario, load KPIs must move more than quality KPIs."""
    is_load = F.col("kpi").isin(load)
    out = deviation.groupBy(*by).agg(F.min(F.when(is_load, F.col("deviation"))).alias("least_load"), F.max(F.when(~is_load, F.col("deviation"))).alias("most_quality"))
    return out.withColumn("ok", F.coalesce(F.col("least_load") > F.col("most_quality"), F.lit(False)))


def trap(label: str = "label", scenario: str = "scenario") -> Column:
    """Rows of a named scenario that is no anomaly."""
    return F.coalesce((F.col(scenario) != "") & (F.col(label) == 0), F.lit(False))


def label_totals(df: DataFrame, by: list[str]) -> DataFrame:
    """(by, n_rows, n_anomaly, n_trap, anomaly_pct): labelled rows, and rows of scenarios that are no anomaly."""
    return df.groupBy(*by).agg(F.count("*").alias("n_rows"), F.count_if(F.col("label") == 1).alias("n_anomaly"), F.count_if(trap()).alias("n_trap"), (F.avg("label") * 100).alias("anomaly_pct"))


def warmup_purity(df: DataFrame, warmup_rows: int, by: list[str], order: str = "rn") -> DataFrame:
    """(by, label_mean, n_scenario_rows) of the warm-up rows."""
    return df.where(F.col(order) <= warmup_rows).groupBy(*by).agg(F.avg("label").alias("label_mean"), F.count_if(F.col("scenario") != "").alias("n_scenario_rows"))
