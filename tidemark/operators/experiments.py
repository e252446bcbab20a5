"""Parameter grids as one plan: every setting is a part of the entity key."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.config import DetectorSettings
from tidemark.functions.scalars import over
from tidemark.operators.evaluate import evaluate
from tidemark.operators.ranges import smoothed


def threshold_sweep(scores: DataFrame, kpis: list[str], base: DetectorSettings, thresholds: list[float], persistences: list[int], entity: list[str], minutes: float) -> DataFrame:
    """(entity, z_threshold, persistence, metrics) of scored rows, which are smoothed once, then met with the grid.

    The grid is a small literal table; rows grow by its size only after scoring.
    """
    z = smoothed(scores, {f"z_{k}": F.col(f"raw_{k}") for k in kpis}, base.alpha, entity, ["rn"])
    z = z.select(*entity, "rn", "ts", "label", "scenario", *[f"z_{k}" for k in kpis])
    grid = F.array(*[F.struct(F.lit(float(t)).alias("z_threshold"), F.lit(int(p)).alias("persistence")) for t in thresholds for p in persistences])
    g = z.withColumn("g", F.explode(grid)).select("*", "g.*").drop("g")
    keys = [*entity, "z_threshold", "persistence"]
    return evaluate(g.withColumn("alert", _fires(kpis, keys, persistences).cast("int")), keys, minutes=minutes)


def _fires(kpis: list[str], keys: list[str], persistences: list[int]) -> Column:
    """Whether any z_<kpi> has been over the row's z_threshold for as many rows as its persistence asks."""
    order = Window.partitionBy(*keys).orderBy("rn")
    fires = []
    for k in kpis:
        on = over(F.col(f"z_{k}"), F.col("z_threshold"))
        held = [F.when(F.col("persistence") == p, F.sum(on.cast("int")).over(order.rowsBetween(-(p - 1), 0)) == p) for p in persistences]
        fires.append(F.coalesce(*held, F.lit(False)))
    alert = fires[0]
    for f in fires[1:]:
        alert = alert | f
    return alert


def settings_sweep(scores: DataFrame, kpis: list[str], settings: list[DetectorSettings], entity: list[str], minutes: float) -> DataFrame:
    """(entity, alpha, z_threshold, persistence, metrics) of scored rows for each setting once, however often it is listed.

    The settings share bucket_minutes and min_samples, by which the rows are scored; they are smoothed once for each alpha.
    """
    if len({(s.bucket_minutes, s.min_samples) for s in settings}) != 1:
        raise ValueError("the settings of one sweep share bucket_minutes and min_samples")
    alphas = sorted({s.alpha for s in settings})
    z = scores
    for i, a in enumerate(alphas):
        z = smoothed(z, {f"z_{k}_{i}": F.col(f"raw_{k}") for k in kpis}, a, entity, ["rn"])
    z = z.select(*entity, "rn", "ts", "label", "scenario", *[f"z_{k}_{i}" for k in kpis for i in range(len(alphas))])
    each = dict.fromkeys((s.alpha, s.z_threshold, s.persistence) for s in settings)
    cells = F.array(*[F.struct(F.lit(float(a)).alias("alpha"), F.lit(float(t)).alias("z_threshold"), F.lit(int(p)).alias("persistence"), *[F.col(f"z_{k}_{alphas.index(a)}").alias(f"z_{k}") for k in kpis]) for a, t, p in each])
    g = z.select(*entity, "rn", "ts", "label", "scenario", F.explode(cells).alias("g")).select("*", "g.*").drop("g")
    keys = [*entity, "alpha", "z_threshold", "persistence"]
    return evaluate(g.withColumn("alert", _fires(kpis, keys, sorted({s.persistence for s in settings})).cast("int")), keys, minutes=minutes)


def variants(base: DetectorSettings, **lists) -> list[DetectorSettings]:
    """One setting changed at a time."""
    return [replace(base, **{k: v}) for k, values in lists.items() for v in values]
