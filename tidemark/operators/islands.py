"""Runs of consecutive rows: persistence, alert runs, labelled events and what lies inside them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from tidemark.operators.ranges import before


def persisted(flag: Column, n: int, by: WindowSpec) -> Column:
    """True from the n-th consecutive true row on; n <= 1 passes the flag through."""
    flag = F.coalesce(flag, F.lit(False))
    if n <= 1:
        return flag
    return F.sum(flag.cast("int")).over(by.rowsBetween(-(n - 1), 0)) == n


def run_ids(df: DataFrame, flag: str, entity: list[str], order: list[str]) -> DataFrame:
    """Only rows whose flag holds, with `run_id`, the number of the run within the entity, from 1."""
    by = Window.partitionBy(*entity).orderBy(*order)
    on = F.coalesce(F.col(flag).cast("boolean"), F.lit(False))
    edge = on & ~F.coalesce(F.lag(on).over(by), F.lit(False))
    return df.withColumn("_on", on).withColumn("_edge", edge.cast("int")).withColumn("run_id", F.sum("_edge").over(by)).where("_on").drop("_on", "_edge")


def runs(df: DataFrame, flag: str, entity: list[str], order: str = "rn", ts: str = "ts") -> DataFrame:
    """(entity, run_id, start_rn, end_rn, start_ts, end_ts, n_rows): half-open in rows, counted from 0."""
    found = run_ids(df, flag, entity, [order])
    return found.groupBy(*entity, "run_id").agg((F.min(order) - 1).alias("start_rn"), F.max(order).alias("end_rn"), F.min(ts).alias("start_ts"), F.max(ts).alias("end_ts"), F.count("*").alias("n_rows"))


def event_ids(df: DataFrame, scenario: str, entity: list[str], order: list[str]) -> DataFrame:
    """Rows with a non-empty scenario, with `event_id`: a new event wherever the name changes."""
    by = Window.partitionBy(*entity).orderBy(*order)
    name = F.coalesce(F.col(scenario), F.lit(""))
    change = (name != F.lag(name, 1, "").over(by)) & (name != "")
    return df.withColumn("_change", change.cast("int")).withColumn("event_id", F.sum("_change").over(by)).where(name != "").drop("_change")


def events(df: DataFrame, entity: list[str], order: str = "rn", scenario: str = "scenario", label: str = "label") -> DataFrame:
    """(entity, event_id, scenario, start_rn, end_rn, is_anomaly): half-open in rows, counted from 0."""
    found = event_ids(df, scenario, entity, [order])
    return found.groupBy(*entity, "event_id").agg(F.first(scenario).alias("scenario"), (F.min(order) - 1).alias("start_rn"), F.max(order).alias("end_rn"), (F.max(label) > 0).alias("is_anomaly"))


def event_hits(df: DataFrame, entity: list[str], alert: str = "alert", order: str = "rn", minutes: float = 1.0) -> DataFrame:
    """(entity, event_id, scenario, is_anomaly, hit, delay_min): whether and when an alert fell into each event."""
    found = event_ids(df, "scenario", entity, [order])
    first = F.min(F.when(F.col(alert) == 1, F.col(order)))
    out = found.groupBy(*entity, "event_id").agg(F.first("scenario").alias("scenario"), (F.max("label") > 0).alias("is_anomaly"), first.alias("_hit"), F.min(order).alias("_from"))
    return out.select(*entity, "event_id", "scenario", "is_anomaly", F.col("_hit").isNotNull().alias("hit"), ((F.col("_hit") - F.col("_from")) * F.lit(float(minutes))).alias("delay_min"))


def longest_run_without(df: DataFrame, flag: str, other: str, entity: list[str], order: str = "rn") -> DataFrame:
    """For each entity the longest run of `flag` with no row of `other`; the first of equals."""
    found = run_ids(df, flag, entity, [order]).groupBy(*entity, "run_id").agg((F.min(order) - 1).alias("start_rn"), F.max(order).alias("end_rn"), F.count("*").alias("n_rows"), F.max(F.col(other).cast("int")).alias("_other"))
    best = Window.partitionBy(*entity).orderBy(F.desc("n_rows"), "start_rn")
    return found.where("_other = 0").withColumn("_k", F.row_number().over(best)).where("_k = 1").select(*entity, "start_rn", "end_rn", "n_rows")


def best_segment(df: DataFrame, entity: list[str], order: str = "rn", alert: str = "alert", scenario: str | None = None) -> DataFrame:
    """For each entity the stretch under any scenario, or the one given, with most alerts; the first of equals."""
    marked = df.withColumn("_seg", F.col("scenario") == scenario if scenario is not None else F.col("scenario") != "")
    found = run_ids(marked, "_seg", entity, [order]).groupBy(*entity, "run_id").agg((F.min(order) - 1).alias("start_rn"), F.max(order).alias("end_rn"), F.min("ts").alias("start_ts"), F.max("ts").alias("end_ts"), F.sum(alert).cast("long").alias("n_alerts"))
    best = Window.partitionBy(*entity).orderBy(F.desc("n_alerts"), "start_rn")
    return found.withColumn("_k", F.row_number().over(best)).where("_k = 1").drop("_k", "run_id")


def segments(df: DataFrame, entity: list[str], scenario: str | None = None, order: str = "rn") -> DataFrame:
    """(entity, segment, start_rn, end_rn): all stretches under any scenario, or the one given; half-open in rows, counted from 1."""
    marked = df.withColumn("_seg", F.col("scenario") == scenario if scenario is not None else F.col("scenario") != "")
    return run_ids(marked, "_seg", entity, [order]).groupBy(*entity, F.col("run_id").alias("segment")).agg(F.min(order).alias("start_rn"), (F.max(order) + 1).alias("end_rn"))


def regressions(df: DataFrame, partition: str, order: str, position: str) -> DataFrame:
    """(partition, n_regressions): how often a committed position falls below the one before; for partitions of any size."""
    back = before(df, [position], [partition], [order])
    return back.groupBy(partition).agg(F.count_if(F.col(position) < F.col(f"before_{position}")).alias("n_regressions"))
