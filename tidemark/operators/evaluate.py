"""Event-wise evaluation of alerts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.scalars import ratio
from tidemark.operators.islands import event_hits

NORMAL = "정상 구간"  # fixed value: the text for the normal period


def marked(df: DataFrame, entity: list[str], alert: str = "alert", order: str = "rn") -> DataFrame:
    """df with run_id and event_id, the numbers of a row's alert run and event (null in none), and covered.

    An event is a stretch of one non-empty scenario. It is an anomaly as a whole if any of its rows has a label: covered
    holds on all rows of such events.
    """
    by = Window.partitionBy(*entity).orderBy(order)
    on, name = F.coalesce(F.col(alert).cast("boolean"), F.lit(False)), F.coalesce(F.col("scenario"), F.lit(""))
    rows = df.select("*", (on & ~F.coalesce(F.lag(on).over(by), F.lit(False))).cast("int").alias("_run"), ((name != F.lag(name, 1, "").over(by)) & (name != "")).cast("int").alias("_event"))
    rows = rows.withColumn("run_id", F.when(on, F.sum("_run").over(by))).withColumn("event_id", F.when(name != "", F.sum("_event").over(by)))
    labelled = F.max("label").over(Window.partitionBy(*entity, "event_id")) > 0
    return rows.withColumn("covered", F.coalesce(F.col("event_id").isNotNull() & labelled, F.lit(False))).drop("_run", "_event")


def alert_runs(df: DataFrame, entity: list[str], alert: str = "alert", order: str = "rn") -> DataFrame:
    """(entity, run_id, start_rn, end_rn, is_false, location): a run of which no row lies in an anomaly event is false.

    location: the distinct scenarios that the run overlaps, sorted and joined by commas, or the normal period.
    """
    names = F.array_join(F.array_sort(F.collect_set(F.when(F.col("scenario") != "", F.col("scenario")))), ",")
    out = marked(df, entity, alert, order).where("run_id is not null").groupBy(*entity, "run_id").agg((F.min(order) - 1).alias("start_rn"), F.max(order).alias("end_rn"), (~F.max("covered")).alias("is_false"), names.alias("_names"))
    return out.select(*entity, "run_id", "start_rn", "end_rn", "is_false", F.when(F.col("_names") == "", F.lit(NORMAL)).otherwise(F.col("_names")).alias("location"))


def scores(tp: Column, fn: Column, fp: Column) -> list[Column]:
    p, r = ratio(tp, tp + fp), ratio(tp, tp + fn)
    return [p.alias("precision"), r.alias("recall"), ratio(2 * p * r, p + r).alias("f1")]


def evaluate(df: DataFrame, entity: list[str], alert: str = "alert", order: str = "rn", minutes: float = 1.0) -> DataFrame:
    """A row for each entity: tp, fn, fp, precision, recall, f1 and mean minutes to detection (NaN without a hit).

    df is read once: alert runs and events are numbered in one window pass, and every row counts for its run and for its
    event in one aggregate by unit. A run is false if no row of it lies in an anomaly event, whatever the row's own label.
    """
    rows = marked(df, entity, alert, order).select(*entity, F.col(order).alias("_at"), "run_id", "event_id", "covered")
    unit = lambda k: F.struct(F.lit(k).alias("kind"), F.col(f"{k}_id").alias("id"))
    rows = rows.select("*", F.explode(F.array(unit("run"), unit("event"))).alias("_unit"))
    units = rows.groupBy(*entity, "_unit").agg(F.max("covered").alias("covered"), F.min(F.when(F.col("run_id").isNotNull(), F.col("_at"))).alias("hit"), F.min("_at").alias("first"))
    there, event = F.col("_unit.id").isNotNull(), F.col("_unit.kind") == "event"
    wanted, hit = there & event & F.col("covered"), F.col("hit").isNotNull()
    delay = F.when(wanted, (F.col("hit") - F.col("first")) * F.lit(float(minutes)))
    out = units.groupBy(*entity).agg(F.count_if(wanted & hit).alias("tp"), F.count_if(wanted & ~hit).alias("fn"), F.count_if(there & ~event & ~F.col("covered")).alias("fp"), F.avg(delay).alias("_mttd"))
    return out.select(*entity, "tp", "fn", "fp", *scores(F.col("tp"), F.col("fn"), F.col("fp")), F.coalesce("_mttd", F.lit(float("nan"))).alias("mttd_min"))


def both_detectors(df: DataFrame, detectors: dict[str, str]) -> DataFrame:
    """Rows once for each detector, with its name in `detector` and its alerts in `alert`."""
    each = F.array(*[F.struct(F.lit(n).alias("detector"), F.col(c).cast("int").alias("_a")) for n, c in detectors.items()])
    out = df.withColumn("_d", F.explode(each))
    return out.drop("alert").select(*[c for c in df.columns if c != "alert"], "_d.detector", F.col("_d._a").alias("alert"))


def per_scenario(df: DataFrame, entity: list[str], alert: str = "alert", order: str = "rn", minutes: float = 1.0) -> DataFrame:
    """(entity, scenario, total, hit, mean_delay_min, delays_min) of labelled events; events without a hit have no delay."""
    return event_hits(df, entity, alert, order, minutes).where("is_anomaly").groupBy(*entity, "scenario").agg(F.count("*").alias("total"), F.count_if("hit").alias("hit"), F.avg("delay_min").alias("mean_delay_min"), F.sort_array(F.collect_list("delay_min")).alias("delays_min"))


def false_by_location(df: DataFrame, entity: list[str], alert: str = "alert", order: str = "rn") -> DataFrame:
    return alert_runs(df, entity, alert, order).where("is_false").groupBy(*entity, "location").agg(F.count("*").alias("n_false"))


def reduction(proposed: Column, base: Column) -> Column:
    """Percent fewer false alerts than the base; NaN where the base has none."""
    return F.when(base != 0, (1 - proposed / base) * 100).otherwise(F.lit(float("nan")))


def pointwise(df: DataFrame, alert: str, entity: list[str]) -> DataFrame:
    """(entity, tp, fp, fn, precision, recall, f1) row by row."""
    a, y = F.col(alert) == 1, F.col("label") == 1
    out = df.groupBy(*entity).agg(F.count_if(a & y).alias("tp"), F.count_if(a & ~y).alias("fp"), F.count_if(~a & y).alias("fn"))
    return out.select(*entity, "tp", "fp", "fn", *scores(F.col("tp"), F.col("fn"), F.col("fp")))


def across(df: DataFrame, values: list[str], by: list[str]) -> DataFrame:
    """Mean, population deviation, least and greatest of each value over seeds or runs; NaN does not count."""
    v = {c: F.when(~F.isnan(c), F.col(c)) for c in values}
    return df.groupBy(*by).agg(*[f(x).alias(f"{c}_{n}") for c, x in v.items() for n, f in (("mean", F.avg), ("std", F.stddev_pop), ("min", F.min), ("max", F.max))])
