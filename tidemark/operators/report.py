"""Incident summaries over a segment, from SQL aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.scalars import guarded, larger


def in_segment(start: Column, end: Column) -> Column:
    """Half-open: the row at `end` is out."""
    return (F.col("ts") >= start) & (F.col("ts") < end)


def segment_stats(metrics: DataFrame, kpis: list[str], by: list[str]) -> DataFrame:
    return metrics.groupBy(*by).agg(F.count("*").alias("n_rows"), *[f(k).alias(f"{n}_{k}") for k in kpis for n, f in (("avg", F.avg), ("max", F.max), ("min", F.min))])


def normal_stats(metrics: DataFrame, kpis: list[str], by: list[str]) -> DataFrame:
    """Mean and sample deviation of rows under no scenario."""
    return metrics.where("scenario = ''").groupBy(*by).agg(*[x for k in kpis for x in (F.avg(k).alias(f"mean_{k}"), F.stddev_samp(k).alias(f"std_{k}"))])


def alert_stats(alerts: DataFrame, by: list[str]) -> DataFrame:
    return alerts.groupBy(*by).agg(F.sum("alert").cast("long").alias("n_alerts"), F.min(F.when(F.col("alert") == 1, F.col("ts"))).alias("first_alert"))


def top_triggers(alerts: DataFrame, by: list[str], n: int = 5) -> DataFrame:
    """The n most frequent triggers of each group; ties by the trigger's text."""
    count = alerts.where("trigger <> ''").groupBy(*by, "trigger").agg(F.count("*").alias("n"))
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("n"), "trigger"))
    return count.withColumn("rank", rank).where(F.col("rank") <= n)


def segment_and_normal(rows: DataFrame, kpis: list[str], by: list[str]) -> DataFrame:
    """segment_stats of the rows with `inside` and normal_stats of all rows, in one aggregate; groups without such rows are left out."""
    here, normal = (lambda c: F.when(F.col("inside"), F.col(c))), (lambda c: F.when(F.col("scenario") == "", F.col(c)))
    each = [f(v(k)).alias(f"{n}_{k}") for k in kpis for n, f, v in (("avg", F.avg, here), ("max", F.max, here), ("min", F.min, here), ("mean", F.avg, normal), ("std", F.stddev_samp, normal))]
    return rows.groupBy(*by).agg(F.count_if("inside").alias("n_rows"), F.count_if(F.col("scenario") == "").alias("_normal"), *each).where("n_rows > 0 and _normal > 0").drop("_normal")


def deviations(both: DataFrame, kpis: list[str], by: list[str]) -> DataFrame:
    """(by, kpi, position, avg_dev, max_dev, rank) of segment_and_normal: distances from normal in deviations, the furthest first."""
    each = []
    for i, k in enumerate(kpis):
        m, sd = F.col(f"mean_{k}"), guarded(F.col(f"std_{k}"))
        each.append(F.struct(F.lit(k).alias("kpi"), F.lit(i).alias("position"), ((F.col(f"avg_{k}") - m) / sd).alias("avg_dev"), larger((F.col(f"max_{k}") - m) / sd, (F.col(f"min_{k}") - m) / sd).alias("max_dev")))
    out = both.select(*by, F.explode(F.array(*each)).alias("d")).select(*by, "d.*")
    return out.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(F.abs(F.round("max_dev", 9))), "position")))


def in_best_segment(df: DataFrame, entity: list[str], scenario: str | None = None, order: str = "rn", alert: str = "alert", last: bool = False) -> DataFrame:
    """df with start_ts and end_ts of the entity's segment with most alerts (the first of equals), and inside, whether the row is in [start_ts, end_ts).

    end_ts is the segment's last row, which is inside with `last` alone. A segment is a stretch under any scenario, or under the one given. All is windows over the entity; nothing is joined.
    """
    by = Window.partitionBy(*entity).orderBy(order)
    on = F.col("scenario") == scenario if scenario is not None else F.col("scenario") != ""
    on = F.coalesce(on, F.lit(False))
    rows = df.withColumn("_on", on).withColumn("_edge", (on & ~F.coalesce(F.lag(on).over(by), F.lit(False))).cast("int"))
    rows = rows.withColumn("_seg", F.when(F.col("_on"), F.sum("_edge").over(by)))
    one = Window.partitionBy(*entity, "_seg")
    found = F.when(F.col("_on"), F.struct(F.sum(alert).over(one).alias("n"), (-F.min(order).over(one)).alias("from"), F.min("ts").over(one).alias("start_ts"), F.max("ts").over(one).alias("end_ts")))
    rows = rows.withColumn("_found", found).withColumn("_best", F.max("_found").over(Window.partitionBy(*entity)))
    start, end = F.col("_best.start_ts"), F.col("_best.end_ts")
    inside = F.coalesce(F.col("ts").between(start, end) if last else in_segment(start, end), F.lit(False))
    return rows.select(*df.columns, F.col("_best.start_ts").alias("start_ts"), F.col("_best.end_ts").alias("end_ts"), inside.alias("inside"))


def summary(frame: DataFrame, kpis: list[str], entity: list[str], z_threshold: float, scenario: str | None = None, most: int = 5) -> DataFrame:
    """(entity, summary): one JSON document for the segment of every entity with one, from rows with alert and trigger.

    Rows of the segment, alerts and the first of them, the most frequent triggers (ties by their text), and for every
    KPI the means, the distances from normal in sample deviations and whether it fired, the furthest from normal first;
    the threshold, and the KPIs that fired and that did not, by the triggers listed. The frame is read once, in one
    aggregate by entity.
    """
    rows = in_best_segment(frame, entity, scenario).where("start_ts is not null")
    told = F.col("inside") & (F.col("trigger") != "")
    rows = rows.withColumn("_n", F.count(F.when(told, 1)).over(Window.partitionBy(*entity, "trigger")))
    here, normal = (lambda c: F.when(F.col("inside"), F.col(c))), (lambda c: F.when(F.col("scenario") == "", F.col(c)))
    aggregates = [F.count_if("inside").alias("n_rows"), F.coalesce(F.sum(here("alert")), F.lit(0)).cast("long").alias("n_alerts"), F.min(F.when(F.col("inside") & (F.col("alert") == 1), F.col("ts"))).alias("first_alert")]
    aggregates += [f(v(k)).alias(f"{n}_{k}") for k in kpis for n, f, v in (("avg", F.avg, here), ("max", F.max, here), ("min", F.min, here), ("mean", F.avg, normal), ("std", F.stddev_samp, normal))]
    counted = F.collect_set(F.when(told, F.struct((-F.col("_n")).alias("less"), "trigger")))  # one for each set of KPIs that fired together
    out = rows.groupBy(*entity, "start_ts", "end_ts").agg(*aggregates, counted.alias("_triggers"))
    out = out.withColumn("triggers", F.transform(F.slice(F.array_sort("_triggers"), 1, most), lambda t: F.struct(t["trigger"].alias("trigger"), (-t["less"]).alias("n"))))
    out = out.withColumn("fired", F.array_sort(F.array_distinct(F.flatten(F.transform("triggers", lambda t: F.split(t["trigger"], ","))))))
    each = []
    for i, k in enumerate(kpis):
        m, sd = F.col(f"mean_{k}"), guarded(F.col(f"std_{k}"))
        far = F.round(larger((F.col(f"max_{k}") - m) / sd, (F.col(f"min_{k}") - m) / sd), 2)
        each.append(F.struct((-F.abs(far)).alias("less"), F.lit(i).alias("position"), F.lit(k).alias("kpi"), F.round(m, 3).alias("normal_mean"), F.round(f"avg_{k}", 3).alias("segment_mean"), F.round((F.col(f"avg_{k}") - m) / sd, 2).alias("avg_dev"), far.alias("max_dev"), F.array_contains("fired", k).alias("fired")))
    deviations = F.transform(F.array_sort(F.array(*each)), lambda d: d.dropFields("less", "position"))
    doc = F.struct("start_ts", "end_ts", "n_rows", "n_alerts", "first_alert", "triggers", deviations.alias("deviations"), F.lit(float(z_threshold)).alias("z_threshold"), "fired", F.array_sort(F.array_except(F.array(*map(F.lit, kpis)), F.col("fired"))).alias("not_fired"))
    return out.select(*entity, F.to_json(doc).alias("summary"))


SUMMARY = "start_ts timestamp_ntz, end_ts timestamp_ntz, n_rows long, n_alerts long, first_alert timestamp_ntz, triggers array<struct<trigger:string,n:long>>, deviations array<struct<kpi:string,normal_mean:double,segment_mean:double,avg_dev:double,max_dev:double,fired:boolean>>, z_threshold double, fired array<string>, not_fired array<string>"


def fields(documents: DataFrame, entity: list[str]) -> DataFrame:
    """A row for every KPI of every document, with the document's own fields; lists as text."""
    parsed = documents.select(*entity, F.from_json("summary", SUMMARY).alias("d")).select(*entity, "d.*", F.posexplode("d.deviations").alias("rank", "k"))
    triggers = F.array_join(F.transform("triggers", lambda t: F.concat(t["trigger"], F.lit(":"), t["n"].cast("string"))), " ")
    return parsed.select(*entity, "start_ts", "end_ts", "n_rows", "n_alerts", "first_alert", triggers.alias("triggers"), (F.col("rank") + 1).alias("rank"), "k.kpi", "k.normal_mean", "k.segment_mean", "k.avg_dev", "k.max_dev", F.col("k.fired").alias("kpi_fired"), "z_threshold", F.array_join("fired", ",").alias("fired"), F.array_join("not_fired", ",").alias("not_fired"))


def narrative(row: dict) -> str:
    """A plain sentence for a summary document; stands in for text from a language model."""
    worst = (row.get("deviations") or [{}])[0]
    return f"{row['n_alerts']} alerts from {row['start_ts']} to {row['end_ts']}; furthest from normal: {worst.get('kpi', '-')} at {worst.get('max_dev', 0)} deviations."
