"""KPI frames derived from the events table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.config import DetectorSettings
from tidemark.operators.detect import detect_after, detect_naive, scored_after, split
from tidemark.operators.windows import numbered, sliding

CELLS, WARMUP, SIZE = 4, 168, 3
KPIS = ["load", "errors", "avg_value"]
ENTITY = ["cell"]
SETTINGS = DetectorSettings(bucket_minutes=60, min_samples=5, z_threshold=1.0, alpha=0.4, persistence=2, warmup_rows=WARMUP)
NAIVE_Z = 1.5


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet")


def kpi_hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(cell, ts, load, errors, avg_value, rn, label, scenario): every cell and hour of the time span.

    Two scans: one of all rows, one of the bounds. All else is windows over the cell, which share one exchange. Sums are
    of whole cents, so they do not depend on the order of rows.
    """
    ev = events(spark, sf_dir)
    hour = F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("ts")
    rows = ev.select((F.col("user_id") % CELLS).cast("int").alias("cell"), hour, "event_type", F.round(F.col("value") * 100).cast("long").alias("cents"))
    each = rows.groupBy("cell", "ts").agg(F.count("*").alias("load"), F.count_if(F.col("event_type") == "error").alias("errors"), F.count_if(F.col("event_type") == "view").alias("views"), F.sum("cents").alias("cents"))
    span = ev.agg(F.min("ts").alias("lo"), F.max("ts").alias("hi")).select(*[F.date_trunc("hour", c).cast("timestamp_ntz").alias(c) for c in ("lo", "hi")])
    by, whole, step = Window.partitionBy("cell").orderBy("ts"), Window.partitionBy("cell"), F.expr("interval 1 hour")
    placed = each.withColumn("_first", F.row_number().over(by) == 1).withColumn("_next", F.lead("ts").over(by)).crossJoin(F.broadcast(span))  # one row of bounds
    hours = F.sequence(F.when(F.col("_first"), F.col("lo")).otherwise(F.col("ts")), F.coalesce(F.col("_next") - step, F.col("hi")), step)
    dense = placed.withColumn("at", F.explode(hours))
    n = {c: F.when(F.col("at") == F.col("ts"), F.col(c)).otherwise(F.lit(0)) for c in ("load", "errors", "views", "cents")}
    out = dense.select("cell", F.col("at").alias("ts"), *[v.alias(c) for c, v in n.items()])
    out = out.select("*", *[F.percentile(c, F.lit(0.9)).over(whole).alias(f"p_{c}") for c in ("errors", "views")])
    high = {c: (F.col(c) >= F.col(f"p_{c}")) & (F.col(c) > 0) for c in ("errors", "views")}
    out = out.withColumn("scenario", F.when(high["errors"], "error_burst").when(high["views"], "view_surge").otherwise(""))
    value = F.when(F.col("load") > 0, F.col("cents") / 100.0 / F.col("load")).otherwise(0.0)
    out = out.select("cell", "ts", F.col("load").cast("double").alias("load"), F.col("errors").cast("double").alias("errors"), value.alias("avg_value"), (F.col("scenario") == "error_burst").cast("int").alias("label"), "scenario")
    return numbered(out, ENTITY, ["ts"])


def windowed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sliding(kpi_hourly(spark, sf_dir).drop("rn"), KPIS, SIZE, 1, "mean", ENTITY, ["ts"], ["label", "scenario"], number="rn")


def parts(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Training and test rows."""
    return split(windowed(spark, sf_dir), WARMUP)


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Test rows with bucket and raw_<kpi>."""
    return scored_after(windowed(spark, sf_dir), KPIS, SETTINGS, ENTITY)


def detected(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect_after(windowed(spark, sf_dir), KPIS, SETTINGS, ENTITY)


def compared(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Test rows with the alerts of both detectors, alert and naive_alert."""
    return detect_after(windowed(spark, sf_dir), KPIS, SETTINGS, ENTITY, NAIVE_Z)


def naive(spark: SparkSession, sf_dir: str) -> DataFrame:
    train, test = parts(spark, sf_dir)
    return detect_naive(test, train, KPIS, NAIVE_Z, ENTITY)
