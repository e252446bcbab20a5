"""Queries by name. Floats are rounded to six places, here and in the SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions.scalars import bucket_key, broker_partition, elapsed_ms, over
from tidemark.operators import detect as D
from tidemark.operators import evaluate as V
from tidemark.operators import experiments, intervals, islands, plots, ranges, reconcile, report, validate
from tidemark.operators.windows import expected_windows, rolling_zscore, sliding
from tidemark.plans.frames import ENTITY, KPIS, NAIVE_Z, SETTINGS, SIZE, WARMUP, compared, detected, events, kpi_hourly, naive, parts, scores, windowed
from tidemark.streaming import replay
from tidemark.streaming.sink import first_wins, latency
from tidemark.streaming.windows import keyed_windows, state_store

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
THRESHOLDS, PERSISTENCES, ALPHAS = [0.8, 1.0, 1.5, 2.0], [1, 2, 3], [0.3, 0.4, 0.6]
DIRECTIONS = {"load": "higher_is_worse", "errors": "higher_is_worse", "avg_value": "lower_is_worse"}


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def r6(c: str | Column, name: str | None = None) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.round(c, 6).alias(name) if name else F.round(c, 6)


def rounded(df: DataFrame) -> DataFrame:
    return df.select(*[r6(f.name, f.name) if f.dataType.simpleString() == "double" else f.name for f in df.schema.fields])


def _events_windows(spark, sf_dir, entity, size, stride, how):
    ev = events(spark, sf_dir).select(entity, "ts", "event_id", "value")
    return rounded(sliding(ev, ["value"], size, stride, how, [entity], ["ts", "event_id"]))


@query
def win_mean_by_user(spark, sf_dir):
    return _events_windows(spark, sf_dir, "user_id", 5, 1, "mean")


@query
def win_max_stride2(spark, sf_dir):
    return _events_windows(spark, sf_dir, "user_id", 5, 2, "max")


@query
def win_p95_event_type(spark, sf_dir):
    """Few entities, each of many rows: windows over ranges of time."""
    ev = events(spark, sf_dir).select("event_type", "ts", "event_id", "value")
    return rounded(ranges.sliding(ev, ["value"], 5, 1, "p95", ["event_type"], ["ts", "event_id"]))


@query
def win_gap_stride_gt_size(spark, sf_dir):
    return _events_windows(spark, sf_dir, "user_id", 3, 7, "mean")


@query
def rolling_zscore_60(spark, sf_dir):
    ev = events(spark, sf_dir).select("event_type", "ts", "event_id", "value")
    return ranges.rolling_zscore(ev, "value", 60, ["event_type"], ["ts", "event_id"]).select("event_type", "event_id", r6("z", "z"))


@query
def ewma_by_event_type(spark, sf_dir):
    """A slow average of few entities of many rows."""
    ev = events(spark, sf_dir).select("event_type", "ts", "event_id", "value")
    return rounded(ranges.smoothed_ranges(ev, ["value"], 0.01, ["event_type"], ["ts", "event_id"]).select("event_type", "event_id", "smooth_value"))


@query
def kpi_frame(spark, sf_dir):
    return rounded(kpi_hourly(spark, sf_dir))


@query
def kpi_windows(spark, sf_dir):
    return rounded(windowed(spark, sf_dir))


@query
def bucket_keys(spark, sf_dir):
    b = bucket_key(F.col("ts"), 30).alias("bucket")
    return events(spark, sf_dir).groupBy(b).agg(F.count("*").alias("n"))


@query
def baseline_bucket_stats(spark, sf_dir):
    return rounded(D.bucket_stats(parts(spark, sf_dir)[0], KPIS, SETTINGS.bucket_minutes, ENTITY))


@query
def baseline_global_stats(spark, sf_dir):
    return rounded(D.global_stats(parts(spark, sf_dir)[0], KPIS, ENTITY))


@query
def zscore_with_fallback(spark, sf_dir):
    return rounded(scores(spark, sf_dir).select("cell", "rn", "bucket", *[f"raw_{k}" for k in KPIS]))


@query
def ewma_z(spark, sf_dir):
    return rounded(detected(spark, sf_dir).select("cell", "rn", *[f"z_{k}" for k in KPIS]))


@query
def persistence_runs(spark, sf_dir):
    held = islands.persisted(over(F.round("raw_load", 9), 1.0), 3, Window.partitionBy("cell").orderBy("rn"))
    return scores(spark, sf_dir).select("cell", "rn", held.cast("int").alias("held"))


@query
def detect_alerts(spark, sf_dir):
    return detected(spark, sf_dir).select("cell", "rn", "ts", "alert", "trigger")


@query
def detect_naive_alerts(spark, sf_dir):
    return naive(spark, sf_dir).select("cell", "rn", "alert")


@query
def alert_runs(spark, sf_dir):
    return islands.runs(detected(spark, sf_dir), "alert", ENTITY)


@query
def scenario_events(spark, sf_dir):
    return islands.events(kpi_hourly(spark, sf_dir), ENTITY)


@query
def event_hits_delay(spark, sf_dir):
    return rounded(islands.event_hits(detected(spark, sf_dir), ENTITY, minutes=60.0))


@query
def evaluate_metrics(spark, sf_dir):
    return rounded(V.evaluate(detected(spark, sf_dir), ENTITY, minutes=60.0))


@query
def evaluate_mixed_events(spark, sf_dir):
    """Events in which every third row alone has a label count as anomalies as a whole."""
    det = detected(spark, sf_dir).withColumn("label", ((F.col("scenario") != "") & (F.col("rn") % 3 == 0)).cast("int"))
    return rounded(V.evaluate(det, ENTITY, minutes=60.0))


@query
def delays_by_scenario(spark, sf_dir):
    """The minutes to detection of every event with a hit, in order of size."""
    lists = V.per_scenario(detected(spark, sf_dir), ENTITY, minutes=60.0)
    return lists.select("cell", "scenario", F.posexplode("delays_min").alias("place", "delay_min"))


@query
def evaluate_per_scenario(spark, sf_dir):
    return rounded(V.per_scenario(detected(spark, sf_dir), ENTITY, minutes=60.0).drop("delays_min"))


@query
def metrics_across_cells(spark, sf_dir):
    """Spread of the metrics over the entities of each half, as over seeds."""
    return rounded(V.across(V.evaluate(detected(spark, sf_dir), ENTITY, minutes=60.0).withColumn("half", F.col("cell") % 2), ["precision", "recall", "mttd_min"], ["half"]))


@query
def fp_by_location(spark, sf_dir):
    return V.false_by_location(detected(spark, sf_dir), ENTITY)


@query
def fp_reduction(spark, sf_dir):
    both = V.both_detectors(compared(spark, sf_dir), {"proposed": "alert", "naive": "naive_alert"})
    fp = V.evaluate(both, ["cell", "detector"]).groupBy("cell").agg(*[F.max(F.when(F.col("detector") == d, F.col("fp"))).alias(f"fp_{d}") for d in ("proposed", "naive")])
    return rounded(fp.withColumn("reduction_pct", V.reduction(F.col("fp_proposed"), F.col("fp_naive"))))


@query
def point_confusion(spark, sf_dir):
    return rounded(V.pointwise(naive(spark, sf_dir), "alert", ENTITY))


@query
def scenario_alert_summary(spark, sf_dir):
    return detected(spark, sf_dir).groupBy("cell", "scenario").agg(F.count("*").alias("n_rows"), F.sum("alert").cast("long").alias("n_alerts"))


def _segment(spark, sf_dir):
    """Rows of each cell's best segment, its last row among them."""
    return report.in_best_segment(detected(spark, sf_dir), ENTITY, last=True).where("inside")


@query
def best_segment(spark, sf_dir):
    return islands.best_segment(detected(spark, sf_dir), ENTITY)


@query
def segment_summary(spark, sf_dir):
    return rounded(report.segment_stats(_segment(spark, sf_dir), KPIS, ENTITY))


@query
def normal_reference_stats(spark, sf_dir):
    return rounded(report.normal_stats(detected(spark, sf_dir), KPIS, ENTITY))


@query
def segment_alerts(spark, sf_dir):
    return report.alert_stats(_segment(spark, sf_dir), ENTITY)


@query
def top_triggers(spark, sf_dir):
    return report.top_triggers(detected(spark, sf_dir), ENTITY, 3)


@query
def kpi_deviation_rank(spark, sf_dir):
    stats = report.segment_and_normal(report.in_best_segment(detected(spark, sf_dir), ENTITY, last=True), KPIS, ENTITY)
    return rounded(report.deviations(stats, KPIS, ENTITY))


@query
def incident_summary(spark, sf_dir):
    """The fields of every cell's document, a row for each KPI."""
    return report.fields(report.summary(detected(spark, sf_dir), KPIS, ENTITY, SETTINGS.z_threshold), ENTITY)


@query
def naive_only_fp_longest(spark, sf_dir):
    both = compared(spark, sf_dir).withColumn("false_naive", (F.col("naive_alert") == 1) & (F.col("label") == 0))
    return islands.longest_run_without(both, "false_naive", "alert", ENTITY)


@query
def best_segment_of_scenario(spark, sf_dir):
    return islands.best_segment(detected(spark, sf_dir), ENTITY, scenario="view_surge")


@query
def rows_around_bursts(spark, sf_dir):
    """Every row with each burst of its cell that it lies in, or within two rows of."""
    det = detected(spark, sf_dir)
    near = intervals.around(det.select("cell", "rn", "alert"), islands.segments(det, ENTITY, "error_burst"), ENTITY, margin=2)
    return near.select("cell", "segment", "rn", (F.col("rn") - F.col("start_rn")).alias("place"), "alert")


@query
def naive_only_fp_slice(spark, sf_dir):
    """Both detectors on the rows of naive_only_fp_longest and three rows on either side, to plot."""
    both = compared(spark, sf_dir).withColumn("false_naive", (F.col("naive_alert") == 1) & (F.col("label") == 0))
    run = islands.longest_run_without(both, "false_naive", "alert", ENTITY).select("cell", (F.col("start_rn") + 1).alias("start_rn"), (F.col("end_rn") + 1).alias("end_rn"))
    return rounded(intervals.around(both, run, ENTITY, margin=3).select("cell", "rn", "ts", "load", "label", "alert", "naive_alert"))


@query
def plot_series(spark, sf_dir):
    return rounded(plots.thinned(compared(spark, sf_dir), ["load", "avg_value"], ENTITY, 40, flags=["alert", "naive_alert"]))


@query
def plot_shading(spark, sf_dir):
    det = detected(spark, sf_dir).withColumn("anomaly", F.col("label") == 1).withColumn("trap", validate.trap())
    return plots.shaded(det, ENTITY, {"alert": "alert", "anomaly": "anomaly", "trap": "trap"})


@query
def skeleton_confusion(spark, sf_dir):
    """A rolling z-score of the load over a day, and its alerts against the labels row by row."""
    z = rolling_zscore(kpi_hourly(spark, sf_dir), "load", 24, ENTITY, ["rn"])
    return rounded(V.pointwise(z.withColumn("alert", over(F.round("z", 9), 1.5).cast("int")), "alert", ENTITY))


@query
def latency_produced_to_ingested(spark, sf_dir):
    """Events are ingested when their hour is over."""
    ev = events(spark, sf_dir).select((F.col("user_id") % 4).alias("part"), "ts", (F.date_trunc("hour", "ts") + F.expr("interval 1 hour")).alias("ingested_at"))
    return rounded(latency(ev, elapsed_ms(F.col("ingested_at"), F.col("ts")), ["part"]))


@query
def next_offset_by_partition(spark, sf_dir):
    """The offset from which each partition is read next."""
    return _log(spark, sf_dir).groupBy("partition").agg((F.max("offset") + 1).alias("next_offset"))


@query
def frame_diff_by_digest(spark, sf_dir):
    ev, got = _two_frames(spark, sf_dir)
    return rounded(reconcile.differing(ev, got, ["user_id", "event_id"], ["value"]))


@query
def latency_percentiles(spark, sf_dir):
    ev = events(spark, sf_dir).select((F.col("user_id") % 4).alias("part"), "event_id", "ts")
    gaps = ranges.before(ev, ["ts"], ["part"], ["event_id"])
    lag = gaps.select("part", elapsed_ms(F.col("ts"), F.col("before_ts")).alias("ms")).where("ms is not null")
    return rounded(lag.groupBy("part").agg(F.count("*").alias("n"), F.percentile("ms", F.lit(0.5)).alias("p50"), F.percentile("ms", F.lit(0.95)).alias("p95"), F.max("ms").alias("max_ms")))


@query
def count_by_key(spark, sf_dir):
    return events(spark, sf_dir).groupBy("user_id").agg(F.count("*").alias("n"))


@query
def expected_windows_by_key(spark, sf_dir):
    n = events(spark, sf_dir).groupBy("user_id").agg(F.count("*").alias("n"))
    return n.select("user_id", "n", expected_windows(F.col("n"), 5, 2).alias("n_windows"))


@query
def windows_count_check(spark, sf_dir):
    ev = events(spark, sf_dir).select("user_id", "ts", "event_id", "value")
    return reconcile.count_check(ev, sliding(ev, ["value"], 5, 2, "mean", ["user_id"], ["ts", "event_id"]), "user_id", 5, 2)


@query
def key_partition_audit(spark, sf_dir):
    ev = events(spark, sf_dir).select("event_type", (F.col("user_id") % 7 % 4).cast("int").alias("part"))
    return reconcile.placement(ev, "event_type", "part")


@query
def partition_skew(spark, sf_dir):
    ev = events(spark, sf_dir).select("user_id", (F.col("user_id") % 7 % 4).cast("int").alias("part"))
    return rounded(reconcile.skew(ev, "user_id", "part", 5))


@query
def broker_partition_skew(spark, sf_dir):
    """Placement of users by the broker's own key hash, which SQL does not have."""
    ev = events(spark, sf_dir).select("user_id", broker_partition(F.col("user_id"), 4).alias("part"))
    return reconcile.skew(ev, "user_id", "part", 4)


def _two_frames(spark, sf_dir):
    """Events, and events with some missing, some changed and some added."""
    ev = events(spark, sf_dir).select("user_id", "event_id", "value")
    got = ev.where("event_id % 97 <> 0").withColumn("value", F.when(F.col("event_id") % 101 == 0, F.col("value") + 0.5).otherwise(F.col("value")))
    got = got.union(ev.where("event_id % 211 = 0").select("user_id", (-F.col("event_id") - 1).alias("event_id"), "value"))
    return ev, got


@query
def outer_diff_by_key(spark, sf_dir):
    ev, got = _two_frames(spark, sf_dir)
    return reconcile.compare(ev, got, ["user_id", "event_id"], ["value"], ["user_id"])


@query
def idempotent_upsert(spark, sf_dir):
    """Two overlapping batches: what the first has stays, whatever the second says."""
    ev = events(spark, sf_dir).select("user_id", "ts", "event_id", F.round(F.col("value") * 100).cast("long").alias("cents"))
    one = ev.where("event_id % 10 < 6")
    two = ev.where("event_id % 10 >= 4").withColumn("cents", F.col("cents") + 1000)
    stored = first_wins(None, one, ["user_id", "ts"], ["event_id"])
    new = first_wins(stored, two, ["user_id", "ts"], ["event_id"])
    rows = stored.withColumn("batch", F.lit(1)).unionByName(new.withColumn("batch", F.lit(2)))
    return rows.groupBy("user_id", "batch").agg(F.count("*").alias("n"), F.sum("cents").alias("cents"))


def _log(spark, sf_dir):
    """Events as the log of four partitions; offsets are places, counted over ranges of the table."""
    ev = events(spark, sf_dir).select((F.col("user_id") % 4).cast("int").alias("partition"), F.col("user_id").alias("key"), "event_id")
    return ranges.placed(ev, ["partition"], ["event_id"]).select("partition", "key", (F.col("rn") - 1).alias("offset"))


@query
def resume_positions(spark, sf_dir):
    return replay.resume_positions(_log(spark, sf_dir), 5, 2)


@query
def partition_resume(spark, sf_dir):
    return replay.resume_positions(_log(spark, sf_dir), 5, 1).groupBy("partition").agg(F.min("resume").alias("resume"))


@query
def crash_loss_matrix(spark, sf_dir):
    return replay.crash_cost(_log(spark, sf_dir), 5, 100, 30)


@query
def commit_regressions(spark, sf_dir):
    ev = events(spark, sf_dir).select((F.col("user_id") % 4).cast("int").alias("part"), "event_id", (F.col("event_id") - F.col("event_id") % 7 * 3).alias("position"))
    return islands.regressions(ev, "part", "event_id", "position")


@query
def param_sweep_eval(spark, sf_dir):
    return rounded(experiments.threshold_sweep(scores(spark, sf_dir), KPIS, SETTINGS, THRESHOLDS, PERSISTENCES, ENTITY, 60.0))


@query
def sweep_one_at_a_time(spark, sf_dir):
    settings = experiments.variants(SETTINGS, alpha=ALPHAS, z_threshold=THRESHOLDS, persistence=PERSISTENCES)
    return rounded(experiments.settings_sweep(scores(spark, sf_dir), KPIS, settings, ENTITY, 60.0))


@query
def label_totals(spark, sf_dir):
    return rounded(validate.label_totals(kpi_hourly(spark, sf_dir), ENTITY))


@query
def clip_saturation(spark, sf_dir):
    return validate.saturation(kpi_hourly(spark, sf_dir), {"load": (0.0, 5.0), "errors": (0.0, 2.0), "avg_value": (0.0, 100.0)}, ENTITY)


@query
def bad_direction_deviation(spark, sf_dir):
    return rounded(validate.bad_deviation(kpi_hourly(spark, sf_dir), DIRECTIONS, ENTITY))


@query
def load_quality_split(spark, sf_dir):
    dev = validate.bad_deviation(kpi_hourly(spark, sf_dir), DIRECTIONS, ENTITY).where("scenario = 'view_surge'")
    return rounded(validate.separation(dev, ["load"], ENTITY))


@query
def warmup_purity(spark, sf_dir):
    return rounded(validate.warmup_purity(kpi_hourly(spark, sf_dir), WARMUP, ENTITY))


@query
def stream_windows_by_user(spark, sf_dir):
    """The keyed windows as a stream over the table's file; equal to win_mean_by_user."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events*.parquet").parquet(sf_dir)
    out = keyed_windows(stream.select("user_id", "ts", "event_id", "value"), "user_id", ["ts", "event_id"], ["value"], 5)
    base = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if base is None:
        import tempfile

        base = tempfile.mkdtemp(prefix="spark-")
    folder = f"{base}/stream-{uuid.uuid4().hex}"
    with state_store(spark):
        run = out.writeStream.format("parquet").option("checkpointLocation", f"{folder}/state").option("path", f"{folder}/rows").trigger(availableNow=True).start()
    run.awaitTermination()
    return rounded(spark.read.schema(out.schema).parquet(f"{folder}/rows"))


__all__ = ["NAIVE_Z", "QUERIES", "SIZE"]
