"""Hand-computed goldens and plain-Python models."""

import json
import math
import random
import statistics
from datetime import datetime, timedelta

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.config import DetectorSettings, WindowSettings
from tidemark.functions import scalars
from tidemark.operators import detect, evaluate, islands, ranges, report
from tidemark.operators.windows import expected_windows, sliding
from tidemark.sources import files, store
from tidemark.streaming.sink import KeyedSink
from tidemark.streaming.windows import keyed_windows, state_store

V = [3, 1, 4, 1, 5, 9, 2, 6]
T0 = datetime(2024, 1, 1)


def series(spark, values, **extra):
    rows = [(1, i + 1, T0 + timedelta(hours=i), float(v) if v is not None else None, *(x[i] for x in extra.values())) for i, v in enumerate(values)]
    kinds = {int: "int", str: "string", bool: "boolean"}
    fields = "".join(f", {k} {kinds[type(x[0])]}" for k, x in extra.items())
    return spark.createDataFrame(rows, "cell int, rn int, ts timestamp_ntz, v double" + fields)


@pytest.mark.parametrize(("how", "want"), [("mean", [2.8, 4.0, 4.2, 4.6]), ("p95", [4.8, 8.2, 8.2, 8.4]), ("max", [5.0, 9.0, 9.0, 9.0])])
def test_window_goldens(spark, how, want):
    got = [r.v for r in sliding(series(spark, V), ["v"], 5, 1, how, ["cell"], ["rn"]).orderBy("rn").collect()]
    assert got == pytest.approx(want)


@pytest.mark.parametrize(("size", "stride"), [(5, 1), (5, 2), (5, 5), (3, 7), (1, 4), (9, 1)])
def test_emission_grid(spark, size, stride):
    rng = random.Random(size * 10 + stride)
    v = [rng.random() for _ in range(23)]
    held, since, want = [], 0, []
    for i, x in enumerate(v):
        held, since = (held + [x])[-size:], since + 1
        if len(held) == size and since >= stride:
            want.append((i + 1, sum(held) / size))
            since = 0
    got = [(r.rn, r.v) for r in sliding(series(spark, v), ["v"], size, stride, "mean", ["cell"], ["rn"]).orderBy("rn").collect()]
    assert [g[0] for g in got] == [w[0] for w in want]
    assert [g[1] for g in got] == pytest.approx([w[1] for w in want])


def test_unknown_aggregate_and_settings():
    with pytest.raises(ValueError):
        scalars.aggregate("median")
    with pytest.raises(ValueError):
        DetectorSettings(bucket_minutes=50)
    with pytest.raises(ValueError):
        WindowSettings(size=0)


def test_expected_windows(spark):
    got = spark.createDataFrame([(n,) for n in (0, 4, 5, 30240)], "n long").select(expected_windows(F.col("n"), 5, 1).alias("w")).collect()
    assert [r.w for r in got] == [0, 0, 1, 30236]


def smooth(df, alpha):
    return [r.z for r in ranges.smoothed(df, {"z": F.col("v")}, alpha, ["cell"], ["rn"]).orderBy("rn").collect()]


def test_ewma_golden_nan_and_null(spark):
    want = [3.0, 2.6, 2.88, 2.504, 3.0032, 4.20256, 3.762048, 4.2096384]
    df = series(spark, V)
    assert smooth(df, 0.2) == pytest.approx(want)
    assert [r.smooth_v for r in ranges.smoothed_ranges(df, ["v"], 0.2, ["cell"], ["rn"], 3).orderBy("rn").collect()] == pytest.approx(want)
    assert smooth(df, 1.0) == [float(v) for v in V]
    for odd in (float("nan"), None):
        spoiled = smooth(series(spark, [1, odd, 2]), 0.2)
        assert spoiled[0] == 1.0 and math.isnan(spoiled[1]) and math.isnan(spoiled[2])


@pytest.mark.parametrize(("alpha", "n"), [(0.001, 100_000), (0.4, 3000), (0.9, 700)])
def test_ewma_of_many_rows_is_the_recurrence(spark, alpha, n):
    """Also over many chunks, with a value that is not a number in the middle of one."""
    df = spark.range(n).select(F.lit(1).alias("cell"), (F.col("id") + 1).alias("rn"), (F.sin(F.col("id") * 0.7) * 50 + F.col("id") % 13).alias("v"))
    want, acc = [], None
    for v in [r.v for r in df.orderBy("rn").collect()]:
        acc = v if acc is None else alpha * v + (1 - alpha) * acc
        want.append(acc)
    spread = ranges.smoothed_ranges(df, ["v"], alpha, ["cell"], ["rn"], 7)
    assert [r.smooth_v for r in spread.orderBy("rn").collect()] == pytest.approx(want, rel=1e-12, abs=1e-12)
    assert smooth(df, alpha) == pytest.approx(want, rel=1e-12, abs=1e-12)
    if n == 700:
        spoiled = df.withColumn("v", F.when(F.col("rn") == 200, F.lit(float("nan"))).otherwise(F.col("v")))
        for got in (smooth(spoiled, alpha), [r.smooth_v for r in ranges.smoothed_ranges(spoiled, ["v"], alpha, ["cell"], ["rn"], 7).orderBy("rn").collect()]):
            assert got[:199] == pytest.approx(want[:199]) and all(math.isnan(x) for x in got[199:])


def rows_of(df, digits=9):
    return sorted((tuple(round(x, digits) if isinstance(x, float) else x for x in r) for r in df.collect()), key=str)


@pytest.mark.parametrize(("size", "stride", "how"), [(5, 1, "mean"), (3, 7, "max"), (60, 1, "p95"), (1, 1, "mean"), (7, 2, "mean")])
def test_windows_over_ranges_equal_those_over_entities(spark, size, stride, how):
    """One entity has most rows, others have a few in ranges far apart; times repeat."""
    rng = random.Random(size)
    rows = [("hot" if rng.random() < 0.8 else rng.choice("abcdef"), T0 + timedelta(minutes=rng.randrange(400)), i, rng.random()) for i in range(600)] + [(None, T0, 601, 1.0), ("late", None, 602, 2.0), ("late", T0, 603, 3.0)]
    df = spark.createDataFrame(rows, "k string, ts timestamp_ntz, i int, v double")
    for parts in (1, 9, 200):
        got = ranges.sliding(df, ["v"], size, stride, how, ["k"], ["ts", "i"], parts=parts)
        assert rows_of(got) == rows_of(sliding(df, ["v"], size, stride, how, ["k"], ["ts", "i"]))


def test_hot_entity_is_spread(spark):
    df = spark.range(20_000).select(F.lit("one").alias("k"), F.col("id"), (F.col("id") % 7).cast("double").alias("v"))
    rows, _ = ranges.with_halo(df, ["k"], ["id"], 59, 10)
    n = {r["_to"]: (r.n, r.own) for r in rows.groupBy("_to").agg(F.count("*").alias("n"), F.count_if("_own").alias("own")).collect()}
    assert len(n) == 10 and max(x for x, _ in n.values()) < 2400 and sum(x for x, _ in n.values()) == 20_000 + 9 * 59 and sum(x for _, x in n.values()) == 20_000
    assert [r.rn for r in ranges.placed(df, ["k"], ["id"], 0, 10).orderBy("id").limit(5).collect()] == [1, 2, 3, 4, 5]


def test_ranges_of_odd_tables(spark):
    empty = spark.createDataFrame([], "k string, i long, v double")
    assert ranges.sliding(empty, ["v"], 3, 1, "mean", ["k"], ["i"]).count() == 0
    assert ranges.smoothed_ranges(empty, ["v"], 0.5, ["k"], ["i"]).count() == 0
    one = spark.createDataFrame([("a", 1, 2.0)], "k string, i long, v double")
    assert [r.before_v for r in ranges.before(one, ["v"], ["k"], ["i"]).collect()] == [None]
    with pytest.raises(ValueError):
        ranges.sliding(one, ["v"], 3, 1, "mean", ["k"], ["k"])


def test_an_event_is_an_anomaly_as_a_whole(spark):
    """The alert on a row without label of an event with one is no false alert."""
    df = series(spark, [0] * 5, scenario=["", "a", "a", "a", ""], label=[0, 1, 0, 0, 0], alert=[0, 0, 0, 1, 0])
    r = evaluate.evaluate(df, ["cell"]).first()
    assert (r.tp, r.fn, r.fp, r.mttd_min) == (1, 0, 0, 2.0)
    assert evaluate.false_by_location(df, ["cell"]).count() == 0
    longer = series(spark, [0] * 7, scenario=["", "a", "a", "b", "b", "", ""], label=[0, 0, 1, 0, 0, 0, 0], alert=[0, 1, 0, 1, 1, 1, 0])
    got = {x.location: x.n_false for x in evaluate.false_by_location(longer, ["cell"]).collect()}
    assert got == {"b": 1} and evaluate.evaluate(longer, ["cell"]).first().fp == 1


def test_baseline_within_one_frame_equals_that_of_two(spark):
    rng = random.Random(9)
    v = [rng.choice([1.0, 2.0, rng.random()]) for _ in range(120)]
    df = series(spark, v)
    settings = DetectorSettings(bucket_minutes=60, min_samples=3, warmup_rows=80)
    train, test = detect.split(df, 80)
    assert rows_of(detect.scored_after(df, ["v"], settings, ["cell"])) == rows_of(detect.scored(test, train, ["v"], settings, ["cell"]))
    both = detect.detect_after(df, ["v"], settings, ["cell"], naive_z=1.0)
    assert rows_of(both.select("rn", F.col("naive_alert").alias("alert"))) == rows_of(detect.detect_naive(test, train, ["v"], 1.0, ["cell"]).select("rn", "alert"))
    assert rows_of(both.select("rn", "z_v", "alert", "trigger")) == rows_of(detect.detect(test, train, ["v"], settings, ["cell"]).select("rn", "z_v", "alert", "trigger"))


def test_summary_of_a_segment(spark):
    """Half-open segment, the scenario asked for, ties of triggers, and entities without a segment."""
    v = [1, 2, 3, 10, 20, 30, 1, 2, 9, 9]
    df = series(spark, v, scenario=["", "", "", "x", "x", "x", "", "", "y", "y"], label=[0] * 10, alert=[0, 1, 0, 1, 1, 0, 0, 0, 0, 0], trigger=["", "v", "", "v", "v,w", "", "", "", "", ""]).withColumn("w", F.col("v") * 2)
    doc = json.loads(report.summary(df, ["v", "w"], ["cell"], 3.0).first().summary)
    assert (doc["n_rows"], doc["n_alerts"], doc["first_alert"][:16], doc["z_threshold"]) == (2, 2, "2024-01-01T03:00", 3.0)
    assert doc["triggers"] == [{"trigger": "v", "n": 1}, {"trigger": "v,w", "n": 1}] and doc["fired"] == ["v", "w"] and doc["not_fired"] == []
    assert [d["kpi"] for d in doc["deviations"]] == ["v", "w"] and doc["deviations"][0]["segment_mean"] == 15.0 and doc["deviations"][0]["normal_mean"] == 1.8 and doc["deviations"][0]["fired"]
    other = json.loads(report.summary(df, ["v", "w"], ["cell"], 3.0, scenario="y").first().summary)
    assert (other["n_rows"], other["n_alerts"], other["triggers"], other["not_fired"]) == (1, 0, [], ["v", "w"]) and "first_alert" not in other
    assert report.summary(df, ["v", "w"], ["cell"], 3.0, scenario="z").count() == 0


@pytest.fixture
def whole_segment(spark, monkeypatch):
    """A registered query on two cells, whose best segments have rows 3 to 5 and row 4; the last row of each is its furthest and has an alert."""
    from tidemark.plans import queries

    a = series(spark, [1.0, 2.0, 3.0, 4.0, 50.0, 2.0], scenario=["", "", "x", "x", "x", ""], label=[0] * 6, alert=[0, 0, 0, 1, 1, 0])
    b = series(spark, [1.0, 2.0, 3.0, 70.0, 3.0, 2.0], scenario=["", "", "", "y", "", ""], label=[0] * 6, alert=[0, 0, 0, 1, 0, 0]).withColumn("cell", F.lit(2))
    rows = a.unionByName(b).withColumns({"load": F.col("v"), "errors": F.col("v") * 2, "avg_value": -F.col("v")}).drop("v")
    monkeypatch.setattr(queries, "detected", lambda spark, sf_dir: rows)
    return lambda name: queries.QUERIES[name](spark, "").collect()


def test_segment_summary_takes_every_row_of_the_segment(whole_segment):
    got = {r.cell: (r.n_rows, r.avg_load, r.max_load, r.min_load) for r in whole_segment("segment_summary")}
    assert got == {1: (3, 19.0, 50.0, 3.0), 2: (1, 70.0, 70.0, 70.0)}


def test_segment_alerts_counts_every_row_of_the_segment(whole_segment):
    got = {r.cell: (r.n_alerts, r.first_alert) for r in whole_segment("segment_alerts")}
    assert got == {1: (2, T0 + timedelta(hours=3)), 2: (1, T0 + timedelta(hours=3))}


def test_kpi_deviation_rank_takes_every_row_of_the_segment(whole_segment):
    got = {(r.cell, r.kpi): (r.avg_dev, r.max_dev) for r in whole_segment("kpi_deviation_rank")}
    normal = {1: [1.0, 2.0, 2.0], 2: [1.0, 2.0, 3.0, 3.0, 2.0]}
    sd, mean = {c: statistics.stdev(v) for c, v in normal.items()}, {c: statistics.mean(v) for c, v in normal.items()}
    assert {k for _, k in got} == {"load", "errors", "avg_value"} and len(got) == 6
    assert got[1, "load"] == pytest.approx(((19.0 - mean[1]) / sd[1], (50.0 - mean[1]) / sd[1]), abs=1e-5)
    assert got[2, "load"] == pytest.approx(((70.0 - mean[2]) / sd[2],) * 2, abs=1e-5)


@pytest.mark.parametrize(("name", "scans"), [("evaluate_metrics", 4), ("fp_by_location", 4), ("param_sweep_eval", 4), ("fp_reduction", 4), ("kpi_deviation_rank", 4), ("incident_summary", 8)])
def test_evaluation_reads_events_few_times(spark, name, scans):
    from tidemark.plans.queries import QUERIES

    plan = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().sparkPlan().toString()
    assert 0 < plan.count("FileScan") <= scans


def test_persistence_golden(spark):
    by = Window.partitionBy("cell").orderBy("rn")
    df = series(spark, [1, 1, 0, 1, 1, 1, 1, 0])
    got = lambda n: [int(r.p) for r in df.select("rn", islands.persisted(F.col("v") == 1, n, by).alias("p")).orderBy("rn").collect()]
    assert got(3) == [0, 0, 0, 0, 0, 1, 1, 0]
    assert got(1) == [1, 1, 0, 1, 1, 1, 1, 0]


def test_threshold_ignores_nan_and_null(spark):
    df = series(spark, [5, float("nan"), None, -5, 3])
    assert [r.f for r in df.select("rn", scalars.over(F.col("v"), 3.0).alias("f")).orderBy("rn").collect()] == [True, False, False, True, False]


@pytest.mark.parametrize("flags", [[0, 0, 0], [1, 1, 1], [1, 0, 1], [0, 1, 1, 0, 1]])
def test_runs(spark, flags):
    want, start = [], None
    for i, f in enumerate([*flags, 0]):
        if f and start is None:
            start = i
        if not f and start is not None:
            want.append((start, i))
            start = None
    df = series(spark, flags).withColumn("flag", F.col("v") == 1)
    assert [(r.start_rn, r.end_rn) for r in islands.runs(df, "flag", ["cell"]).orderBy("start_rn").collect()] == want


def test_evaluation_by_event(spark):
    df = series(spark, [0] * 10, scenario=["", "a", "a", "b", "b", "", "", "c", "", ""], label=[0, 1, 1, 0, 0, 0, 0, 1, 0, 0], alert=[0, 0, 1, 1, 0, 1, 0, 0, 0, 1])
    r = evaluate.evaluate(df, ["cell"], minutes=5.0).first()
    assert (r.tp, r.fn, r.fp, r.mttd_min) == (1, 1, 2, 5.0)
    assert r.precision == pytest.approx(1 / 3) and r.recall == 0.5
    places = {x.location: x.n_false for x in evaluate.false_by_location(df, ["cell"]).collect()}
    assert places == {evaluate.NORMAL: 2}
    quiet = evaluate.evaluate(series(spark, [0], scenario=[""], label=[0], alert=[0]), ["cell"]).first()
    assert (quiet.tp, quiet.fp, quiet.recall) == (0, 0, 0.0) and math.isnan(quiet.mttd_min)


def test_constant_buckets_fall_back(spark):
    train = series(spark, [1, 1, 1, 5])
    out = detect.scored(series(spark, [2]), train, ["v"], DetectorSettings(bucket_minutes=1440, min_samples=5), ["cell"]).first()
    assert out.raw_v == pytest.approx(0.0)  # global mean 2
    flat = detect.scored(series(spark, [3]), series(spark, [1, 1]), ["v"], DetectorSettings(bucket_minutes=1440), ["cell"]).first()
    assert flat.raw_v == 2.0  # no spread: deviation 1


def test_murmur2_reproduces_published_placement(spark):
    counts = lambda n: [sum(1 for i in range(n) if (scalars.murmur2(f"cell-{i:03d}".encode()) & 0x7FFFFFFF) % 4 == p) for p in range(4)]
    assert counts(8) == [0, 3, 4, 1]
    assert counts(1000) == [246, 263, 258, 233]
    df = spark.range(8).select(scalars.entity_name("cell-", F.col("id")).alias("k")).select(scalars.broker_partition(F.col("k"), 4).alias("p"))
    assert sorted(r.p for r in df.collect()) == [1, 1, 1, 2, 2, 2, 2, 3]


def test_sink_is_idempotent(spark, tmp_path):
    sink = KeyedSink(spark, str(tmp_path / "sink"), ["k", "i"], ["v"])
    rows = lambda ids, v: spark.createDataFrame([("e", i, float(v)) for i in ids], "k string, i int, v double")
    assert sink.write(rows([], 0), 0) == (0, 0)
    assert sink.write(rows([0, 1, 2], 1), 1) == (3, 0)
    assert sink.write(rows([0, 1, 2], 2), 2) == (0, 3)
    assert sink.write(rows([2, 3, 4], 3), 3) == (2, 1)
    assert sink.write(rows([2, 3, 4], 3), 3) == (2, 1)  # the same batch again
    assert sorted((r.i, r.v) for r in sink.rows().collect()) == [(0, 1.0), (1, 1.0), (2, 1.0), (3, 3.0), (4, 3.0)]


def test_stream_equals_batch_over_many_batches(spark, tmp_path):
    rng = random.Random(3)
    rows = [(f"c{i % 3}", i, rng.random()) for i in range(120)]
    fields = "k string, i int, v double"
    for n in range(4):
        spark.createDataFrame(rows[n * 30 : n * 30 + 30], fields).coalesce(1).write.parquet(str(tmp_path / "in" / f"part={n}"))
    batch = spark.createDataFrame(rows, fields)
    want = {(r.k, r.i): r.v for r in sliding(batch, ["v"], 5, 2, "mean", ["k"], ["i"]).collect()}
    stream = spark.readStream.schema(batch.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
    with state_store(spark):
        q = keyed_windows(stream, "k", ["i"], ["v"], 5, 2).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    q.awaitTermination()
    got = {(r.k, r.i): r.v for r in spark.read.schema(batch.schema).parquet(str(tmp_path / "out")).collect()}
    assert got.keys() == want.keys()
    assert all(got[k] == pytest.approx(want[k]) for k in want)
    with state_store(spark):
        wide = keyed_windows(stream, "k", ["i"], ["v"], 3, 7, "p95").writeStream.format("parquet").option("path", str(tmp_path / "wide")).option("checkpointLocation", str(tmp_path / "wide_state")).trigger(availableNow=True).start()
    wide.awaitTermination()
    rows = lambda df: sorted((r.k, r.i, round(r.v, 6)) for r in df.collect())
    assert rows(spark.read.parquet(str(tmp_path / "wide"))) == rows(sliding(batch, ["v"], 3, 7, "p95", ["k"], ["i"]))


def test_store_and_files(spark, tmp_path):
    s = store.Store(spark)
    assert s.write("t_metrics", spark.range(3).withColumnRenamed("id", "x")) == 3
    assert s.write("t_metrics", spark.range(2).withColumnRenamed("id", "x")) == 2
    assert "t_metrics" in s.tables() and s.query("select count(*) n from t_metrics where x >= ?", [1]).first().n == 1
    s.truncate("t_metrics")
    assert s.query("select * from t_metrics").count() == 0
    s.drop("t_metrics")
    schema = files.kpi_schema(["a"], "cell")
    df = spark.createDataFrame([(T0, "c", 1.5, 0, ""), (T0, "c", 2.5, 1, "x")], schema)
    df.write.option("header", True).csv(str(tmp_path / "csv"))
    back = files.open_source(spark, "batch", schema, path=str(tmp_path / "csv"))
    assert sorted(r.scenario for r in back.collect()) == ["", "x"]
    one = df.select(files.encode(df).alias("j")).select(files.decode(F.col("j"), schema).alias("r")).select("r.*")
    assert sorted(one.collect()) == sorted(df.collect())


def test_entry_and_incidents(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    rows = e.queries()["incident_summary"](spark, "/root/testdata/sf0.001").collect()
    assert rows and len(rows) == 3 * len({r.cell for r in rows})


def test_settings_from_yaml(tmp_path):
    from tidemark import config

    (tmp_path / "a.yaml").write_text("kpis:\n  load: {direction: lower_is_worse, clip: [0, 5]}\n  errors: {}\nwindow: {size: 3}\ndetector: {alpha: 0.5}\n")
    got = config.load(tmp_path / "a.yaml")
    assert got.names == ["load", "errors"] and got.kpis[0].clip == (0, 5) and got.kpis[0].direction == "lower_is_worse"
    assert (got.window.size, got.window.stride, got.detector.alpha, got.detector.persistence) == (3, 1, 0.5, 5)
    (tmp_path / "b.yaml").write_text("kpis:\n  load: {direction: sideways}\n")
    with pytest.raises(ValueError):
        config.load(tmp_path / "b.yaml")


def test_clip_epoch_and_traps(spark):
    from tidemark.operators import validate

    df = spark.createDataFrame([(-1.0, 0, "", 0), (0.5, 1500, "surge", 0), (9.0, None, "burst", 1)], "v double, ms long, scenario string, label int")
    rows = df.select(scalars.clip(F.col("v"), 0, 1).alias("v"), F.unix_millis(scalars.from_epoch_ms(F.col("ms"))).alias("ms"), validate.trap().alias("trap")).collect()
    assert [tuple(r) for r in rows] == [(0.0, 0, False), (0.5, 1500, True), (1.0, None, False)]
    assert tuple(validate.label_totals(df.withColumn("e", F.lit(1)), ["e"]).first()) == (1, 3, 1, 1, pytest.approx(100 / 3))


def test_across_leaves_nan_out(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("a", float("nan")), ("b", float("nan"))], "k string, x double")
    got = {r.k: tuple(r)[1:] for r in evaluate.across(df, ["x"], ["k"]).collect()}
    assert got == {"a": (2.0, 1.0, 1.0, 3.0), "b": (None, None, None, None)}


def test_delays_of_each_scenario(spark):
    df = series(spark, [0] * 7, label=[1, 1, 0, 1, 1, 0, 1], scenario=["x", "x", "", "x", "x", "", "x"], alert=[0, 1, 0, 1, 0, 0, 0])
    r = evaluate.per_scenario(df, ["cell"], minutes=5.0).first()
    assert (r.total, r.hit, r.delays_min, r.mean_delay_min) == (3, 2, [0.0, 5.0], 2.5)


def test_broker_rows_with_and_without_key(spark, tmp_path):
    df = spark.createDataFrame([(7, None), (8, 1.5)], "id int, v double")
    assert [tuple(r) for r in files.kafka_rows(df, "id").orderBy("key").collect()] == [("7", '{"id":7,"v":null}'), ("8", '{"id":8,"v":1.5}')]
    assert files.kafka_rows(df).columns == ["value"]
    df.write.parquet(str(tmp_path / "p"))
    with pytest.raises(ValueError):
        files.kafka_sink(files.stream_parquet(spark, str(tmp_path / "p"), df.schema), "localhost:1", "t")


def test_stream_of_csv_into_the_sink(spark, tmp_path):
    """Files come one by one; keys repeat between files, and the last file has a column more in the sink."""
    schema = files.kpi_schema(["load"], "cell")
    for n in range(3):
        rows = [(T0 + timedelta(hours=h), "a", float(n), 0, None) for h in (n, n + 1)]
        files.write_csv(spark.createDataFrame(rows, schema).coalesce(1), str(tmp_path / f"in/f={n}"))
    sink = KeyedSink(spark, str(tmp_path / "sink"), ["cell", "ts"], ["load"])
    stream = files.stream_csv(spark, str(tmp_path / "in/*"), schema).withColumn("produced_at", F.current_timestamp())
    run = stream.writeStream.foreachBatch(sink.each_batch).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    run.awaitTermination()
    assert sink.rows().select("ts").distinct().count() == sink.rows().count() == 4
    assert {r.scenario for r in sink.rows().collect()} == {""}
    lag = sink.latency_ms().first()
    assert lag.n == 4 and 0 <= lag.p50 <= lag.p95 <= lag.max
    later = spark.createDataFrame([(T0 + timedelta(hours=9), "a", 1.0, "x")], "ts timestamp_ntz, cell string, load double, note string")
    assert sink.write(later, 99) == (1, 0)
    assert sorted(str(r.note) for r in sink.rows().collect()) == ["None"] * 4 + ["x"]
