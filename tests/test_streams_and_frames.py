"""The store, counters of streams, interval joins, digests of frames and frames to plot."""

import random
import time
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidemark.operators import intervals, plots, reconcile
from tidemark.streaming.counters import Counters, counted
from tidemark.streaming.sink import KeyedSink, has_bit, positions
from tidemark.streaming.windows import keyed_windows, state_store

T0 = datetime(2024, 1, 1)
FIELDS = "cell string, ts timestamp_ntz, v double"


def hours(spark, first, n, v=0.0, cells=("a", "b")):
    return spark.createDataFrame([(c, T0 + timedelta(hours=first + h), v) for h in range(n) for c in cells], FIELDS)


def test_a_batch_reads_no_more_as_the_store_grows(spark, tmp_path):
    sink = KeyedSink(spark, str(tmp_path / "s"), ["cell", "ts"], ["v"], buckets=4)
    looked = []
    for b in range(12):  # every batch has one hour of the one before
        assert sink.write(hours(spark, b * 5, 6, float(b)), b) == ((12, 0) if b == 0 else (10, 2))
        looked.append(len(sink.consulted))
    assert looked[0] == 0 and all(1 <= n <= 4 for n in looked[1:])
    assert {f.split("/")[-2] for f in sink.consulted} == {"batch_id=10"}
    assert sink.write(hours(spark, 17, 2, 99.0), 50) == (0, 4) and 1 <= len(sink.consulted) <= 4
    assert sink.write(hours(spark, 500, 2), 51) == (4, 0) and sink.consulted == []
    assert sink.write(hours(spark, 500, 2), 51) == (4, 0)  # a replay
    rows = sink.rows()
    assert rows.count() == rows.select("cell", "ts").distinct().count() == 12 + 11 * 10 + 4
    assert {r.v for r in rows.where(F.col("ts") == T0 + timedelta(hours=5)).collect()} == {0.0}


def test_the_filter_lets_through_few_other_keys(spark):
    one, two = positions(["id"])
    bits = spark.range(2000).select(F.explode(F.array(one, two)).alias("at")).agg(F.bitmap_construct_agg("at").alias("f"))
    own = spark.range(2000).crossJoin(F.broadcast(bits)).where(has_bit(F.col("f"), one) & has_bit(F.col("f"), two)).count()
    other = spark.range(10_000, 20_000).crossJoin(F.broadcast(bits)).where(has_bit(F.col("f"), one) & has_bit(F.col("f"), two)).count()
    assert own == 2000 and other < 400


def test_sketches_of_latency_are_within_their_error(spark, tmp_path):
    rng = random.Random(2)
    sink = KeyedSink(spark, str(tmp_path / "s"), ["k"], ["k"], buckets=2)
    for b in range(3):
        rows = [(b * 3000 + i, rng.expovariate(1.0) * 1000) for i in range(3000)]
        df = spark.createDataFrame(rows, "k long, ms double").withColumn("produced_at", F.timestamp_micros((F.unix_micros(F.current_timestamp()) - F.col("ms") * 1000).cast("long"))).drop("ms")
        assert sink.write(df, b) == (3000, 0)
    got = sink.latency_sketch([0.5, 0.95]).first()
    lag = sink.rows().select(sink._lag().alias("ms"))
    exact = sink.latency_ms().first()
    assert got.n == exact.n == 9000 and got["max"] == pytest.approx(exact["max"])
    for q in (0.5, 0.95):
        rank = lag.agg(F.avg((F.col("ms") <= got[f"q_{q}"]).cast("int"))).first()[0]
        assert abs(rank - q) < 0.0025
    assert KeyedSink(spark, str(tmp_path / "none"), ["k"], ["k"]).latency_sketch([0.5]).count() == 0


def test_counters_of_a_stream(spark, tmp_path):
    """Received, emitted, inserted and ignored rows, without a job to count them."""
    for n in range(3):
        rows = [(c, T0 + timedelta(hours=h), float(h)) for h in range(n * 8, n * 8 + 8) for c in "ab"]
        spark.createDataFrame(rows, FIELDS).coalesce(1).write.parquet(str(tmp_path / "in" / f"f={n}"))
    counters = Counters()
    spark.streams.addListener(counters)
    try:
        sink = KeyedSink(spark, str(tmp_path / "sink"), ["cell", "ts"], ["v"])
        stream = spark.readStream.schema(FIELDS).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
        windows = counted(keyed_windows(counted(stream, "received", labelled=F.count_if(F.col("v") > 20)), "cell", ["ts"], ["v"], 5), "emitted")
        done = []
        with state_store(spark):
            run = windows.writeStream.queryName("cells").foreachBatch(lambda df, i: done.append(sink.write(df, i))).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        run.awaitTermination()
        for _ in range(100):
            if counters.of("cells", "emitted") == 40 and counters.ended:
                break
            time.sleep(0.1)
    finally:
        spark.streams.removeListener(counters)
    assert counters.of("cells", "received") == 48 and counters.of("cells", "received", "labelled") == 6
    assert counters.of("cells", "emitted") == 40 == sum(i for i, _ in done) and sum(g for _, g in done) == 0
    assert len(next(iter(counters.batches.values()))) == len(done)


@pytest.mark.parametrize("margin", [0, 3])
def test_interval_join(spark, margin):
    rng = random.Random(7)
    rows = [(rng.choice("ab"), rng.randrange(-50, 500)) for _ in range(400)]
    held = [(rng.choice("abc"), i, s := rng.randrange(-40, 480), s + rng.choice([0, 1, 2, 7, 30, 300])) for i in range(60)]
    df, segments = spark.createDataFrame(rows, "k string, rn int"), spark.createDataFrame(held, "k string, segment int, start_rn int, end_rn int")
    got = sorted((r.k, r.rn, r.segment) for r in intervals.around(df, segments, ["k"], margin=margin).collect())
    assert got == sorted((k, x, i) for k, x in rows for c, i, s, e in held if c == k and s - margin <= x < e + margin)
    assert intervals.around(df, segments.limit(0), ["k"]).count() == 0


def test_frames_that_differ_are_told_apart_by_bucket(spark):
    a = spark.range(5000).select(F.col("id").alias("k"), (F.col("id") * 0.1).alias("x"), F.when(F.col("id") % 10 > 0, F.col("id").cast("string")).alias("s"))
    nan = a.withColumn("x", F.when(F.col("k") == 9, F.lit(float("nan"))).otherwise(F.col("x")))
    assert reconcile.differing(a, a.orderBy(F.desc("k")), ["k"], ["x", "s"]).count() == 0
    assert reconcile.differing(nan, nan, ["k"], ["x", "s"]).count() == 0
    noise = a.withColumn("x", F.col("x") * (1 + 1e-12))
    assert reconcile.differing(a, noise, ["k"], ["x", "s"], buckets=16).count() == 0
    b = a.where("k <> 17").withColumn("x", F.when(F.col("k") == 40, F.lit(None)).when(F.col("k") == 41, F.col("x") + 1e-6).otherwise(F.col("x"))).withColumn("s", F.when(F.col("k") == 50, F.lit("null")).otherwise(F.col("s")))
    b = b.unionByName(spark.createDataFrame([(-1, 0.0, "")], "k long, x double, s string"))
    got = {(r.k, r.difference) for r in reconcile.differing(a, b, ["k"], ["x", "s"]).collect()}
    assert got == {(17, "missing"), (-1, "extra"), (40, "mismatched"), (41, "mismatched"), (50, "mismatched")}
    assert reconcile.differing(a.limit(0), a.limit(0), ["k"], ["x", "s"]).count() == 0


def test_thinning_keeps_extremes(spark):
    rng = random.Random(3)
    v = [rng.gauss(0, 1) for _ in range(1003)]
    v[500], v[77], v[900] = 40.0, -30.0, float("nan")
    df = spark.createDataFrame([("a", i + 1, T0 + timedelta(minutes=i), x, int(abs(x) > 3)) for i, x in enumerate(v)] + [("b", 1, T0, None, 0)], "k string, rn int, ts timestamp_ntz, v double, alert int")
    got = plots.thinned(df, ["v"], ["k"], 100, flags=["alert"]).orderBy("k", "pixel").collect()
    a = [r for r in got if r.k == "a"]
    assert len(a) == 100 and {r.n_rows for r in a} <= {10, 11} and max(r.max_v for r in a) == 40.0 and min(r.min_v for r in a) == -30.0
    assert sum(r.n_alert for r in a) == sum(abs(x) > 3 for x in v if x == x) and a[0].first_v == v[0] and a[-1].last_v == v[-1]
    assert [(r.pixel, r.n_rows, r.min_v) for r in got if r.k == "b"] == [(0, 1, None)]


def test_shading(spark):
    df = spark.createDataFrame([("a", i + 1, T0 + timedelta(hours=i), x, y) for i, (x, y) in enumerate([(1, 0), (1, 1), (0, 1), (1, None)])], "k string, rn int, ts timestamp_ntz, x int, y int")
    got = sorted((r.kind, r.start_rn, r.end_rn, r.n_rows) for r in plots.shaded(df, ["k"], {"one": "x", "two": "y"}).collect())
    assert got == [("one", 0, 2, 2), ("one", 3, 4, 1), ("two", 1, 3, 2)]


def test_state_of_a_hot_key_is_its_ring(spark, tmp_path):
    """Many batches of one key: the windows of the batch operator, from a state of size - 1 rows; a restart goes on."""
    rows = [(T0 + timedelta(hours=h), float(h * h % 17)) for h in range(120)]
    fields, size = "ts timestamp_ntz, v double", 7
    held = str(tmp_path / "in")
    save = lambda n: spark.createDataFrame(rows[n * 20 : n * 20 + 20], fields).coalesce(1).write.parquet(f"{held}/f={n}")

    def run():
        stream = spark.readStream.schema(fields).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(held).withColumn("k", F.lit("hot"))
        with state_store(spark):
            q = keyed_windows(stream, "k", ["ts"], ["v"], size).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        q.awaitTermination()

    for n in range(3):
        save(n)
    run()
    for n in range(3, 6):
        save(n)
    run()
    got = {r.ts: r.v for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    want = {rows[i][0]: sum(v for _, v in rows[i - size + 1 : i + 1]) / size for i in range(size - 1, 120)}
    assert got.keys() == want.keys() and all(got[t] == pytest.approx(want[t]) for t in want)
    ring = spark.read.format("statestore").option("stateVarName", "ring").load(str(tmp_path / "state"))
    assert ring.count() == size - 1
