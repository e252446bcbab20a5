"""What a crash costs under different commit rules, as plans over the log of one run.

A log has (partition, offset, key). Windows of a key are counted as in operators.windows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

RULES = ("on_read", "last_after_write", "window_safe")


def emitted(log: DataFrame, size: int, stride: int) -> DataFrame:
    """log with rn of the key and `emits`."""
    by = Window.partitionBy("key").orderBy("offset")
    first = max(size, stride)
    out = log.withColumn("rn", F.row_number().over(by))
    return out.withColumn("emits", (F.col("rn") >= first) & ((F.col("rn") - first) % stride == 0))


def resume_positions(log: DataFrame, size: int, stride: int) -> DataFrame:
    """(partition, key, resume): the first offset that a restart must read so that no window of the key is lost.

    After the last emitting row e that is row e - size + 1 + stride of the key, the first row of the next window.
    """
    if stride > size:
        raise ValueError("stride must not exceed size")
    rows = emitted(log, size, stride)
    last = rows.groupBy("partition", "key").agg(F.max(F.when(F.col("emits"), F.col("rn"))).alias("e"), F.min("offset").alias("first"), F.max(F.when(F.col("emits"), F.col("offset"))).alias("at"))
    need = F.col("e") - size + 1 + stride
    found = rows.join(last, ["partition", "key"]).where(F.col("rn") == need).select("partition", "key", F.col("offset").alias("needed"))
    out = last.join(found, ["partition", "key"], "left")
    return out.select("partition", "key", F.when(F.col("e").isNull(), F.col("first")).otherwise(F.coalesce("needed", F.col("at") + 1)).alias("resume"))


def crash_cost(log: DataFrame, size: int, crash_at: int, batch: int) -> DataFrame:
    """(rule, n_reread, n_lost, n_again) for a crash in each partition after `crash_at` records, with stride 1.

    The batch that holds record crash_at is read but not written. on_read has committed that batch's end;
    last_after_write the end of the batch before; window_safe the least resume position of the keys of the partition. n_lost are
    windows that neither run emits, n_again those that both do.
    """
    whole = emitted(log, size, 1)
    done = F.floor(F.lit(crash_at) / batch) * batch
    end = done + batch
    before = log.where(F.col("offset") < done)
    safe = resume_positions(before, size, 1).groupBy("partition").agg(F.min("resume").alias("window_safe"))
    parts = log.groupBy("partition").agg(F.max("offset").alias("top")).join(safe, "partition", "left")
    start = F.array(
        F.struct(F.lit("on_read").alias("rule"), F.least(end, F.col("top") + 1).alias("start")),
        F.struct(F.lit("last_after_write").alias("rule"), F.least(done, F.col("top") + 1).alias("start")),
        F.struct(F.lit("window_safe").alias("rule"), F.least(F.coalesce("window_safe", F.lit(0)), F.col("top") + 1).alias("start")),
    )
    runs = parts.select("partition", F.explode(start).alias("s")).select("partition", "s.*")
    rows = whole.join(runs, "partition")
    by = Window.partitionBy("rule", "key").orderBy("offset")
    first = (F.col("offset") < done) & F.col("emits")
    seen = F.sum((F.col("offset") >= F.col("start")).cast("int")).over(by)
    second = (F.col("offset") >= F.col("start")) & (seen >= size)
    rows = rows.select("rule", "emits", first.alias("one"), second.alias("two"), ((F.col("offset") >= F.col("start")) & (F.col("offset") < end)).alias("again"))
    return rows.groupBy("rule").agg(F.count_if("again").alias("n_reread"), F.count_if(F.col("emits") & ~F.col("one") & ~F.col("two")).alias("n_lost"), F.count_if(F.col("one") & F.col("two")).alias("n_again"))
