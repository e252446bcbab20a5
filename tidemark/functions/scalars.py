"""Scalar column functions: buckets, scores, guards, formats, and the broker's key hash."""

from __future__ import annotations


import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

AGGREGATES = {
    "mean": lambda c: F.avg(c),
    "max": lambda c: F.max(c),
    "p95": lambda c: F.percentile(c, F.lit(0.95)),
}


def aggregate(name: str):
    if name not in AGGREGATES:
        raise ValueError(f"unknown aggregate {name}; known: {', '.join(AGGREGATES)}")
    return AGGREGATES[name]


def bucket_key(ts: Column, minutes: int) -> Column:
    """Day type and time of day: weekend buckets follow the weekday ones."""
    slot = F.floor((F.hour(ts) * 60 + F.minute(ts)) / F.lit(minutes)).cast("int")
    return (F.weekday(ts) >= 5).cast("int") * F.lit(1440 // minutes) + slot


def guarded(sd: Column) -> Column:
    """A standard deviation, or 1 where it is missing or not above 0."""
    return F.when(sd > 0, sd).otherwise(F.lit(1.0))


def zscore(x: Column, mean: Column, sd: Column) -> Column:
    return (x - mean) / guarded(sd)


def over(x: Column, limit: float | Column) -> Column:
    """|x| > limit; false for null and NaN, which Spark would put above every number."""
    return F.coalesce(~F.isnan(x) & (F.abs(x) > limit), F.lit(False))


def trigger(flags: dict[str, Column]) -> Column:
    """Names whose flag holds, joined by commas in the order given; empty when none does."""
    return F.concat_ws(",", *[F.when(f, F.lit(k)) for k, f in flags.items()])


def larger(a: Column, b: Column) -> Column:
    """The one further from 0; the first of equals."""
    return F.when(F.abs(a) >= F.abs(b), a).otherwise(b)


def clip(x: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def bad_sign(direction: str) -> float:
    return 1.0 if direction == "higher_is_worse" else -1.0


def near(a: Column, b: Column, rtol: float = 1e-9, atol: float = 1e-9) -> Column:
    """Equal within atol + rtol * |b|; NaN and null are near nothing."""
    return F.coalesce(~F.isnan(a) & ~F.isnan(b) & (F.abs(a - b) <= atol + rtol * F.abs(b)), F.lit(False))


def ratio(a: Column, b: Column) -> Column:
    """a / b, and 0 where b is 0."""
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def entity_name(prefix: str, i: Column) -> Column:
    return F.format_string("%s%03d", F.lit(prefix), i)


def elapsed_ms(a: Column, b: Column) -> Column:
    """Milliseconds from b to a."""
    return (F.unix_micros(a.cast("timestamp")) - F.unix_micros(b.cast("timestamp"))) / 1000


def from_epoch_ms(ms: Column) -> Column:
    """The instant of milliseconds since 1970 in UTC; null stays null."""
    return F.timestamp_millis(ms.cast("long"))


def murmur2(data: bytes) -> int:
    """Kafka's public 32-bit murmur2 of a key."""
    m, mask = 0x5BD1E995, 0xFFFFFFFF
    h = (0x9747B28C ^ len(data)) & mask
    whole = len(data) // 4 * 4
    for k in np.frombuffer(data[:whole], "<u4").tolist():
        k = k * m & mask
        k = (k ^ k >> 24) * m & mask
        h = (h * m & mask) ^ k
    tail = data[whole:]
    if tail:
        h = (h ^ int.from_bytes(tail, "little")) * m & mask
    h = (h ^ h >> 13) * m & mask
    return h ^ h >> 15


@F.pandas_udf(T.IntegerType())
def _murmur2_positive(keys: pd.Series) -> pd.Series:
    known = {k: murmur2(str(k).encode()) & 0x7FFFFFFF for k in keys.dropna().unique()}
    return keys.map(known).astype("Int32")


def broker_partition(key: Column, partitions: int) -> Column:
    """The partition that Kafka's default keyed partitioner picks. Spark's hash() is another function."""
    return _murmur2_positive(key.cast("string")) % partitions
