"""Reconciliation of stored output with what was expected, and audits of key placement."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.scalars import near
from tidemark.operators.windows import expected_windows


def compare(expected: DataFrame, got: DataFrame, keys: list[str], values: list[str], by: list[str]) -> DataFrame:
    """(by, n_expected, n_got, n_missing, n_extra, n_mismatched) from one full outer join on the keys."""
    e = expected.select(*keys, *[F.col(v).alias(f"_e_{v}") for v in values], F.lit(1).alias("_e"))
    g = got.select(*keys, *[F.col(v).alias(f"_g_{v}") for v in values], F.lit(1).alias("_g"))
    both = e.join(g, keys, "full_outer")
    here, there = F.col("_e").isNotNull(), F.col("_g").isNotNull()
    same = F.lit(True)
    for v in values:
        same = same & near(F.col(f"_e_{v}"), F.col(f"_g_{v}"))
    return both.groupBy(*by).agg(F.count_if(here).alias("n_expected"), F.count_if(there).alias("n_got"), F.count_if(here & ~there).alias("n_missing"), F.count_if(there & ~here).alias("n_extra"), F.count_if(here & there & ~same).alias("n_mismatched"))


def count_check(records: DataFrame, stored: DataFrame, key: str, size: int, stride: int) -> DataFrame:
    """(key, n_records, n_expected, n_stored, ok): windows due for the records of each key, and those stored."""
    due = records.groupBy(key).agg(F.count("*").alias("n_records")).withColumn("n_expected", expected_windows(F.col("n_records"), size, stride))
    have = stored.groupBy(key).agg(F.count("*").alias("n_stored"))
    out = due.join(have, key, "full_outer").fillna(0, ["n_records", "n_expected", "n_stored"])
    return out.withColumn("ok", F.col("n_expected") == F.col("n_stored"))


def placement(df: DataFrame, key: str, partition: str) -> DataFrame:
    """(key, n_partitions, n_rows, is_split): a key belongs to one partition alone."""
    return df.groupBy(key).agg(F.countDistinct(partition).alias("n_partitions"), F.count("*").alias("n_rows")).withColumn("is_split", F.col("n_partitions") > 1)


def skew(df: DataFrame, key: str, partition: str, partitions: int) -> DataFrame:
    """(partition, n_keys, n_rows, max_over_mean) with a row for empty partitions too."""
    spark = df.sparkSession
    spine = spark.range(partitions).select(F.col("id").cast("int").alias(partition))
    n = df.groupBy(partition).agg(F.countDistinct(key).alias("n_keys"), F.count("*").alias("n_rows"))
    out = spine.join(n, partition, "left").fillna(0, ["n_keys", "n_rows"])
    ratio = out.agg((F.max("n_keys") / F.avg("n_keys")).alias("max_over_mean"))
    return out.crossJoin(F.broadcast(ratio))  # one row


def _digests(df: DataFrame, keys: list[str], values: list[str], side: str, buckets: int) -> DataFrame:
    row = F.xxhash64(*keys, *[x for v in values for x in (F.col(v).isNull(), F.col(v))]).cast("decimal(20,0)")
    return df.groupBy(_bucket(keys, buckets).alias("bucket")).agg(F.count("*").alias(f"n_{side}"), F.sum(row).alias(f"sum_{side}"))


def _bucket(keys: list[str], buckets: int):
    return F.pmod(F.xxhash64(F.lit("bucket"), *keys), F.lit(buckets)).cast("int")


def differing(expected: DataFrame, got: DataFrame, keys: list[str], values: list[str], buckets: int = 1024) -> DataFrame:
    """(keys, difference, e_<value>..., g_<value>...): rows that are missing, extra or mismatched, keys being unique on each side.

    Each side is first summed up by hash bucket of the key: the number of rows and the sum of row hashes, which do not
    depend on order. Only buckets whose sums differ are compared row by row, where values within a relative and absolute
    1e-9 are equal, and so are two nulls and two NaN. Equal frames cost one aggregate each. The buckets' numbers are broadcast: `buckets` at most.
    """
    e, g = _digests(expected, keys, values, "e", buckets), _digests(got, keys, values, "g", buckets)
    apart = e.join(g, "bucket", "full_outer").where(~(F.col("n_e").eqNullSafe(F.col("n_g")) & F.col("sum_e").eqNullSafe(F.col("sum_g")))).select("bucket")
    inside = lambda df: df.withColumn("bucket", _bucket(keys, buckets)).join(F.broadcast(apart), "bucket", "left_semi")
    e = inside(expected).select(*keys, *[F.col(v).alias(f"e_{v}") for v in values], F.lit(1).alias("_e"))
    g = inside(got).select(*keys, *[F.col(v).alias(f"g_{v}") for v in values], F.lit(1).alias("_g"))
    same = F.lit(True)
    for v in values:
        a, b = F.col(f"e_{v}"), F.col(f"g_{v}")
        same = same & (a.eqNullSafe(b) | near(a, b) if dict(expected.dtypes)[v] in ("double", "float") else a.eqNullSafe(b))
    kind = F.when(F.col("_g").isNull(), "missing").when(F.col("_e").isNull(), "extra").when(~same, "mismatched")
    out = e.join(g, keys, "full_outer").withColumn("difference", kind).where("difference is not null")
    return out.select(*keys, "difference", *[f"{s}_{v}" for v in values for s in ("e", "g")])
