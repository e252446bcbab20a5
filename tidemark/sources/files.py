"""File and broker sources and sinks behind one interface: everything downstream sees a DataFrame."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery


def kpi_schema(kpis: list[str], key: str | None = None) -> T.StructType:
    """ts, key, KPIs, label, scenario; never inferred."""
    fields = [T.StructField("ts", T.TimestampNTZType())]
    fields += [T.StructField(key, T.StringType())] if key else []
    fields += [T.StructField(k, T.DoubleType()) for k in kpis]
    return T.StructType([*fields, T.StructField("label", T.IntegerType()), T.StructField("scenario", T.StringType())])


def _clean(df: DataFrame) -> DataFrame:
    return df.withColumn("scenario", F.coalesce("scenario", F.lit(""))) if "scenario" in df.columns else df


def read_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return _clean(spark.read.schema(schema).option("header", True).csv(path))


def stream_csv(spark: SparkSession, path: str, schema: T.StructType, files_per_trigger: int = 1) -> DataFrame:
    return _clean(spark.readStream.schema(schema).option("header", True).option("maxFilesPerTrigger", files_per_trigger).csv(path))


def stream_parquet(spark: SparkSession, path: str, schema: T.StructType, files_per_trigger: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def decode(value: Column, schema: T.StructType) -> Column:
    return F.from_json(value.cast("string"), schema)


def encode(df: DataFrame) -> Column:
    return F.to_json(F.struct(*[F.col(c) for c in df.columns]), {"ignoreNullFields": "false"})


def kafka_source(spark: SparkSession, servers: str, topic: str, schema: T.StructType, per_trigger: int = 500) -> DataFrame:
    """partition, offset, produced_at and the record's fields. Needs the Kafka connector on the class path."""
    raw = spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic).option("startingOffsets", "earliest").option("maxOffsetsPerTrigger", per_trigger).load()
    return raw.select("partition", "offset", F.col("timestamp").alias("produced_at"), decode(F.col("value"), schema).alias("r")).select("partition", "offset", "produced_at", "r.*")


def kafka_rows(df: DataFrame, key: str | None = None) -> DataFrame:
    """value, the record as JSON, after key where one is named; without a key the broker spreads the records."""
    keys = [F.col(key).cast("string").alias("key")] if key else []
    return df.select(*keys, encode(df).alias("value"))


def kafka_sink(df: DataFrame, servers: str, topic: str, key: str | None = None, checkpoint: str | None = None) -> StreamingQuery | None:
    """Write df to the topic; a stream needs a checkpoint folder, and is returned started."""
    rows, options = kafka_rows(df, key), {"kafka.bootstrap.servers": servers, "topic": topic}
    if not df.isStreaming:
        return rows.write.format("kafka").options(**options).save()
    if checkpoint is None:
        raise ValueError("a stream needs a checkpoint folder")
    return rows.writeStream.format("kafka").options(**options, checkpointLocation=checkpoint).start()


def write_csv(df: DataFrame, path: str) -> None:
    """CSV files with a header, in place of what was there; read_csv reads them back."""
    df.write.mode("overwrite").option("header", True).csv(path)


def open_source(spark: SparkSession, mode: str, schema: T.StructType, **where: str) -> DataFrame:
    """mode: batch, file_stream or kafka."""
    if mode == "batch":
        return read_csv(spark, where["path"], schema)
    if mode == "file_stream":
        return stream_csv(spark, where["path"], schema)
    if mode == "kafka":
        return kafka_source(spark, where["servers"], where["topic"], schema)
    raise ValueError(f"unknown source mode {mode}")
