"""Overwrite tables and SQL queries over them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


class Store:
    """Tables in the session's catalog; writing one replaces it."""

    def __init__(self, spark: SparkSession, database: str = "default"):
        self.spark, self.database = spark, database
        spark.sql(f"CREATE DATABASE IF NOT EXISTS {database}")

    def write(self, table: str, df: DataFrame) -> int:
        name = f"{self.database}.{table}"
        df.write.mode("overwrite").saveAsTable(name)
        return self.spark.table(name).count()

    def query(self, sql: str, params: list | None = None) -> DataFrame:
        return self.spark.sql(sql, args=params) if params else self.spark.sql(sql)

    def tables(self) -> list[str]:
        return sorted(t.name for t in self.spark.catalog.listTables(self.database) if not t.isTemporary)

    def truncate(self, table: str) -> None:
        name = f"{self.database}.{table}"
        schema = self.spark.table(name).schema
        self.spark.createDataFrame([], schema).write.mode("overwrite").saveAsTable(name)

    def drop(self, table: str) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.database}.{table}")
