"""Corpus pipeline: quality rules, near-duplicates, repeated passages, mixing, token ids.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes every stage's result as Parquet
and reads it again as the next one's docs. All but the last return the columns of documents. Rows of
documents need no doc_id of their own: every stage decides for each row. Where one document of several stays, or
keeps a passage, it is the one with the least doc_id; rows with a null doc_id come after all others, and rows that
share one come in the order in which they are stored. Equal rows get the same verdict and the same number of copies.
The columns of documents must be there; others are dropped. A null text fails the quality rules, and counts as an empty
one in the other stages, where it stays null. Texts of any length are read whole.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.bpe_automaton import token_digests
from tidemark.llm.mixing import copies, mix
from tidemark.llm.near_dedup import near_duplicates
from tidemark.llm.quality_rules import judge
from tidemark.llm.runtime import checkpoint_ready
from tidemark.llm.suffix_dedup import remove_repeats

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
MOST_COPIES = 2
ORACLE_SQL = None  # the vocabularies and models of the stages are not in SQL; tests hold them to brute force


def row_key() -> Column:
    """A hash of a row's doc_id, lang and text, which say all that a verdict or a rate depends on; never null."""
    lang = F.concat(F.coalesce(F.length("lang").cast("string"), F.lit("-")), F.lit("\0"), F.coalesce("lang", F.lit("")))
    text = F.coalesce(F.concat(F.lit("+"), "text"), F.lit("-"))
    return F.unhex(F.sha2(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), F.lit("\0"), lang, text), 256))


def numbered(spark: SparkSession, docs: DataFrame) -> tuple[DataFrame, str]:
    """docs, and the column that tells its rows apart in the order of doc_id.

    That is doc_id itself where it does. Otherwise the rows are sorted, and written once with their numbers, so that
    all later reads see the same ones.
    """
    docs = docs.select(*COLUMNS)
    if docs.groupBy("doc_id").count().where("doc_id is null or count > 1").isEmpty():
        return docs, "doc_id"
    checkpoint_ready(spark)
    at = f"{spark.sparkContext.getCheckpointDir()}/numbered-{uuid.uuid4().hex}"
    stored = docs.withColumn("stored", F.monotonically_increasing_id())
    in_order = stored.orderBy(F.col("doc_id").asc_nulls_last(), "stored").drop("stored")
    in_order.withColumn("row", F.monotonically_increasing_id()).write.parquet(at)
    return spark.read.parquet(at), "row"


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that neither the base rules nor the fertility bands reject."""
    keyed = docs.select(*COLUMNS, row_key().alias("key"))
    kept = judge(keyed, "key").where("kept").select(F.col("id").alias("key")).distinct()
    return keyed.join(kept, "key", "left_semi").select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The least document of every group of near-duplicates."""
    docs, row = numbered(spark, docs)
    kept = near_duplicates(docs, row).where("kept").select(F.col("id").alias(row))
    return docs.join(kept, row, "left_semi").select(*COLUMNS)


def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the 50-byte strings that a smaller document has; characters cut in two go as well."""
    docs, row = numbered(spark, docs)
    found = remove_repeats(docs, row, kept_text=True).withColumn("text", F.col("kept_text"))
    return found.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """As many copies of each document as its rate asks for, MOST_COPIES at most.

    A document that is most likely clean has one at least. Others are thinned out where their domain has more than its
    target share; they are never repeated. Rows with a null text have no tokens, and a rate as the model has it for
    an empty one.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    keyed = docs.select(*COLUMNS, row_key().alias("key"))
    rates = mix(keyed, labels, row_col="key", whole="high", most=MOST_COPIES).select(F.col("id").alias("key"), copies(F.col("rate"), F.col("id")).alias("n_copies"))
    mixed = keyed.join(rates.groupBy("key").agg(F.max("n_copies").alias("n_copies")), "key")
    return mixed.where("n_copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("n_copies")))).select(*COLUMNS)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document of the mix, with their number and digests of ids and decoded texts."""
    return token_digests(docs, ids=True).withColumnRenamed("id", "doc_id")


STAGES = [("quality_rules", quality), ("near_dedup", near_dedup), ("suffix_dedup", passages), ("mixing", mixing), ("bpe_tokens", token_ids)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    checkpoint_ready(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        at = f"{folder}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(at)
        docs = spark.read.parquet(at)
    return docs
