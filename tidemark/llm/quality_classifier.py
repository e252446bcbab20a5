"""Quality classifier: hashed word n-gram logistic regression, trained by follow-the-regularised-leader.

Features are hashed n-grams of terms of the lower-cased text: 1-grams and 2-grams of letter runs, digit
runs and symbol runs, and 2-grams in which a term that repeats the one before is written as a repeat mark. A
feature's value is the share of the text's n-grams that it makes up, under a square root. A document's
score is one sparse dot product; the model is a fixed number of weights (2**BITS), whatever the data.

Training: the labelled rows are joined to their texts, and at most MOST_ROWS of them, the least by a hash
of the id, are used: a documented sample, as one model of fixed size does not gain from more. They are dealt to
SHARDS shards; each shard follows the leader over its own rows EPOCHS times, and the shards' weights are averaged.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.textops import BYTE_CODE, LOWER, SpanHash, U, mix, slices, text_bytes

BITS = 16
MOST_ROWS = 20_000
SHARDS = 8
EPOCHS = 10
ALPHA, BETA, L1, L2 = 3.0, 1.0, 0.003, 0.02
_KIND = np.zeros(256, np.uint8)  # 0 white, 1 letters and other high bytes, 2 digits, 3 symbols
_KIND[33:] = 3
_KIND[[*range(97, 123), *range(65, 91), *range(128, 256)]] = 1
_KIND[48:58] = 2


def features(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, feature and value of every distinct feature of every row, sorted by row; feature 0 is the bias."""
    rows = len(offsets) - 1
    bias = np.arange(rows)
    if not len(raw):
        return bias, np.zeros(rows, np.int64), np.ones(rows)
    low = LOWER[raw]
    kind = _KIND[low]
    edge = np.zeros(len(raw) + 1, bool)
    edge[offsets] = True
    new = np.ones(len(raw) + 1, bool)
    new[1:-1] = (kind[1:] != kind[:-1]) | edge[1:-1]
    at = np.flatnonzero(new)
    start, end = at[:-1], at[1:]
    solid = kind[start] > 0
    start, end = start[solid], end[solid]
    row = np.searchsorted(offsets, start, "right") - 1
    h = SpanHash(BYTE_CODE[low]).of(start, end)
    same = row[1:] == row[:-1] if len(row) else np.zeros(0, bool)
    again = h[1:] == h[:-1] if len(h) else np.zeros(0, bool)
    second = np.where(again, U(0x5EED), h[1:]) if len(h) else h
    first = np.where(again, U(0x5EED), h[:-1]) if len(h) else h
    shape = mix(kind[start].astype(np.uint64) * U(31) + np.minimum(end - start, 12).astype(np.uint64))
    pair = mix(first * U(3) + second)[same]
    back = mix(np.where(again, U(0xA6A1), U(0xD1FF)) + shape[1:])[same] if len(h) else h
    r = np.concatenate((row, row[1:][same], row[1:][same])) if len(row) else row
    k = np.concatenate((h, pair, back)) if len(row) else h
    f = (mix(k) % U((1 << BITS) - 1)).astype(np.int64) + 1
    code, count = np.unique(r.astype(np.int64) << BITS | f, return_counts=True)
    r, f = code >> BITS, code & ((1 << BITS) - 1)
    n = np.bincount(r, weights=count, minlength=rows)
    value = np.sqrt(count / n[r])
    order = np.argsort(np.concatenate((bias, r)), kind="stable")
    return np.concatenate((bias, r))[order], np.concatenate((np.zeros(rows, np.int64), f))[order], np.concatenate((np.ones(rows), value))[order]


def weights(z: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The leader's weights of sums of gradients z and of squared gradients n."""
    return np.where(np.abs(z) <= L1, 0.0, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2))


def probabilities(x: np.ndarray) -> np.ndarray:
    """Of scores by row and class: a softmax over the classes; a sigmoid of the score where there is one class."""
    if x.shape[-1] == 1:
        return 1 / (1 + np.exp(-np.clip(x, -35, 35)))
    e = np.exp(x - x.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def follow(f: np.ndarray, v: np.ndarray, y: np.ndarray, z: np.ndarray, n: np.ndarray) -> None:
    """One FTRL step on a row's features f and values v; z and n, a row for each class, change in place."""
    zf, nf = z[:, f], n[:, f]
    w = weights(zf, nf)
    g = (probabilities(w @ v) - y)[:, None] * v
    s = (np.sqrt(nf + g * g) - np.sqrt(nf)) / ALPHA
    z[:, f] = zf + g - s * w
    n[:, f] = nf + g * g


def held_out(id_col: Column) -> Column:
    """crc32 of the id as text, modulo 5, is 0; a null id counts as an empty text, whose crc32 is 0."""
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def fit_shards(data: DataFrame, n_models: int) -> np.ndarray:
    """Weights of one model of n_models classes, a row each; data is (shard, id, y array<int>, text), of bounded size."""

    def fit(t: pa.Table) -> pa.Table:
        t = t.sort_by([("id", "ascending"), ("text", "ascending")])
        y = np.array([[v or 0 for v in r] for r in t.column("y").to_pylist()], float)
        raw, offsets = text_bytes(t.column("text"))
        known = []
        for a, b in slices(offsets):
            row, feature, value = features(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
            ends = np.searchsorted(row, np.arange(b - a), "right")
            known += [(feature[x:z].astype(np.int32), value[x:z].astype(np.float32)) for x, z in zip(np.append(0, ends[:-1]), ends, strict=True)]
        z, n = np.zeros((2, n_models, 1 << BITS))
        for epoch in range(EPOCHS):
            for i in np.random.default_rng(epoch).permutation(len(known)):
                follow(*known[i], y[i], z, n)
        return pa.table({"w": [weights(z, n).tobytes()], "n": pa.array([len(known)], pa.int64())})

    got = data.groupBy("shard").applyInArrow(fit, "w binary, n long").collect()  # SHARDS rows of fixed size
    if not got:
        return np.zeros((n_models, 1 << BITS))
    return sum(r.n * np.frombuffer(r.w).reshape(n_models, -1) for r in got) / sum(r.n for r in got)


def training_rows(docs: DataFrame, labelled: DataFrame, id_col: str, text_col: str, most_rows: int = MOST_ROWS) -> DataFrame:
    """(shard, id, y, text) of at most most_rows labelled rows; labelled is (id, y). An id that is labelled twice, but not alike, does not count."""
    alike = labelled.where("id is not null").groupBy("id").agg(F.min("y").alias("y"), F.max("y").alias("_most")).where("y = _most").drop("_most")
    chosen = alike.orderBy(F.xxhash64("id"), "id").limit(most_rows)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(chosen), "id")
    return rows.select(F.pmod(F.xxhash64(F.lit("shard"), "id"), F.lit(SHARDS)).cast("int").alias("shard"), "id", "y", "text")


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", most_rows: int = MOST_ROWS) -> np.ndarray:
    """The weights, learned from labelled rows that are not held out. Rows with a null label do not count.

    Without any labelled row all weights are 0 and every score is 0.5. Rows that repeat, or share an id, count as often
    as they occur in docs; rows without an id are not learned from. Texts of any length count whole.
    """
    known = labels.where(F.col(label_col).isNotNull() & ~held_out(F.col(id_col)))
    labelled = known.select(F.col(id_col).alias("id"), F.array(F.col(label_col).cast("int")).alias("y"))
    return fit_shards(training_rows(docs, labelled, id_col, text_col, most_rows), 1)[0]


def score(docs: DataFrame, model: np.ndarray, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score) of every row, in any order.

    A null text is scored as an empty one: by the bias alone. Texts of any length count whole. Rows that repeat, or
    share an id, are returned as often as they occur; a null id stays null. Other columns are not read. An empty table
    gives an empty one.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, at = text_bytes(batch.column(1))
            for a, b in slices(at):
                part = batch.slice(a, b - a)
                row, feature, value = features(*text_bytes(part.column(1)))
                x = np.bincount(row, weights=held.value[feature] * value, minlength=b - a)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(1 / (1 + np.exp(-np.clip(x, -35, 35))))], names=["id", "score"])

    return docs.select(id_col, text_col).mapInArrow(run, f"id {docs.schema[id_col].dataType.simpleString()}, score double")


def op9_query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    out = score(docs, train(docs, labels))
    return out.select(F.col("id").alias("doc_id"), held_out(F.col("id")).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def crc_remainder(doc_id: int) -> int:
    """The remainder of held_out in Python, for tests."""
    return zlib.crc32(str(doc_id).encode()) % 5
