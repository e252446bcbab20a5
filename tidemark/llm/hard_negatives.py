"""Hard negatives of anchors, from exact inner products by the method of the Four Russians.

Components are whole numbers. A candidate is stored as bit planes: of each group of eight dimensions, one byte for each
bit of the components, in two's complement. For an anchor and a group a table holds the sums of the anchor's components
over all 256 subsets of the eight dimensions. The bytes of a candidate's plane look up these sums; the planes are added
from the highest, which counts as negative, on, doubling what is there before each. That is the inner product, exactly.

Rows are dealt at random into chunks and anchors into blocks of bounded size; every chunk meets every block in a cell
of its own. The first pass keeps of each cell the best rows of the anchors' own labels, the second one the best rows of
other labels within the bounds that each positive sets. What cells keep is bounded by anchors, not by rows.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.runtime import cut, drop_held, shuffle_partitions, smaller_batches

BLOCK, CHUNK, LEAST_CHUNK = 8192, 65536, 1024  # anchors of a block, rows of a chunk at most and in general at least
TILE_ANCHORS, TILE_ROWS = 64, 2048  # scores held at a time


def planes(v: np.ndarray, bits: int) -> np.ndarray:
    """(rows, bits, groups) bytes of rows of whole numbers, whose number of columns is a multiple of 8."""
    return np.stack([np.packbits(((v >> b) & 1).astype(np.uint8), axis=1, bitorder="little") for b in range(bits)], 1)


def subset_sums(anchors: np.ndarray) -> np.ndarray:
    """(groups, 256, anchors): sums of each anchor's components over every subset of a group of eight dimensions."""
    n, dims = anchors.shape
    a = np.ascontiguousarray(anchors.T).reshape(dims // 8, 8, n)
    out = np.zeros((dims // 8, 256, n), anchors.dtype)
    for d in range(8):
        out[:, 1 << d : 2 << d] = out[:, : 1 << d] + a[:, d, None]
    return out


def scores(sums: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """(anchors, rows) inner products, from the anchors' sums and the rows' planes."""
    rows, bits, groups = codes.shape
    total = np.zeros((rows, sums.shape[2]), sums.dtype)
    part = np.empty_like(total)
    for b in reversed(range(bits)):
        total += total
        for g in range(groups):
            np.take(sums[g], codes[:, b, g], axis=0, out=part, mode="clip")
            total += part
        if b == bits - 1:
            np.negative(total, out=total)
    return np.ascontiguousarray(total.T)


def best(score: np.ndarray, ids: np.ndarray, k: int, least: int) -> tuple[np.ndarray, np.ndarray]:
    """(anchors, k) scores and ids of the best columns; ids ascend, so the first of equals has the least. Uses up score."""
    each, found, named = np.arange(len(score)), [], []
    for _ in range(k):
        i = score.argmax(1)
        found.append(score[each, i])
        named.append(ids[i])
        score[each, i] = least
    return np.stack(found, 1), np.stack(named, 1)


class Cell:
    """The anchors and the rows of a cell, as arrays; rows by id."""

    def __init__(self, anchors: pa.Table, rows: pa.Table, dims: int, bits: int):
        rows = rows.sort_by("id")
        self.row, self.label = anchors.column("anchor").to_numpy(), anchors.column("own_label").to_numpy()
        self.vectors = np.frombuffer(b"".join(anchors.column("vector").to_pylist()), np.int64).reshape(-1, dims)
        most = int(np.abs(self.vectors).max(initial=0)) << bits
        self.vectors = self.vectors.astype(np.int32 if most * dims < 2**31 else np.int64)
        self.least = np.iinfo(self.vectors.dtype).min
        self.rows, self.ids, self.labels = (rows.column(c).to_numpy() for c in ("row", "id", "label"))
        self.codes = np.frombuffer(b"".join(rows.column("codes").to_pylist()), np.uint8).reshape(-1, bits, dims // 8)

    def tiles(self, anchors: np.ndarray, rows: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(anchors, rows, scores) of parts of the given ones."""
        for a in range(0, len(anchors), TILE_ANCHORS):
            x = anchors[a : a + TILE_ANCHORS]
            sums = subset_sums(self.vectors[x])
            for b in range(0, len(rows), TILE_ROWS):
                y = rows[b : b + TILE_ROWS]
                yield x, y, scores(sums, self.codes[y])


def _kept(parts: list[np.ndarray], k: int) -> pa.Table:
    """The best k of (row, slot, score, id), by score and then by least id, for each row and slot."""
    row, slot, score, id_ = np.concatenate(parts, 1) if parts else np.zeros((4, 0), np.int64)
    order = np.lexsort((id_, -score, slot, row))
    row, slot, score, id_ = row[order], slot[order], score[order], id_[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (slot[1:] != slot[:-1])
    rank = np.arange(len(row)) - np.maximum.accumulate(np.where(new, np.arange(len(row)), 0))
    top = rank < k
    return pa.table({"row": row[top], "slot": slot[top].astype(np.int32), "score": score[top], "id": id_[top]})


KEPT = "row long, slot int, score long, id long"


def _positives(cell: Cell, k: int) -> pa.Table:
    parts = []
    for label in np.unique(cell.label):
        for x, y, s in cell.tiles(np.flatnonzero(cell.label == label), np.flatnonzero(cell.labels == label)):
            s[cell.row[x][:, None] == cell.rows[y][None]] = cell.least
            value, named = best(s, cell.ids[y], min(k, len(y)), cell.least)
            i, j = np.nonzero(value != cell.least)
            parts.append(np.stack([cell.row[x][i], np.zeros(len(i), np.int64), value[i, j].astype(np.int64), named[i, j]]))
    return _kept(parts, k)


def _negatives(cell: Cell, bounds: np.ndarray, k: int) -> pa.Table:
    """bounds: (anchors, slots, 2) least and greatest score of each positive's negatives; none where they are reversed."""
    parts = []
    for x, y, s in cell.tiles(np.arange(len(cell.row)), np.arange(len(cell.rows))):
        other = cell.label[x][:, None] != cell.labels[y][None]
        for slot in range(bounds.shape[1]):
            low, high = bounds[x, slot, 0][:, None], bounds[x, slot, 1][:, None]
            value, named = best(np.where(other & (s >= low) & (s <= high), s, cell.least), cell.ids[y], min(k, len(y)), cell.least)
            i, j = np.nonzero(value != cell.least)
            parts.append(np.stack([cell.row[x][i], np.full(len(i), slot), value[i, j].astype(np.int64), named[i, j]]))
        if len(parts) > 400:
            t = _kept(parts, k)
            parts = [np.stack([t.column(c).to_numpy().astype(np.int64) for c in ("row", "slot", "score", "id")])]
    return _kept(parts, k)


def _top(found: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("row", "slot").orderBy(F.desc("score"), "id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def hard_negatives(rows: DataFrame, anchors: Column, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", scale: float = 256.0, n_positives: int = 5, n_negatives: int = 3, percent: tuple[int, int] = (50, 95)) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of the rows for which `anchors` holds.

    A component x counts as floor(scale * x), a score is the inner product of these. Higher scores come first, ties by
    the lesser id. An anchor's positives are its first n_positives other rows of its label; of each positive the first
    n_negatives rows of other labels are returned whose score is from percent[0] to percent[1] percent of the
    positive's, all where there are fewer; none if there is no such row.

    Rows with a null id, label or vector, or a null or non-finite component, take no part. Vectors may be of any length;
    shorter ones count as if zeros followed. Rows that share an id each count as rows of their own, as anchors too, so
    that an id can be listed more than once. Labels are whole numbers. Other columns are not read. An empty table gives
    an empty one. Components so large that a score might exceed a long raise ValueError.
    """
    spark = rows.sparkSession
    smaller_batches(spark)
    scaled = lambda x: x.cast("double") * F.lit(float(scale))
    sound = F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & F.coalesce(F.forall(vector_col, lambda x: x.isNotNull() & (F.abs(x.cast("double")) < float("inf"))), F.lit(False))
    used = rows.where(sound).select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), F.coalesce(anchors, F.lit(False)).alias("anchor"), F.col(vector_col).alias("v"))
    large = F.array_max(F.transform("v", lambda x: F.abs(scaled(x))))
    n, n_anchors, dims, most = used.agg(F.count("*"), F.count_if("anchor"), F.max(F.size("v")), F.max(large)).first()
    dims = -(-max(dims or 0, 1) // 8) * 8
    most = (most or 0.0) + 1
    if dims * most * most >= 2.0**62:
        raise ValueError(f"components of up to {most:g} in {dims} dimensions: scores would exceed a long")
    bits = int(most).bit_length() + 1

    def coded(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drop_held()
        for b in batches:
            v = np.zeros((b.num_rows, dims), np.int64)
            held = b.column("v")
            lengths = np.diff(held.offsets.to_numpy())
            where = np.arange(dims)[None] < lengths[:, None]
            v[where] = held.flatten().to_numpy(zero_copy_only=False)
            vectors = [x.tobytes() if a else None for x, a in zip(v, b.column("anchor").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("label"), pa.array(vectors, pa.binary()), pa.array([x.tobytes() for x in planes(v, bits)], pa.binary())], names=["id", "label", "vector", "codes"])

    whole = used.withColumn("v", F.transform("v", lambda x: F.floor(scaled(x))))
    base = whole.mapInArrow(coded, "id long, label long, vector binary, codes binary")
    base = cut(base.withColumn("row", F.monotonically_increasing_id()))

    parts = shuffle_partitions(spark)
    blocks = max(1, -(-n_anchors // BLOCK))
    chunks = max(1, -(-n // min(CHUNK, max(LEAST_CHUNK, n * blocks // (4 * parts)))))
    dealt = lambda salt, k: F.pmod(F.xxhash64(F.lit(salt), "row"), F.lit(k)).cast("int")
    every = lambda k: F.explode(F.sequence(F.lit(0), F.lit(k - 1)))
    grouped = lambda df, name: df.withColumn(name, F.col("block") * chunks + F.col("chunk")).drop("block", "chunk").repartition(parts, name).groupBy(name)
    candidates = base.select("row", "id", "label", "codes", dealt("chunk", chunks).alias("chunk")).withColumn("block", every(blocks))
    chosen = base.where("vector is not null").select(F.col("row").alias("anchor"), F.col("label").alias("own_label"), "vector", dealt("block", blocks).alias("block"))

    def met(chosen: DataFrame, run) -> DataFrame:
        """The results of all cells."""
        return grouped(chosen.withColumn("chunk", every(chunks)), "anchor_cell").cogroup(grouped(candidates, "cell")).applyInArrow(run, KEPT)

    def near(a: pa.Table, r: pa.Table) -> pa.Table:
        return _positives(Cell(a, r, dims, bits), n_positives)

    positives = cut(_top(met(chosen, near), n_positives).select("row", F.col("rank").alias("slot"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score")))
    known = positives.groupBy("row").agg(F.transform(F.sort_array(F.collect_list(F.struct("slot", "positive_score"))), lambda p: p["positive_score"]).alias("positives"))

    def far(a: pa.Table, r: pa.Table) -> pa.Table:
        got = a.column("positives").to_pylist()
        bounds = np.zeros((len(got), n_positives, 2), np.int64)
        bounds[:, :, 0] = 1  # reversed where there is no such positive
        for i, p in enumerate(got):
            p = np.array(p, np.int64)
            bounds[i, : len(p), 0], bounds[i, : len(p), 1] = -(-percent[0] * p // 100), percent[1] * p // 100
        return _negatives(Cell(a, r, dims, bits), bounds, n_negatives)

    found = _top(met(chosen.join(known.withColumnRenamed("row", "anchor"), "anchor"), far), n_negatives)
    out = found.select("row", (F.col("slot") + 1).alias("slot"), "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score")).join(positives, ["row", "slot"])
    out = out.join(base.where("vector is not null").select("row", F.col("id").alias("anchor_id")), "row")
    return out.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def op13_query(spark, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding", "label")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(rows.withColumn("label", label), F.col("vec_id") % 50 == 0)


OP13_SQL = """
WITH r AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v
           FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
     s AS (SELECT a.vec_id AS anchor_id, c.vec_id AS id, a.label = c.label AS alike, list_sum(list_transform(list_zip(a.v, c.v), lambda z: z[1] * z[2]))::BIGINT AS score
           FROM r a JOIN r c ON a.vec_id <> c.vec_id WHERE a.vec_id % 50 = 0),
     p AS (SELECT anchor_id, id, score FROM s WHERE alike QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT p.anchor_id, p.id AS positive_id, row_number() OVER (PARTITION BY p.anchor_id, p.id ORDER BY s.score DESC, s.id)::INT AS rank, s.id AS negative_id, p.score AS positive_score, s.score AS negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.alike AND 50 * p.score <= 100 * s.score AND 100 * s.score <= 95 * p.score QUALIFY rank <= 3
"""
