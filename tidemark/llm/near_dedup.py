"""Near-duplicate groups from SetSketch registers.

A set's sketch holds, for each of M independent exponential hashes, floor(1 - log_B(minimum)) cut to
0..Q + 1. Minima merge by taking the larger register, and registers of similar sets agree often.

1. Documents with equal shingle sets become one class, whose least id stands for it.
2. Bands of four registers are the keys of a keyed exchange; every document learns the least document of
   each of its bands, and is linked to that one alone: never all pairs of a band.
3. Each such pair is estimated by maximum likelihood over all registers jointly, given the exact set
   sizes. An estimate SLACK below the threshold is about five standard deviations away; the rest are
   verified on their full sets.
4. Connected components. Bands whose members are still in different components are then opened. For their members
   the sketch is continued from M to WIDE registers: the M whole ones, and one byte of each further one. Inside a
   task, members of different components are estimated against each other by these, and only the pairs that may be
   links leave it, in the first of the bands they share, which the whole registers tell. So no link is lost for not
   being to the least document, and the pairs of a group of near copies are never written out. A member of a band's
   most common component travels once for the band.

Two texts at the threshold share no band with a probability of 6e-9 (50 bands of 4 registers).
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.components import components
from tidemark.llm.exchange import Keys, ask, blocks_of, buckets, unpack
from tidemark.llm.runtime import checkpoint_ready, cut, drop_held, shuffle_partitions, trim
from tidemark.llm.textops import BYTE_CODE, LOWER, U, gram_hashes, mix, slices, text_bytes, word_hashes, words

M, WIDE, BAND, BASE, Q = 200, 1000, 4, 1.001, 65534
SLACK = 0.15
WIDE_SLACK = 0.07  # the estimate from WIDE registers has a standard deviation of 0.0137 at the threshold
TILE = 4096
_R = np.random.default_rng(77)
MUL_1 = _R.integers(0, 2**31, WIDE, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
MUL_2 = _R.integers(0, 2**31, WIDE, dtype=np.uint32) * np.uint32(2) + np.uint32(1)


def shingle_sets(column, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of every row in a row, and the offset of each row.

    A-Z are lower-cased. A text with fewer words than a shingle has one shingle, the whole of it; a text
    without words, or null, has none.
    """
    raw, offsets = text_bytes(column)
    sets, counts = [], []
    for a, b in slices(offsets):
        lo, hi = offsets[a], offsets[b]
        part = LOWER[raw[lo:hi]]
        ws, we, row = words(part, offsets[a : b + 1] - lo)
        h = word_hashes(part, ws, we)
        n = np.bincount(row, minlength=b - a)
        g = gram_hashes(h, size)
        same = row[size - 1 :] == row[: len(row) - size + 1] if len(row) >= size else np.zeros(0, bool)
        keys, rows = [g[same]], [row[: len(same)][same]]
        first = np.cumsum(n) - n
        for k in range(1, size):  # whole short texts
            i = np.flatnonzero(n == k)
            if len(i):
                x = h[first[i]]
                for j in range(1, k):
                    x = mix(x * U(0x9E3779B97F4A7C15) + h[first[i] + j])
                keys.append(mix(x + U(k)))
                rows.append(i)
        k, r = np.concatenate(keys), np.concatenate(rows)
        order = np.lexsort((k, r))
        k, r = k[order], r[order]
        new = np.ones(len(k), bool)
        new[1:] = (k[1:] != k[:-1]) | (r[1:] != r[:-1])
        sets.append(k[new])
        counts.append(np.bincount(r[new], minlength=b - a))
    flat = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
    return flat, np.concatenate(([0], np.cumsum(np.concatenate(counts) if counts else np.zeros(0, np.int64)))).astype(np.int64)


def minima(flat: np.ndarray, offsets: np.ndarray, mul_1: np.ndarray, mul_2: np.ndarray) -> np.ndarray:
    """Of every set, the least value of each of the 32-bit hashes; the largest value for empty sets."""
    least = np.full((len(offsets) - 1, len(mul_1)), np.uint32(0xFFFFFFFF))
    x1, x2 = (flat >> U(32)).astype(np.uint32), flat.astype(np.uint32)
    step = max(256, 400_000 // len(mul_1))
    for i in np.flatnonzero(np.diff(offsets)):
        for a in range(offsets[i], offsets[i + 1], step):
            b = min(a + step, offsets[i + 1])
            h = mul_1[:, None] * x1[None, a:b]
            h += mul_2[:, None] * x2[None, a:b]
            np.minimum(least[i], h.min(axis=1), out=least[i])
    return least


def registers(flat: np.ndarray, offsets: np.ndarray, m: int = M) -> np.ndarray:
    """A row of the first m registers for every set: exponential minima on a grid of powers of BASE."""
    e = -np.log1p(-(minima(flat, offsets, MUL_1[:m], MUL_2[:m]) + 0.5) / 2.0**32)
    return np.clip(np.floor(1 - np.log(e) / np.log(BASE)) + Q / 2, 0, Q + 1).astype(np.uint16)


def band_keys(regs: np.ndarray) -> np.ndarray:
    """A 64-bit key for every band of every row; the band's number is part of it."""
    bands = regs.reshape(len(regs), M // BAND, BAND).astype(np.uint64)
    k = np.arange(M // BAND, dtype=np.uint64)[None, :] * U(0x9E3779B97F4A7C15)
    for j in range(BAND):
        k = mix(k ^ bands[:, :, j]) + U(j + 1)
    return k


def estimate(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """Joint maximum-likelihood Jaccard similarity of pairs of register rows with known set sizes.

    With u and v the shares of the two sizes, a register of the first is larger with probability
    p(u - vJ), smaller with p(v - uJ), where p(x) = -log_B(1 - x (B - 1) / B); J is found by bisection of the
    derivative of the likelihood of the three counts.
    """
    more, less = (a > b).sum(1).astype(float), (a < b).sum(1).astype(float)
    same = a.shape[1] - more - less
    u = n_a / (n_a + n_b)
    v = 1 - u
    c, log_b = (BASE - 1) / BASE, np.log(BASE)

    def slope(j):
        x, y = np.maximum(u - v * j, 1e-12), np.maximum(v - u * j, 1e-12)
        p, q = -np.log1p(-x * c) / log_b, -np.log1p(-y * c) / log_b
        dp, dq = -v * c / (1 - x * c) / log_b, -u * c / (1 - y * c) / log_b
        return more * dp / p + less * dq / q - same * (dp + dq) / np.maximum(1 - p - q, 1e-12)

    lo, hi = np.zeros(len(u)), np.minimum(u / v, v / u)
    for _ in range(30):
        j = (lo + hi) / 2
        up = slope(j) > 0
        lo, hi = np.where(up, j, lo), np.where(up, hi, j)
    return (lo + hi) / 2


def sketch(docs: DataFrame, id_col: str, text_col: str, size: int) -> DataFrame:
    """(id, n_shingles, set_1, set_2, regs) of every row; the two set hashes identify the set."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drop_held()
        for batch in batches:
            for a in range(0, batch.num_rows, 1000):
                b = batch.slice(a, 1000)
                flat, at = shingle_sets(b.column(1), size)
                n = np.diff(at)
                total = lambda x: np.diff(np.append(0, np.cumsum(x, dtype=np.uint64))[at])  # noqa: E731, B023
                one, two = total(mix(flat)), total(mix(flat ^ U(0x5DEECE66D)))
                regs = registers(flat, at)
                yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), pa.array(n, pa.int64()), pa.array(one.view(np.int64)), pa.array(two.view(np.int64)), pa.array([r.tobytes() if k else b"" for r, k in zip(regs, n, strict=True)], pa.binary())], names=["id", "n_shingles", "set_1", "set_2", "regs"])

    return docs.select(id_col, text_col).mapInArrow(run, "id long, n_shingles long, set_1 long, set_2 long, regs binary")


def _send(block: int, payload: bytes, got: dict, n: int) -> Iterator[pa.RecordBatch]:
    yield _bands(payload, n)[2].rows(block)


def _bands(payload: bytes, n: int) -> tuple[np.ndarray, np.ndarray, Keys, list]:
    t = unpack(payload)
    ids, regs = t.column("id").to_numpy(), t.column("regs").to_pylist()
    k = band_keys(np.frombuffer(b"".join(regs), np.uint16).reshape(len(ids), M))
    return ids, k, Keys(k.ravel(), n, least=np.repeat(ids, k.shape[1])), regs


def _star(found: DataFrame, n: int) -> DataFrame:
    """Distinct (a, b): every document with the least document of each of its bands, and the band's key where it is shared."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids, k, keys, _ = _bands(row["payload"], n)
                _, _, least = keys.replies(row["r1"])
                best = least[keys.of].reshape(k.shape)
                x = np.repeat(ids, k.shape[1]).reshape(k.shape)
                pairs = np.unique(np.stack([x[best < x], best[best < x]], 1), axis=0)
                yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

    return found.mapInArrow(run, "a long, b long")


def _open_bands(labels: DataFrame) -> DataFrame:
    """(key, band, id, label, n_shingles) of members of bands whose members have different labels."""

    def keyed(payload: bytes, n: int):
        t = unpack(payload)
        label, regs = t.column("component_id").to_numpy(), t.column("regs").to_pylist()
        k = band_keys(np.frombuffer(b"".join(regs), np.uint16).reshape(len(label), M))
        each = np.repeat(label, k.shape[1])
        return t, label, k, Keys(k.ravel(), n, least=each, most=each)

    def send(block: int, payload: bytes, got: dict, n: int) -> Iterator[pa.RecordBatch]:
        yield keyed(payload, n)[3].rows(block)

    found = ask(blocks_of(labels), send)
    n = buckets(labels.sparkSession)

    def pick(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                t, label, k, keys = keyed(row["payload"], n)
                differ, _, _ = keys.replies(row["r1"])
                i, j = np.nonzero((differ | (keys.least != keys.most))[keys.of].reshape(k.shape))
                ids, size = t.column("id").to_numpy(), t.column("n_shingles").to_numpy()
                for a in range(0, len(i), 5000):
                    x, y = i[a : a + 5000], j[a : a + 5000]
                    yield pa.RecordBatch.from_arrays([pa.array(k[x, y].view(np.int64)), pa.array(y, pa.int32()), pa.array(ids[x]), pa.array(label[x]), pa.array(size[x])], names=["key", "band", "id", "label", "n_shingles"])

    return found.mapInArrow(pick, "key long, band int, id long, label long, n_shingles long")


WIDE_BYTES = 2 * M + WIDE - M


def wide_rows(regs: np.ndarray) -> np.ndarray:
    """WIDE_BYTES of every row of WIDE registers: the first M whole, two bytes each, then the low byte of each further one."""
    return np.concatenate((np.ascontiguousarray(regs[:, :M]).view(np.uint8), (regs[:, M:] & 0xFF).astype(np.uint8)), 1)


def binary_rows(rows: np.ndarray) -> pa.Array:
    """A binary value of every row of bytes, without an object for each."""
    n, size = rows.shape
    offsets = np.arange(n + 1, dtype=np.int32) * np.int32(size)
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(rows))])


def row_bytes(column: pa.ChunkedArray, size: int) -> np.ndarray:
    """The other way round, for values of one size."""
    parts = []
    for c in column.chunks:
        at = int(np.frombuffer(c.buffers()[1], np.int32)[c.offset]) if len(c) else 0
        parts.append(np.frombuffer(c.buffers()[2], np.uint8)[at : at + len(c) * size] if len(c) else np.zeros(0, np.uint8))
    return (parts[0] if len(parts) == 1 else np.concatenate(parts) if parts else np.zeros(0, np.uint8)).reshape(len(column), size)


def _widened(dealt: DataFrame, labels: DataFrame, docs: DataFrame, id_col: str, text_col: str, size: int) -> DataFrame:
    """dealt with `wide`, as wide_rows has it, and `whole`; false for rows that share an id, which have the M known registers alone."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 1000):
                b = batch.slice(a, 1000)
                wide = binary_rows(wide_rows(registers(*shingle_sets(b.column(1), size), WIDE)))
                yield pa.RecordBatch.from_arrays([b.column(0), wide], names=["id", "wide"])
        trim()

    def known(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                regs = b.column("regs").to_pylist()
                k = band_keys(np.frombuffer(b"".join(regs), np.uint16).reshape(b.num_rows, M))
                i = np.repeat(np.arange(b.num_rows), k.shape[1])
                yield pa.RecordBatch.from_arrays([pa.array(k.view(np.int64).ravel()), b.column("id").take(pa.array(i)), pa.array([regs[x].ljust(WIDE_BYTES, b"\0") for x in i], pa.binary())], names=["key", "id", "wide"])

    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    wide = texts.join(dealt.select("id").distinct(), "id", "left_semi").mapInArrow(run, "id long, wide binary")
    wide = cut(wide.groupBy("id").agg(F.when(F.count("*") == 1, F.first("wide")).alias("wide")))
    out = dealt.join(wide.where("wide is not null"), "id").withColumn("whole", F.lit(True))
    shared = wide.where("wide is null").select("id")
    if not shared.isEmpty():
        rows = labels.join(shared, "id").select("id", "regs").mapInArrow(known, "key long, id long, wide binary")
        out = out.unionByName(dealt.join(rows, ["key", "id"]).withColumn("whole", F.lit(False)))
    return out


def _dealt(members: DataFrame) -> DataFrame:
    """members with (tile, guest, own): a band of over TILE members is dealt to tiles.

    Members of the band's most common component are hosts, and go to one tile each. The others are guests of
    every tile of the band, as they may be linked with any member; two guests are compared in the tile of the lesser.
    So copies grow with the members outside of that component alone.
    """
    each = members.groupBy("key", "label").agg(F.count("*").alias("n"))
    big = each.groupBy("key").agg(F.sum("n").alias("n"), F.max(F.struct("n", "label")).getField("label").alias("host")).where(F.col("n") > TILE)
    tiles = F.ceil(F.coalesce("n", F.lit(1)) / TILE).cast("int")
    known = members.join(big, "key", "left").withColumn("own", F.pmod(F.xxhash64("id"), tiles).cast("int"))
    guest = F.coalesce(F.col("label") != F.col("host"), F.lit(True))
    known = known.withColumn("guest", guest).withColumn("tile", F.explode(F.when(F.col("guest"), F.sequence(F.lit(0), tiles - 1)).otherwise(F.array("own"))))
    return known.select("tile", "guest", "own", *members.columns)


def _across(dealt: DataFrame, similarity: float) -> DataFrame:
    """(a, b): pairs of members of one band, in different components, whose estimate does not rule them out."""
    sorted_ = dealt.repartition(shuffle_partitions(dealt.sparkSession), "key", "tile").sortWithinPartitions("key", "tile")

    def pairs(t: pa.Table) -> pa.RecordBatch:
        """Of whole groups, which are consecutive."""
        key, tile, own, band, ids, label, size = (t.column(c).to_numpy() for c in ("key", "tile", "own", "band", "id", "label", "n_shingles"))
        known, wide = t.column("whole").to_numpy(), row_bytes(t.column("wide"), WIDE_BYTES)
        few = np.ascontiguousarray(wide[:, : 2 * M]).view(np.uint16)
        low = np.concatenate(((few & 0xFF).astype(np.uint8), wide[:, 2 * M :]), 1)
        guest = t.column("guest").to_numpy()
        new = np.ones(len(ids), bool)
        new[1:] = (key[1:] != key[:-1]) | (tile[1:] != tile[:-1])
        at = np.append(np.flatnonzero(new), len(ids))
        out = []
        for a, b in zip(at[:-1], at[1:], strict=True):
            for i in np.flatnonzero(guest[a:b]) + a:
                j = np.concatenate((np.flatnonzero(~guest[a:b]) + a, np.flatnonzero(guest[a:b] & (ids[a:b] > ids[i])) + a if own[i] == tile[i] else []))
                j = j.astype(np.int64)
                j = j[(label[j] != label[i]) & (np.minimum(size[j], size[i]) >= similarity * np.maximum(size[j], size[i]))]
                if not len(j):
                    continue
                eq = few[j] == few[i]
                may = np.flatnonzero(eq.mean(1) >= similarity - SLACK - 0.05)
                first = eq[may].reshape(len(may), M // BAND, BAND).all(2).argmax(1)
                j = j[may[first == band[i]]]
                share = (low[j] == low[i]).mean(1)
                j = j[((share - 1 / 256) / (1 - 1 / 256) >= similarity - WIDE_SLACK) | ~known[j] | ~known[i]]
                out.append(np.stack([np.full(len(j), ids[i]), ids[j]], 1))
        got = np.concatenate(out) if out else np.zeros((0, 2), np.int64)
        return pa.RecordBatch.from_arrays([pa.array(got.max(1) if len(got) else got[:, 0]), pa.array(got.min(1) if len(got) else got[:, 1])], names=["a", "b"])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            t = pa.Table.from_batches([batch])
            t = t if held is None else pa.concat_tables([held, t])
            same = (t.column("key").to_numpy() == t.column("key")[-1].as_py()) & (t.column("tile").to_numpy() == t.column("tile")[-1].as_py())
            begin = int(np.flatnonzero(~same)[-1]) + 1 if not same.all() else 0
            if begin:
                yield pairs(t.slice(0, begin))
            held = t.slice(begin).combine_chunks()
        if held is not None and held.num_rows:
            yield pairs(held)
        trim()

    return sorted_.mapInArrow(run, "a long, b long").distinct()


def _with_ends(pairs: DataFrame, rows: DataFrame, columns: list[str]) -> DataFrame:
    """pairs (a, b) with columns of both ends, as <column>_a and <column>_b; rows is (id, columns).

    The document that many others are paired with would be a hot key. Its pairs are dealt to as many salts as there
    are partitions by a hash of the other end, and it gets a copy for each salt that occurs, never more than pairs.
    """
    salts = shuffle_partitions(pairs.sparkSession)
    salted = pairs.withColumn("salt", F.pmod(F.xxhash64("a"), F.lit(salts)).cast("int"))
    end = lambda e: rows.select(F.col("id").alias(e), *[F.col(c).alias(f"{c}_{e}") for c in columns])
    centres = salted.select("b", "salt").distinct().join(end("b"), "b")
    return salted.join(end("a"), "a").join(centres, ["b", "salt"]).drop("salt")


def _likely(pairs: DataFrame, sketches: DataFrame, similarity: float) -> DataFrame:
    """Pairs whose joint estimate does not rule them out."""
    both = _with_ends(pairs, sketches, ["n_shingles", "regs"])
    both = both.where(F.least("n_shingles_a", "n_shingles_b") >= similarity * F.greatest("n_shingles_a", "n_shingles_b"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                of = lambda c: np.frombuffer(b"".join(b.column(c).to_pylist()), np.uint16).reshape(b.num_rows, M)  # noqa: E731, B023
                j = estimate(of("regs_a"), of("regs_b"), b.column("n_shingles_a").to_numpy(), b.column("n_shingles_b").to_numpy())
                yield b.filter(pa.array(j >= similarity - SLACK)).select(["a", "b"])

    return both.select("a", "b", "n_shingles_a", "n_shingles_b", "regs_a", "regs_b").mapInArrow(run, "a long, b long")


def _verified(pairs: DataFrame, docs: DataFrame, id_col: str, text_col: str, size: int, percent: int) -> DataFrame:
    """Pairs with 100 * intersection >= percent * union on their full shingle sets."""
    both = _with_ends(pairs, docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")), ["text"])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in range(0, batch.num_rows, 500):
                b = batch.slice(s, 500)
                fa, ata = shingle_sets(b.column("text_a"), size)
                fb, atb = shingle_sets(b.column("text_b"), size)
                inter = np.array([len(np.intersect1d(fa[ata[i] : ata[i + 1]], fb[atb[i] : atb[i + 1]], assume_unique=True)) for i in range(b.num_rows)], np.int64)
                union = np.diff(ata) + np.diff(atb) - inter
                yield b.filter(pa.array((100 * inter >= percent * union) & (union > 0))).select(["a", "b"])
        trim()

    return both.select("a", "b", "text_a", "text_b").mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, percent: int = 75) -> DataFrame:
    """(id, n_shingles, component_id, kept) of every id of docs.

    Documents are linked where 100 * |A & B| >= percent * |A | B| on sets of `size`-word shingles; component_id
    is the least id reachable. An empty text, or null, has no shingles and no links. Rows with a null id are
    returned with n_shingles and are their own group (component_id null, kept true). Rows that repeat an id
    are returned as often as they occur; their links add up. Texts of any length count whole. Other columns are not
    read. An empty table gives an empty one.
    """
    spark = docs.sparkSession
    checkpoint_ready(spark)
    n = buckets(spark)
    base = cut(sketch(docs, id_col, text_col, size))
    real = base.where("id is not null and n_shingles > 0")
    classes = real.groupBy("set_1", "set_2", "n_shingles").agg(F.min("id").alias("rep"))
    member = real.select("id", "set_1", "set_2", "n_shingles").join(classes, ["set_1", "set_2", "n_shingles"]).select("id", "rep")
    member = cut(member)
    reps = cut(real.join(member.where("id = rep").select("id").distinct(), "id", "left_semi").select("id", "n_shingles", "regs"))
    blocks = blocks_of(reps)
    one = docs.where(F.col(id_col).isNotNull())
    star = _star(ask(blocks, _send, values=True), n).distinct()
    links = cut(_verified(_likely(star, reps, percent / 100), one, id_col, text_col, size, percent))
    same = member.where("id <> rep").select(F.col("id").alias("a"), F.col("rep").alias("b"))
    label = components(links, reps.select("id").distinct())
    members = cut(_open_bands(reps.join(label, "id")))
    more = cut(_across(_widened(_dealt(members), reps, one, id_col, text_col, size), percent / 100))
    if not more.isEmpty():
        extra = cut(_verified(more, one, id_col, text_col, size, percent))
        if not extra.isEmpty():
            label = components(links.union(extra), reps.select("id").distinct())
    joined = same.union(reps.select(F.col("id").alias("a"), F.col("id").alias("b")))
    of = joined.join(label.withColumnRenamed("id", "b"), "b").groupBy(F.col("a").alias("id")).agg(F.min("component_id").alias("component_id"))
    out = base.select("id", "n_shingles").join(of, "id", "left")
    found = F.coalesce("component_id", "id")
    return out.select("id", "n_shingles", found.alias("component_id"), F.coalesce(found == F.col("id"), F.lit(True)).alias("kept"))


def op10_query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return near_duplicates(docs).withColumnRenamed("id", "doc_id")


def op10_brute(rows: list[tuple[int, str | None]], size: int = 5, percent: int = 75) -> dict[int, tuple]:
    """The contract in plain loops, for tests."""
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(lower))
        sets[i] = {tuple(w[p : p + size]) for p in range(len(w) - size + 1)} or ({tuple(w)} if w else set())
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    holders: dict[tuple, list[int]] = {}
    for i in sorted(sets):
        near = {j for s in sets[i] for j in holders.get(s, ())}
        for j in near:
            x = len(sets[i] & sets[j])
            if 100 * x >= percent * (len(sets[i]) + len(sets[j]) - x):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
        for s in sets[i]:
            holders.setdefault(s, []).append(i)
    return {i: (len(sets[i]), find(i), find(i) == i) for i in sets}
