"""Substring dedup of word windows by level-wise doubling.

A window of WINDOW words can repeat only if every shorter window inside it repeats. Level 1 counts short
windows (a quarter of the length); those that repeat are alone extended to twice that length, on both
sides; and windows of full length are compared only where the extensions inside them repeat too.

Level 1 need not count all starts: every full window elects the short window of least hash inside it, so
equal full windows elect equal short windows, and counting the elected ones is enough. Every level is one
keyed exchange; a block sends a repeated key once, so a passage that many documents share stays small.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.exchange import Keys, ask, blocks_of, buckets, unpack
from tidemark.llm.textops import BYTE_CODE_2, U, cover, gram_hashes, runs, slices, sliding_min, text_bytes, word_hashes, words

HIGH = U(0xFFFFFFFF00000000)


class Level:
    """The windows of one block that may still repeat, level by level."""

    def __init__(self, payload: bytes, got: dict, n: int, text_col: str, window: int):
        self.table = unpack(payload)
        self.raw, self.offsets = text_bytes(self.table.column(text_col))
        self.window = window
        quarter, half = -(-window // 4), 2 * -(-window // 4)
        parts = [self._slice(a, b, quarter, half, "r2" in got) for a, b in slices(self.offsets)]
        cat = lambda i, d=np.int64: np.concatenate([p[i] for p in parts]) if parts else np.zeros(0, d)
        self.ws, self.we, self.row = cat(0), cat(1), cat(2)
        key, right, left = cat(3, np.uint64), cat(4, np.uint64), cat(5, np.uint64)
        has_right, has_left = cat(6, bool), cat(7, bool)
        self.first = Keys(key, n)
        self.gone = np.zeros(len(self.ws), bool)
        if "r1" not in got:
            return
        live = self._again(self.first, got["r1"], 0)
        r, left_on = np.flatnonzero(live & has_right), np.flatnonzero(live & has_left)
        self.right, self.left = Keys(right[r], n), Keys(left[left_on], n)
        if "r2" not in got:
            return
        ok_right, ok_left = np.zeros(len(key), bool), np.zeros(len(key), bool)
        ok_right[r] = self._again(self.right, got["r2"], 0)
        ok_left[left_on] = self._again(self.left, got["r2"], 1)
        start, anchor, offset, full, low = cat(8), cat(9), cat(10), cat(11, np.uint64), cat(12, np.uint32)
        may = live[anchor] if len(anchor) else np.zeros(0, bool)
        may &= (offset > window - half) | ok_right[anchor]
        may &= (offset < half - quarter) | ok_left[anchor]
        i = np.flatnonzero(may)
        self.start = start[i]
        self.full = Keys(full[i], n, low[i])
        if "r3" in got and len(i):
            hit = self.start[self._again(self.full, got["r3"], 0)]
            self.gone = cover(hit, hit + window, len(self.ws))

    @staticmethod
    def _again(keys: Keys, got: list | None, kind: int) -> np.ndarray:
        """Of every entry: whether its key has another entry, here or elsewhere."""
        if not len(keys.keys):
            return np.zeros(0, bool)
        shared, _, _ = keys.replies(got, kind)
        return (shared | (keys.count > 1))[keys.of]

    def _slice(self, a: int, b: int, quarter: int, half: int, full: bool) -> tuple:
        """Words of rows a..b; elected short windows with their extensions; full windows with their elected one."""
        lo, hi = self.offsets[a], self.offsets[b]
        raw = self.raw[lo:hi]
        ws, we, row = words(raw, self.offsets[a : b + 1] - lo)
        done, w = getattr(self, "_words", 0), self.window
        taken = getattr(self, "_taken", 0)
        self._words = done + len(ws)
        e, u = np.zeros(0, np.int64), np.zeros(0, np.uint64)
        out = (ws + lo, we + lo, row + a)
        if len(ws) < w:
            return (*out, u, u, u, e.astype(bool), e.astype(bool), e, e, e, u, u.astype(np.uint32))
        h = word_hashes(raw, ws, we)
        short = gram_hashes(h, quarter)
        v = sliding_min((short & HIGH) | np.arange(len(short), dtype=np.uint64), w - quarter + 1)
        s = np.flatnonzero(row[w - 1 :] == row[: len(row) - w + 1])
        p = (v[s] & ~HIGH).astype(np.int64)
        at, anchor = np.unique(p, return_inverse=True)
        self._taken = taken + len(at)
        twice = gram_hashes(h, half)
        extra = half - quarter
        has_right = at + half <= len(h)
        has_right[has_right] = row[at[has_right] + half - 1] == row[at[has_right]]
        has_left = at >= extra
        has_left[has_left] = row[at[has_left] - extra] == row[at[has_left]]
        right, left = np.zeros(len(at), np.uint64), np.zeros(len(at), np.uint64)
        right[has_right], left[has_left] = twice[at[has_right]], twice[at[has_left] - extra]
        if full:
            long = gram_hashes(h, w)[s]
            low = (gram_hashes(word_hashes(raw, ws, we, BYTE_CODE_2), w)[s] >> U(32)).astype(np.uint32)
        else:
            long, low = np.zeros(len(s), np.uint64), np.zeros(len(s), np.uint32)
        return (*out, short[at], right, left, has_right, has_left, s + done, anchor + taken, p - s, long, low)

    def kept(self) -> tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray]:
        """Of every row: its kept words joined by a space; word counts, removed counts, and first words of rows."""
        rows = len(self.offsets) - 1
        keep = ~self.gone
        n_words = np.bincount(self.row, minlength=rows)
        n_kept = np.bincount(self.row[keep], minlength=rows)
        ws, we = self.ws[keep], self.we[keep]
        size = we - ws
        bytes_before = np.cumsum(size) - size
        source = np.arange(size.sum()) + np.repeat(ws - bytes_before, size)
        out = np.full(size.sum() + len(ws), 32, np.uint8)
        out[np.arange(size.sum()) + np.repeat(np.arange(len(ws)), size)] = self.raw[source]
        word_end = np.cumsum(size + 1)
        last = np.cumsum(n_kept)
        ends = np.where(n_kept > 0, np.append(word_end, 0)[last - 1], 0)
        starts = np.append(0, word_end)[last - n_kept]
        data = out.tobytes()
        texts = [data[a : b - 1] if k else b"" for a, b, k in zip(starts.tolist(), ends.tolist(), n_kept.tolist(), strict=True)]
        return texts, n_words, n_words - n_kept, np.cumsum(n_words) - n_words


def remove_repeated_windows(docs: DataFrame, text_col: str = "text", window: int = 35, block_bytes: int = 4 << 20) -> DataFrame:
    """Every row of docs, its text replaced by kept_text, with n_words, n_removed and removed_spans.

    A word goes if a window of `window` words over it has the same words as a window that starts anywhere
    else. removed_spans are [start, end) word positions. A null text has no words; texts shorter than the
    window lose nothing; repeated rows are documents of their own. Other columns pass through unchanged, but one that
    is called as one of these gives way to it. Texts of any length count whole; an empty table gives an empty one.
    """
    spark = docs.sparkSession
    docs = docs.drop("kept_text", "n_words", "n_removed", "removed_spans")
    n = buckets(spark)

    def send(level: int):
        def run(block: int, payload: bytes, got: dict, n: int) -> Iterator[pa.RecordBatch]:
            b = Level(payload, got, n, text_col, window)
            if level == 1:
                yield b.first.rows(block)
            elif level == 2:
                yield b.right.rows(block, 0)
                yield b.left.rows(block, 1)
            else:
                yield b.full.rows(block)

        return run

    found = blocks_of(docs, block_bytes)
    for level in (1, 2, 3):
        found = ask(found, send(level), name=f"r{level}")
    rest = [f for f in docs.schema.fields if f.name != text_col]
    schema = T.StructType([*rest, T.StructField("kept_text", T.StringType()), T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("removed_spans", T.ArrayType(T.ArrayType(T.LongType())))])

    def cut_out(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                b = Level(row.pop("payload"), row, n, text_col, window)
                texts, n_words, n_removed, first = b.kept()
                spans = [[]] * len(texts)
                for i in np.flatnonzero(n_removed):
                    spans[i] = np.stack(runs(b.gone[first[i] : first[i] + n_words[i]]), 1).tolist()
                t = b.table.select([f.name for f in rest])
                for name, values in (("kept_text", pa.array(texts, pa.binary()).cast(pa.string())), ("n_words", pa.array(n_words, pa.int64())), ("n_removed", pa.array(n_removed, pa.int64())), ("removed_spans", pa.array(spans, pa.list_(pa.list_(pa.int64()))))):
                    t = t.append_column(name, values)
                yield from t.combine_chunks().to_batches(max_chunksize=2000)

    return found.mapInArrow(cut_out, schema)


def op5_query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return remove_repeated_windows(docs).select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text"), 256).alias("kept_sha256"))


def op5_brute(rows: list[tuple[int, str | None]], window: int = 35) -> dict[int, tuple]:
    """The contract in plain loops, for tests."""
    data = {i: re.findall(r"[^\x20\x09-\x0D]+", t or "") for i, t in rows}
    count = Counter(tuple(w[p : p + window]) for w in data.values() for p in range(len(w) - window + 1))
    out = {}
    for i, w in data.items():
        gone = bytearray(len(w))
        for p in range(len(w) - window + 1):
            if count[tuple(w[p : p + window])] > 1:
                gone[p : p + window] = b"\x01" * window
        out[i] = (len(w), sum(gone), hashlib.sha256(" ".join(x for x, g in zip(w, gone, strict=True) if not g).encode()).hexdigest())
    return out
