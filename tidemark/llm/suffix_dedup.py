"""Suffix dedup of byte windows: groups of suffixes refined pass by pass, as a depth-limited radix sort refines buckets.

Only whether two suffixes are equal through their first WINDOW bytes matters, not which comes first. So the digits of
the passes are hashes of parts of the window, and suffixes are grouped by them, never put in the order of their bytes.
Every pass drops the suffixes whose group has one document only. The last two passes hold windows equal whose 96-bit
hashes are; bytes are not compared.

1. first digit: the least-hashed GRAM bytes inside the window. It depends on the window alone, so equal
   windows share it, and neighbouring suffixes share one digit, which is sent once for all of them;
2. second digit: all bytes under the neighbouring suffixes that share a first digit. If this whole span
   occurs in a smaller document, every suffix of the span is settled at once;
3. last digit: the whole window, for the suffixes of spans that differ from other spans of their group.

A pass is one keyed exchange (see exchange.py): a hot digit is sent once by each block.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.exchange import Keys, ask, blocks_of, unpack
from tidemark.llm.textops import BASE_2, BYTE_CODE, BYTE_CODE_2, SpanHash, U, cover, gram_hashes, mix, runs, slices, sliding_min, text_bytes

GRAM = 20
NONE = np.iinfo(np.int64).min


class Suffixes:
    """First digits of all suffixes of one block that have a whole window, joined to spans of equal digits."""

    def __init__(self, table: pa.Table, id_col: str, text_col: str, window: int):
        self.raw, self.offsets = text_bytes(table.column(text_col))
        ids = table.column(id_col).cast(pa.int64()).combine_chunks()
        self.ids = np.where(ids.is_null().to_numpy(zero_copy_only=False), NONE, ids.fill_null(0).to_numpy(zero_copy_only=False)).astype(np.int64)
        self.window = window
        digit, first, last, row, self.grams = [], [], [], [], {}
        for a, b in slices(self.offsets):
            lo, hi = self.offsets[a], self.offsets[b]
            if hi - lo < window:
                continue
            h = gram_hashes(BYTE_CODE[self.raw[lo:hi]], min(GRAM, window))
            m = sliding_min(h, window - min(GRAM, window) + 1)
            at = np.repeat(np.arange(a, b), np.diff(self.offsets[a : b + 1]))[: len(m)]
            whole = self.offsets[at + 1] - lo >= np.arange(len(m)) + window
            s = np.flatnonzero(whole)
            if not len(s):
                continue
            d, r = m[s], at[s]
            new = np.ones(len(s), bool)
            new[1:] = (d[1:] != d[:-1]) | (r[1:] != r[:-1])
            i = np.flatnonzero(new)
            digit.append(d[i])
            row.append(r[i])
            first.append(s[i] + lo)
            last.append(s[np.append(i[1:], len(s)) - 1] + lo)
        cat = lambda x, d=np.int64: np.concatenate(x) if x else np.zeros(0, d)
        self.digit, self.first, self.last, self.row = cat(digit, np.uint64), cat(first), cat(last), cat(row)
        self.doc = self.ids[self.row]

    def pick(self, keep: np.ndarray) -> None:
        for k in ("digit", "first", "last", "row", "doc"):
            setattr(self, k, getattr(self, k)[keep])

    def spans(self) -> tuple[np.ndarray, np.ndarray]:
        return self._hashes(self.first, self.last + self.window)

    def windows(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Start, span and 96-bit hash of every window of the given spans."""
        n = self.last[which] - self.first[which] + 1
        span = np.repeat(which, n)
        start = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + self.first[span]
        return (start, span, *self._hashes(start, start + self.window))

    def _hashes(self, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        k, low = np.empty(len(start), np.uint64), np.empty(len(start), np.uint32)
        for a, b in slices(self.offsets):
            lo, hi = self.offsets[a], self.offsets[b]
            i = slice(*np.searchsorted(start, [lo, hi]))
            if i.start < i.stop:
                piece = self.raw[lo:hi]
                k[i] = SpanHash(BYTE_CODE[piece]).of(start[i] - lo, end[i] - lo)
                low[i] = (SpanHash(BYTE_CODE_2[piece], BASE_2).of(start[i] - lo, end[i] - lo) >> U(32)).astype(np.uint32)
        return k, low


class Block:
    """What the passes know about one block, recomputed from its texts and the replies so far."""

    def __init__(self, payload: bytes, got: dict, n: int, id_col: str, text_col: str, window: int):
        self.table = unpack(payload)
        self.s = s = Suffixes(self.table, id_col, text_col, window)
        self.starts, self.ends = [], []
        self.digits = Keys(s.digit, n, least=s.doc, most=s.doc)
        if "r1" not in got:
            return
        shared, _, _ = self.digits.replies(got["r1"])
        s.pick((shared | (self.digits.least != self.digits.most if len(self.digits.keys) else shared))[self.digits.of])
        self.k, self.low = s.spans()
        self.span = Keys(self.k, n, self.low, least=s.doc)
        code = (self.k >> U(1)).astype(np.int64)
        self.group = Keys(s.digit, n, least=code, most=code)
        if "r2" not in got:
            return
        _, less, _ = self.span.replies(got["r2"], 0)
        differ, _, _ = self.group.replies(got["r2"], 1)
        if len(self.group.keys):
            differ = differ | (self.group.least != self.group.most)
        settled = less[self.span.of] | (s.doc > self.span.least[self.span.of]) if len(s.doc) else np.zeros(0, bool)
        self._add(s.first[settled], s.last[settled])
        open_ = np.flatnonzero(~settled & differ[self.group.of]) if len(s.doc) else np.zeros(0, np.int64)
        self.start, of, k, low = s.windows(open_)
        self.doc = s.doc[of]
        self.last = Keys(k, n, low, least=self.doc)
        if "r3" not in got or not len(self.start):
            return
        _, less, _ = self.last.replies(got["r3"])
        hit = less[self.last.of] | (self.doc > self.last.least[self.last.of])
        self._add(self.start[hit], self.start[hit])

    def _add(self, first: np.ndarray, last: np.ndarray) -> None:
        self.starts.append(first)
        self.ends.append(last + self.s.window)

    def removed(self) -> np.ndarray:
        s, e = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (self.starts, self.ends))
        return cover(s, e, len(self.s.raw))


def find_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 50, block_bytes: int = 4 << 20) -> DataFrame:
    """Blocks of docs with all replies: what remove_repeats reads.

    A null text is empty; a null id counts as smaller than any other; rows that share an id never match each
    other. Texts shorter than the window keep all their bytes. Any other columns pass through unchanged.
    """
    out = blocks_of(docs, block_bytes)

    def send(level: int):
        def run(block: int, payload: bytes, got: dict, n: int) -> Iterator[pa.RecordBatch]:
            b = Block(payload, got, n, id_col, text_col, window)
            if level == 1:
                b.digits.least = b.digits.most = None
                yield b.digits.rows(block)
            elif level == 2:
                yield b.span.rows(block, 0)
                yield b.group.rows(block, 1)
            else:
                yield b.last.rows(block)

        return run

    for level in (1, 2, 3):
        out = ask(out, send(level), name=f"r{level}")
    return out


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 50, block_bytes: int = 4 << 20, kept_text: bool = False) -> DataFrame:
    """Every row of docs, its text replaced by kept_bytes, with n_bytes, n_removed, n_spans and removed_spans.

    A byte goes if a string of `window` bytes over it also starts in a document with a smaller id.
    removed_spans are the maximal removed runs as [start, end) byte offsets of the input text.
    With kept_text, whole_characters of the two is added as a column; it is '' for a null text. An input column that is
    called as one of these gives way to it. Texts of any length count whole; an empty table gives an empty one.
    """
    spark = docs.sparkSession
    docs = docs.drop("kept_bytes", "n_bytes", "n_removed", "n_spans", "removed_spans", *["kept_text"] * kept_text)
    from tidemark.llm.exchange import buckets

    n = buckets(spark)
    found = find_repeats(docs, id_col, text_col, window, block_bytes)
    rest = [f for f in docs.schema.fields if f.name != text_col]
    schema = T.StructType([*rest, T.StructField("kept_bytes", T.BinaryType()), *(T.StructField(c, T.LongType()) for c in ("n_bytes", "n_removed", "n_spans")), T.StructField("removed_spans", T.ArrayType(T.ArrayType(T.LongType()))), *[T.StructField("kept_text", T.StringType())] * kept_text])

    def cut_out(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                b = Block(row.pop("payload"), row, n, id_col, text_col, window)
                gone, at, raw = b.removed(), b.s.offsets, b.s.raw
                kept, n_removed, spans = [], [], []
                for i in range(len(at) - 1):
                    g = gone[at[i] : at[i + 1]]
                    s, e = runs(g)
                    kept.append(raw[at[i] : at[i + 1]][~g].tobytes() if len(s) else raw[at[i] : at[i + 1]].tobytes())
                    n_removed.append(int((e - s).sum()))
                    spans.append(np.stack([s, e], 1).tolist())
                t = b.table.select([f.name for f in rest])
                for name, values, kind in (("kept_bytes", kept, pa.binary()), ("n_bytes", np.diff(at), pa.int64()), ("n_removed", n_removed, pa.int64()), ("n_spans", [len(x) for x in spans], pa.int64()), ("removed_spans", spans, pa.list_(pa.list_(pa.int64())))):
                    t = t.append_column(name, pa.array(values, kind))
                if kept_text:
                    t = t.append_column("kept_text", pa.array([whole_characters(k, s) for k, s in zip(kept, spans, strict=True)], pa.string()))
                yield from t.combine_chunks().to_batches(max_chunksize=2000)

    return found.mapInArrow(cut_out, schema)


def whole_characters(kept: bytes, spans: list[list[int]]) -> str:
    """kept_bytes as text, without what is left of characters that removed_spans cut in two."""
    parts, at, gone = [], 0, 0
    for start, end in spans:
        parts.append(kept[at : start - gone])
        at = start - gone
        gone += end - start
    return "".join(p.decode("utf-8", "ignore") for p in (*parts, kept[at:]))


def op1_query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return remove_repeats(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept_bytes", 256).alias("kept_sha256"))


def op1_brute(rows: list[tuple[int, str | None]], window: int = 50) -> dict[int, tuple]:
    """The contract in plain loops, for tests."""
    seen: dict[bytes, int] = {}
    out = {}
    data = {i: (t or "").encode() for i, t in rows}
    for i in sorted(data):
        for p in range(len(data[i]) - window + 1):
            seen.setdefault(data[i][p : p + window], i)
    for i, b in data.items():
        gone = bytearray(len(b))
        for p in range(len(b) - window + 1):
            if seen[b[p : p + window]] < i:
                gone[p : p + window] = b"\x01" * window
        spans = sum(1 for k in range(len(b)) if gone[k] and not (k and gone[k - 1]))
        out[i] = (len(b), sum(gone), spans, hashlib.sha256(bytes(c for c, g in zip(b, gone, strict=True) if not g)).hexdigest())
    return out
