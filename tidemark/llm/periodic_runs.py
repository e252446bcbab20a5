"""Periodic runs of words, found by minimizers at many scales.

A run is a stretch of words with smallest period q, of at least two periods and `least` words, that no neighbouring
word extends keeping the period. Several texts are searched at once, as one sequence with a separator of its own
between any two, which equals nothing.

1. Periods below LAGS: the sequence is compared with itself at each lag.
2. Scale k = 8, 16, 32...: periods from 4k to 8k - 1. Position i is a minimizer if its k-gram has the least hash of any
   window of 3k k-grams that holds it; k-grams that are periodic themselves, with a period of at most k / 2, don't
   count. Inside a run the window one period later has the same words, so its minimum repeats at period distance.
   Pairs of equal minimizers at such a distance are seeds, which are extended both ways. Equal k-grams that aren't
   periodic are more than k / 2 apart, so that a minimizer has 16 partners at most.
3. A run without any such k-gram in its first period consists of a stretch with a short period and its copy, which
   abut: two runs that are known from smaller scales. Their phases tell all lags at which the one matches the other.

Every run is compared word by word before it is reported; hashes only say where to look.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import chain, compress

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.runtime import drop_held, smaller_batches
from tidemark.llm.textops import SpanHash, U, cover, gram_hashes, mix, slices, sliding_min, text_bytes

FIRST = 8  # k of the first scale
LAGS = 4 * FIRST
NEVER = U(0xFFFFFFFFFFFFFFFF)
Runs = tuple[np.ndarray, np.ndarray, np.ndarray]  # start, end, period


def scan(codes: np.ndarray, lag: int, least: int) -> Runs:
    """The maximal stretches of that period with at least two periods and `least` words."""
    i = np.flatnonzero(codes[lag:] == codes[:-lag])
    gap = np.flatnonzero(np.diff(i) != 1)
    begin, end = i[np.append(0, gap + 1)] if len(i) else i, i[np.append(gap, len(i) - 1)] + 1 if len(i) else i
    long = end - begin >= max(lag, least - lag)
    return begin[long], end[long] + lag, np.full(int(long.sum()), lag)


def joined(parts: list[Runs]) -> Runs:
    """All runs once, each with its smallest period: stretches of two periods that are equal differ by a factor."""
    start, end, period = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.lexsort((period, end, start))
    start, end, period = start[order], end[order], period[order]
    new = np.ones(len(start), bool)
    new[1:] = (start[1:] != start[:-1]) | (end[1:] != end[:-1])
    return start[new], end[new], period[new]


def minimizers(grams: np.ndarray, periodic: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Position and hash of every k-gram that is least in any window that holds it."""
    value = np.where(periodic, NEVER, mix(grams))
    low = sliding_min(value, window)
    pad = np.full(window - 1, NEVER)
    best = ~sliding_min(np.concatenate((pad, ~low, pad)), window)
    at = np.flatnonzero((value == best) & (value != NEVER))
    return at, value[at]


def pairs(at: np.ndarray, value: np.ndarray, least: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(position, distance) of any two of the same value whose distance is in [least, most)."""
    order = np.argsort(value, kind="stable")
    at, value = at[order], value[order]
    first, lag, i, step = [], [], np.arange(len(at)), 1
    while len(i):
        i = i[i + step < len(at)]
        d = at[i + step] - at[i]
        near = (value[i + step] == value[i]) & (d < most)
        i, d = i[near], d[near]
        first.append(at[i[d >= least]])
        lag.append(d[d >= least])
        step += 1
    return (np.concatenate(first), np.concatenate(lag)) if first else (at[:0], at[:0])


def abutting(spans: SpanHash, runs: Runs, least: int, most: int, longest: int) -> tuple[np.ndarray, np.ndarray]:
    """Seeds (position, lag) between two runs of one period, up to `longest`, that overlap or touch."""
    start, end, period = runs
    use = np.flatnonzero((period <= longest) & (end - start >= least))
    use = use[np.lexsort((start[use], period[use]))]
    a, b = use[:-1], use[1:]
    meet = (period[a] == period[b]) & (start[b] <= end[a])
    seeds = [(start[:0], start[:0])]
    for i, j in zip(a[meet], b[meet], strict=True):
        d = int(period[i])
        t = start[i] + np.arange(d)
        same = np.flatnonzero(spans.of(t, t + d) == spans.of(start[j : j + 1], start[j : j + 1] + d))
        if len(same):
            shift = int(start[j] - start[i] - same[0]) % d
            lags = np.arange(least + (shift - least) % d, min(most, end[i] - start[i] + 1, end[j] - start[j] + 1), d)
            seeds.append((np.maximum(start[i], start[j] - lags), lags))
    return np.concatenate([s[0] for s in seeds]), np.concatenate([s[1] for s in seeds])


def extended(codes: np.ndarray, spans: SpanHash, at: np.ndarray, lag: np.ndarray) -> Runs:
    """The maximal stretches around the seeds that have two periods; equal spans of words have equal hashes."""

    def reach(most: np.ndarray, same) -> np.ndarray:
        low, high = np.zeros_like(most), most
        while (low < high).any():
            half = (low + high + 1) // 2
            ok = same(half)
            low, high = np.where(ok, half, low), np.where(ok, high, half - 1)
        return low

    right = reach(len(codes) - at - lag, lambda x: spans.of(at, at + x) == spans.of(at + lag, at + lag + x))
    left = reach(at.copy(), lambda x: spans.of(at - x, at) == spans.of(at + lag - x, at + lag))
    start, end = at - left, at + lag + right
    found = np.unique(np.stack([start, end, lag], 1)[end - start >= 2 * lag], axis=0)
    kept = []
    for s, e, q in found.tolist():
        if np.array_equal(codes[s : e - q], codes[s + q : e]):
            kept.append((np.array([s]), np.array([e]), np.array([q])))
        else:  # two spans have one hash
            kept.append(scan(codes, q, 2 * q))
    return joined(kept) if kept else (at[:0], at[:0], at[:0])


def runs_of(codes: np.ndarray, lengths: np.ndarray, least: int) -> Runs:
    """All runs of a sequence of texts of these lengths, longest first, each with a separator after it."""
    floor = min(least, FIRST)
    runs = joined([scan(codes, q, floor) for q in range(1, LAGS)])
    ends, words, k, spans = np.cumsum(lengths + 1), mix(codes.astype(np.uint64)), FIRST, None
    while texts := int(np.searchsorted(-lengths, -8 * k, "right")):
        n = int(ends[texts - 1])
        spans = spans or SpanHash(words[:n])
        start, end, period = runs
        inner = (period <= k // 2) & (end - start >= k) & (end <= n)
        at, value = minimizers(gram_hashes(words[:n], k), cover(start[inner], end[inner] - k + 1, n - k + 1), 3 * k)
        seeds = [pairs(at, value, 4 * k, 8 * k), abutting(spans, tuple(x[end <= n] for x in runs), 4 * k, 8 * k, k // 2)]
        at, lag = (np.concatenate(x) for x in zip(*seeds, strict=True))
        runs = joined([runs, extended(codes[:n], spans, at, lag)])
        k *= 2
    long = runs[1] - runs[0] >= least
    return tuple(x[long] for x in runs)


RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def texts_with_runs(texts: list[bytes], least: int) -> tuple[np.ndarray, list[list[dict]], list[bytes]]:
    """Of every text: number of words, its runs by start, and its words without those after a run's first period."""
    split = [t.split() for t in texts]
    number = {w: i for i, w in enumerate(dict.fromkeys(chain.from_iterable(split)))}
    lengths = np.fromiter(map(len, split), np.int64, len(split))
    order = np.argsort(-lengths, kind="stable")
    by_length = lengths[order]
    ends = np.cumsum(by_length + 1)
    codes = np.full(len(split) + int(lengths.sum()), 0, np.int64)
    codes[ends - 1] = -1 - np.arange(len(split))
    codes[codes == 0] = np.fromiter(map(number.__getitem__, chain.from_iterable(split[i] for i in order)), np.int64, int(lengths.sum()))
    start, end, period = runs_of(codes, by_length, least)
    place = np.searchsorted(ends, start, "right")
    found: list[list[dict]] = [[] for _ in split]
    left = [b" ".join(w) for w in split]
    for p in np.unique(place):
        own, base, row = place == p, ends[p] - by_length[p] - 1, int(order[p])
        s, e, q = start[own] - base, end[own] - base, period[own]
        found[row] = [{"start": int(a), "length": int(b - a), "period": int(c)} for a, b, c in zip(s, e, q, strict=True)]
        left[row] = b" ".join(compress(split[row], (~cover(s + q, e, len(split[row]))).tolist()))
    return lengths, found, left


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 12) -> DataFrame:
    """(id, n_words, runs, collapsed) of every row of docs, in any order.

    Words are maximal stretches without space and 0x09-0x0D. runs: array of (start, length, period), start counted in
    words from 0, by start and period. collapsed: the words left, joined by one space, when of every run only the first
    period stays. A null text has no words, no runs and an empty `collapsed`, and so has an empty one. Texts of any
    length are searched whole. Rows that repeat, or share an id, are returned as often as they occur; a null id stays
    null. Other columns are not read. An empty table gives an empty one.
    """
    smaller_batches(docs.sparkSession)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drop_held()
        for batch in batches:
            _, at = text_bytes(batch.column(1))
            for a, b in slices(at):
                part = batch.slice(a, b - a)
                texts = [t or b"" for t in part.column(1).cast(pa.binary()).to_pylist()]
                n, found, left = texts_with_runs(texts, least)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n), pa.array(found, pa.list_(RUN)), pa.array(left, pa.binary()).cast(pa.string())], names=["id", "n_words", "runs", "collapsed"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"id {kind}, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string")


def planted(text: Column, doc_id: Column) -> Column:
    """The text as the query's contract changes it: of one id in ten, the words from a on repeat with a period p."""
    h = F.crc32(doc_id.cast("string").cast("binary"))
    g = F.floor(h / 10)

    def repeat(words: Column) -> Column:
        n = F.size(words).cast("long")
        a = g % n
        p = 1 + F.floor((n - a) / (3 + g % 8))
        at = lambda i: F.when(i < a, i).otherwise(a + (i - a) % p)
        return F.array_join(F.transform(F.sequence(F.lit(0).cast("long"), n - 1), lambda i: F.get(words, at(i).cast("int"))), " ")

    words = F.filter(F.split(text, "[ \\t-\\r]+"), lambda w: w != "")
    changed = F.transform(F.array(words), lambda w: F.when(F.size(w) > 0, repeat(w)).otherwise(F.lit("")))
    return F.when((h % 10 == 0) & text.isNotNull(), F.get(changed, F.lit(0))).otherwise(text)


def op11_query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", planted(F.col("text"), F.col("doc_id")).alias("text"))
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("before"), (-r["period"]).alias("less"))))
    line = lambda r: F.concat_ws(",", *[r[c].cast("string") for c in ("start", "length", "period")], F.lit(""))
    lines = F.array_join(F.transform("runs", lambda r: F.regexp_replace(line(r), ",$", "\n")), "")
    out = periodic_runs(docs).withColumn("best", best)
    length, period = F.col("best.length"), -F.col("best.less")
    return out.select(
        F.col("id").alias("doc_id"),
        F.size("runs").cast("long").alias("n_runs"),
        (-F.col("best.before")).alias("start"),
        length.alias("length"),
        period.alias("period"),
        F.floor(1000 * length / period).alias("exponent_milli"),
        F.sha2(lines.cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )


def op11_brute(doc_id: int | None, text: str | None) -> tuple:
    """The contract in plain loops, for tests."""
    import hashlib
    import re
    import zlib

    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n, h = len(w), zlib.crc32(str(doc_id).encode())
    g = h // 10
    if doc_id is not None and h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [x if i < a else w[a + (i - a) % p] for i, x in enumerate(w)]
    found = {}
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            if j - i >= q and j + q - i >= 12:
                found.setdefault((i, j + q), q)
            i = j + 1
    runs = sorted((s, e - s, q) for (s, e), q in found.items())
    gone = {i for s, m, q in runs for i in range(s + q, s + m)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else None
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    told = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return (len(runs), *told, sha("".join(f"{s},{m},{q}\n" for s, m, q in runs)), sha(" ".join(x for i, x in enumerate(w) if i not in gone)))
