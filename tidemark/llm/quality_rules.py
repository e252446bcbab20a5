"""Quality rules by tokeniser fertility.

Two public vocabularies measure every text: characters per token under each, the share of tokens that are
byte fall-backs, and the entropy of the text's tokens as a share of the largest possible. Text of the
language or script that a vocabulary knows gives much the same values from one document to the next;
symbol runs, tables and mixed encodings do not. The rejection bands follow the text's length; they are
quartile-based and learned for each language (for each script where lang is null) over all documents that pass
the base rules.
"""

from __future__ import annotations

import base64
import re
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.runtime import cut, held
from tidemark.llm.textops import BYTE_CODE, SpanHash, cover, gram_hashes, slices, text_bytes, word_hashes, words

SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True
KEPT_WORDS = 150_000
MEASURES = ("chars_per_piece", "chars_per_rank", "fallback_share", "entropy_share")
#: Band half-widths in robust standard deviations (quartile distance / 1.349).
BANDS = {"chars_per_piece": 3.5, "chars_per_rank": 2.5, "fallback_share": 8.0, "entropy_share": 2.2}
LEAST_FALLBACK = 0.03
PRIOR_ROWS = 50
SCRIPTS = {"latin": r"\p{IsLatin}", "cyrillic": r"\p{IsCyrillic}", "greek": r"\p{IsGreek}", "han": r"\p{IsHan}", "arabic": r"\p{IsArabic}"}


class Vocabularies:
    """Ids of a word under both vocabularies, remembered by word up to a bound."""

    def __init__(self, piece_path: str, rank_path: str):
        import public_tokenizers
        import sentencepiece
        import tiktoken

        self.piece = sentencepiece.SentencePieceProcessor(model_file=piece_path)
        with open(rank_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f)}
        self.rank = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.fallback = np.array([self.piece.is_byte(i) for i in range(self.piece.get_piece_size())])
        self.words: dict[bytes, tuple[bytes, int]] = {}

    def of(self, text: bytes) -> list[tuple[bytes, int]]:
        known, found = self.words, text.split()
        new = [w for w in set(found) if w not in known]
        if new:
            if len(known) + len(new) > KEPT_WORDS:
                known.clear()
                new = list(set(found))
            shown = [w.decode() for w in new]
            for w, ids, t in zip(new, self.piece.encode(shown, num_threads=1), shown, strict=True):
                known[w] = (np.array(ids, np.uint16).tobytes(), len(self.rank.encode_ordinary(" " + t)))
        return [known[w] for w in found]


def base_counts(raw: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """Counts of every row: words, their code points, symbols, repeated lines, words in repeated 3-word windows."""
    rows = len(offsets) - 1
    ws, we, row = words(raw, offsets)
    total = lambda flags: np.diff(np.concatenate(([0], np.cumsum(flags)))[offsets])
    inside = cover(ws, we, len(raw)) & ((raw & 0xC0) != 0x80)
    out = {"n_words": np.bincount(row, minlength=rows), "word_chars": total(inside), "n_symbols": total(SYMBOLS[raw])}

    breaks = np.flatnonzero(raw == 10)
    start = np.concatenate((offsets[:-1], breaks + 1))
    of = np.concatenate((np.arange(rows), np.searchsorted(offsets, breaks, "right") - 1))
    nxt = np.append(breaks, len(raw))[np.searchsorted(breaks, start)]
    end = np.minimum(np.maximum(nxt, start), offsets[of + 1])
    has = np.searchsorted(ws, np.maximum(end, start)) > np.searchsorted(ws, start)
    start, end, of = start[has], end[has], of[has]
    dup = np.zeros(rows, np.int64)
    if len(start):
        h = SpanHash(BYTE_CODE[raw]).of(start, end)
        order = np.lexsort((h, of))
        same = (h[order][1:] == h[order][:-1]) & (of[order][1:] == of[order][:-1])
        dup = np.bincount(of[order][1:][same], minlength=rows)
    out["n_dup_lines"] = dup

    again = np.zeros(rows, np.int64)
    if len(ws) >= 3:
        g = gram_hashes(word_hashes(raw, ws, we), 3)
        at = np.flatnonzero(row[2:] == row[:-2])
        order = np.lexsort((g[at], row[at]))
        k, r = g[at][order], row[at][order]
        same = np.zeros(len(k) + 1, bool)
        same[1:-1] = (k[1:] == k[:-1]) & (r[1:] == r[:-1])
        hit = at[order[same[1:] | same[:-1]]]
        again = np.bincount(row[cover(hit, hit + 3, len(ws))], minlength=rows)
    out["n_repeat_words"] = again
    return out


def measure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", piece_path: str | None = None, rank_path: str | None = None) -> DataFrame:
    """Every row of docs without its text, with the base counts and the measures of both vocabularies.

    A column that is called as one of these gives way to it. A null text is empty; texts of any length count whole.
    """
    import public_tokenizers

    docs = docs.drop("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", *MEASURES)

    paths = (piece_path or public_tokenizers.path("piece_bpe_32k.model"), rank_path or public_tokenizers.path("byte_bpe_50k.tiktoken"))
    rest = [c for c in docs.columns if c != text_col]
    counts = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = held(paths, lambda: Vocabularies(*paths))
        for batch in batches:
            _, at = text_bytes(batch.column(len(rest)))
            for a, b in slices(at):
                part = batch.slice(a, b - a)
                raw, offsets = text_bytes(part.column(len(rest)))
                got = base_counts(raw, offsets)
                data = raw.tobytes()
                ids, n_rank = [], []
                for x, y in zip(offsets[:-1], offsets[1:], strict=True):
                    found = v.of(data[x:y])
                    ids.append(np.frombuffer(b"".join([w[0] for w in found]), np.uint16))
                    n_rank.append(sum([w[1] for w in found]))
                n = np.array([len(i) for i in ids])
                fall = np.array([v.fallback[i].sum() for i in ids])
                entropy = np.zeros(len(n))
                for j, i in enumerate(ids):
                    if n[j] > 1:
                        p = np.unique(i, return_counts=True)[1] / n[j]
                        entropy[j] = -(p * np.log(p)).sum() / np.log(n[j])
                chars = got["word_chars"]
                out = [pa.array(got[c], pa.int64()) for c in counts]
                out += [pa.array(x, pa.float64()) for x in (chars / np.maximum(n, 1), chars / np.maximum(n_rank, 1), fall / np.maximum(n, 1), entropy)]
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in range(len(rest))), *out], names=[*rest, *counts, *MEASURES])

    fields = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for c in rest for f in [docs.schema[c]]] + [f"{c} long" for c in counts] + [f"{c} double" for c in MEASURES])
    return docs.select(*rest, text_col).mapInArrow(run, fields)


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def script(text: Column) -> Column:
    """The first script of the list that has most of the first letters' share; 'other' where none has any."""
    n = {k: F.length(text) - F.length(F.regexp_replace(text, p, "")) for k, p in SCRIPTS.items()}
    most = F.greatest(*n.values())
    out = F.lit("other")
    for k in reversed(n):
        out = F.when((n[k] == most) & (most > 0), k).otherwise(out)
    return out


def log_words() -> Column:
    return F.log2(F.greatest("n_words", F.lit(1)))


def octave() -> Column:
    """Length class: the measures of short texts scatter more, and entropy shares fall with length."""
    return F.floor(log_words()).cast("int")


def curves(good: DataFrame, group: str) -> DataFrame:
    """(group, octave, at, then mid_, slope_ of every measure): each length class's line of the measure over log2 of words.

    A line is fitted to the medians of all classes of the group, weighted by their rows, a quarter of that for every
    octave of distance, so a class of few rows follows its neighbours' slope. PRIOR_ROWS rows' worth of the slope
    of all groups together is added to a group's own.
    """
    q = [F.percentile_approx(m, 0.5, 2000).alias(m) for m in MEASURES]
    classes = good.groupBy(group, octave().alias("octave")).agg(F.count("*").alias("n"), F.avg(log_words()).alias("x"), *q)
    other = classes.select(group, F.col("octave").alias("of"), F.col("x").alias("at"))
    z = F.col("x") - F.col("at")
    w = F.col("n") * F.pow(F.lit(4.0), -F.abs(F.col("octave") - F.col("of")))
    sums = [F.sum(w).alias("w"), F.sum(w * z).alias("z"), F.sum(w * z * z).alias("zz")]
    sums += [F.sum(w * v).alias(f"{k}{m}") for m in MEASURES for k, v in (("y_", F.col(m)), ("zy_", z * F.col(m)))]
    near = classes.join(other, group).groupBy(group, "of", "at").agg(*sums)
    szz = F.col("zz") - F.col("z") * F.col("z") / F.col("w")
    szy = {m: F.col(f"zy_{m}") - F.col("z") * F.col(f"y_{m}") / F.col("w") for m in MEASURES}
    near = near.select("*", szz.alias("szz"), *[c.alias(f"szy_{m}") for m, c in szy.items()])
    pool = near.groupBy("of").agg(F.sum("w").alias("all"), F.sum("szz").alias("all_zz"), *[F.sum(f"szy_{m}").alias(f"all_{m}") for m in MEASURES])
    prior = F.lit(float(PRIOR_ROWS)) / F.col("all")
    spread = F.col("szz") + prior * F.col("all_zz")
    out = []
    for m in MEASURES:
        slope = F.when(spread > 1e-9, (F.col(f"szy_{m}") + prior * F.col(f"all_{m}")) / spread).otherwise(0.0)
        out += [((F.col(f"y_{m}") - slope * F.col("z")) / F.col("w")).alias(f"mid_{m}"), slope.alias(f"slope_{m}")]
    return near.join(F.broadcast(pool), "of").select(group, F.col("of").alias("octave"), "at", *out)


def residual(m: str) -> Column:
    return F.col(m) - F.col(f"mid_{m}") - F.col(f"slope_{m}") * (log_words() - F.col("at"))


def bands(measured: DataFrame, group: str) -> DataFrame:
    """The line and the scatter of every measure for each group and length class, and quartiles over the whole group.

    All rows that pass the base rules count, however few a class has. scale_ is the median distance to the line in
    a length class over all groups, smoothed by lines as in curves(); q_ are quartiles of (measure - line) / scale_ over all
    rows of the group.
    """
    good = measured.where(~base_failed())
    lines = curves(good, group)
    rest = good.withColumn("octave", octave()).join(lines, [group, "octave"])
    apart = rest.groupBy("octave").agg(F.count("*").alias("n"), *[F.percentile_approx(F.abs(residual(m)), 0.5, 2000).alias(m) for m in MEASURES])
    z = F.col("octave") - F.col("of")
    w = F.col("n") * F.pow(F.lit(4.0), -F.abs(z))
    both = apart.crossJoin(F.broadcast(apart.select(F.col("octave").alias("of")))).groupBy("of")
    fits = both.agg(F.sum(w).alias("w"), F.sum(w * z).alias("z"), F.sum(w * z * z).alias("zz"), *[F.sum(w * v).alias(f"{k}{m}") for m in MEASURES for k, v in (("y_", F.col(m)), ("zy_", z * F.col(m)))])
    spread, scales = F.col("zz") - F.col("z") * F.col("z") / F.col("w"), []
    for m in MEASURES:
        mean = F.col(f"y_{m}") / F.col("w")
        slope = F.when(spread > 1e-9, (F.col(f"zy_{m}") - F.col("z") * mean) / spread).otherwise(0.0)
        scales.append(F.greatest(mean - slope * F.col("z") / F.col("w"), mean / 2, F.lit(1e-12)).alias(f"scale_{m}"))
    scale = fits.select(F.col("of").alias("octave"), *scales)
    q = [F.percentile_approx(residual(m) / F.col(f"scale_{m}"), [0.25, 0.5, 0.75], 2000).alias(f"q_{m}") for m in MEASURES]
    whole = rest.join(F.broadcast(scale), "octave").groupBy(group).agg(*q)
    return lines.join(F.broadcast(scale), "octave").join(whole, group)


def verdict() -> Column:
    """True where no measure is out of its band; characters per token must be out on one side under both vocabularies."""

    def off(m: str, side: int, least: float = 1e-9) -> Column:
        q, scale = F.col(f"q_{m}"), F.col(f"scale_{m}")
        return side * (residual(m) - q[1] * scale) > F.greatest(BANDS[m] * (q[2] - q[0]) * scale / 1.349, F.lit(least))

    low = off("chars_per_piece", -1) & off("chars_per_rank", -1)
    high = off("chars_per_piece", 1) & off("chars_per_rank", 1)
    return F.coalesce(~(low | high | off("fallback_share", 1, LEAST_FALLBACK) | off("entropy_share", -1)), F.lit(True))


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", **paths: str) -> DataFrame:
    """(id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, measures, base_failed, kept) of every row.

    A null text has no words and fails the base rules. Rows with a null lang are held to the band of their
    script. A group in which no row passes the base rules has no band. Repeated rows count as often as they
    occur, in the quartiles too, and a measure at the end of its band is within it. Texts of any length are measured
    whole. Other columns, whatever their names, are not read. An empty table gives an empty one.
    """
    by = F.coalesce(F.col(lang_col).cast("string"), script(F.coalesce(F.col(text_col), F.lit("")))).alias("band_group")
    measured = cut(measure(docs.select(F.col(id_col).alias("id"), by, F.col(text_col).alias("text")), "id", "text", **paths))
    limits = bands(measured, "band_group")
    out = measured.withColumn("octave", octave()).join(limits, ["band_group", "octave"], "left").withColumn("base_failed", base_failed())
    return out.select("id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", *MEASURES, "base_failed", (~F.col("base_failed") & verdict()).alias("kept"))


def op2_query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    return judge(docs).withColumnRenamed("id", "doc_id")


def op2_brute(text: str | None) -> tuple[int, int, int, int, int, bool]:
    """The base counts in plain loops, for tests."""
    t = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    seen: set[str] = set()
    dup = 0
    for line in t.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    grams = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    again = {j for i in range(len(w) - 2) if grams[tuple(w[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(again), len(w) < 50 or 100 * len(again) > 50 * len(w)
