"""License scans: winnowed template fingerprints in an inverted index, then banded alignment.

The index maps the winnowed k-gram hashes of all templates to (template, word). Every k-gram of a text is
looked up in it, so any K + WINDOW - 1 words in a row that a text shares with a template are met. A notice that
has the asked share of its template's words may have others changed or left out: where so many changes could
break every winnowed k-gram, the index also takes one more disjoint k-gram than there may be changes, so one of
them is whole. (A word put between two words breaks a k-gram too, but counts as no change.) A hit makes a candidate region around its diagonal, which a banded
alignment of words then confirms: it reports the words matched, the share of the template that they cover,
and the span of the text.

The templates are a small table whose size is checked: MOST_TEMPLATE_WORDS words in all.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

K, WINDOW, BAND = 3, 3, 6
COVERAGE = 0.8
MOST_TEMPLATE_WORDS = 1_000_000

# fixed values: notices as their owners word them
TEMPLATES = {
    "all-rights-reserved": "All rights reserved.",
    "apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0-header": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "bsd-conditions": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "cc-by-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0.",
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "mit": "Released under the MIT License.",
    "mit-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
}

_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_MASK = (1 << 61) - 1


def terms(text: str) -> tuple[list[str], list[tuple[int, int]]]:
    """Lower-cased words without the punctuation around them, and their spans; words of punctuation alone drop out."""
    out, spans = [], []
    for m in _WORD.finditer(text):
        w = m.group().strip(".,;:!?()[]{}\"'*#/|<>&$%-").lower()
        if w:
            out.append(w)
            spans.append(m.span())
    return out, spans


@lru_cache(100_000)
def _code(word: str) -> int:
    h = 1469598103934665603
    for c in word.encode():
        h = (h ^ c) * 1099511628211 & 0xFFFFFFFFFFFFFFFF
    return h & _MASK


def grams(codes: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k words from each word on."""
    n = max(0, len(codes) - k + 1)
    g = np.full(n, k, np.uint64)
    for j in range(k):
        g = g * np.uint64(0x9E3779B97F4A7C15) + codes[j : j + n]
    return g ^ (g >> np.uint64(29))


def winnow(words: list[str]) -> list[tuple[int, int]]:
    """(hash, word) of the least k-gram of every window of k-grams, the rightmost of equals; one for short texts."""
    if not words:
        return []
    g = grams(np.array([_code(w) for w in words], np.uint64), min(K, len(words)))
    n = len(g)
    w = min(WINDOW, n)
    wins = np.lib.stride_tricks.sliding_window_view(g, w)
    at = np.arange(n - w + 1) + (w - 1 - wins[:, ::-1].argmin(1))
    at = np.unique(at)
    return list(zip(g[at].tolist(), at.tolist(), strict=True))


def breaking(places: list[int], k: int) -> int:
    """The fewest changed words that break all k-grams at these places."""
    n, last = 0, -1
    for i in sorted(places):
        if i > last:
            n, last = n + 1, i + k - 1
    return n


class Index:
    """Inverted index of the templates' fingerprints, by length of the k-gram."""

    def __init__(self, templates: dict[str, str], least: float = COVERAGE):
        self.words = {k: terms(t)[0] for k, t in templates.items()}
        if sum(map(len, self.words.values())) > MOST_TEMPLATE_WORDS:
            raise ValueError(f"templates of over {MOST_TEMPLATE_WORDS} words in all are not for a broadcast index")
        self.at: dict[int, dict[int, list[tuple[str, int]]]] = {}
        for name, words in self.words.items():
            n = len(words)
            if not n:
                continue
            k = min(K, n)
            marks = {(k, i): h for h, i in winnow(words)}
            changes = max((e for e in range(n) if n - e >= least * n), default=0)
            if breaking([i for _, i in marks], k) <= changes:
                k = max(1, min(K, n // (changes + 1)))
                g = grams(np.array([_code(w) for w in words], np.uint64), k)
                marks |= {(k, i): int(g[i]) for i in (j * (n - k) // max(1, changes) for j in range(changes + 1))}
            for (k, i), h in marks.items():
                self.at.setdefault(k, {}).setdefault(h, []).append((name, i))
        self.hashes = {k: np.array(sorted(v), np.uint64) for k, v in self.at.items()}

    def scan(self, text: str, least: float) -> list[tuple[str, int, int, float, int, int]]:
        """(template, matched words, template words, coverage, first character, end) of every region found."""
        words, spans = terms(text)
        hits: dict[str, list[tuple[int, int]]] = {}
        if not words:
            return []
        c = np.array([_code(w) for w in words], np.uint64)
        for k, known in self.hashes.items():
            g = grams(c, k)
            for i in np.flatnonzero(np.isin(g, known)):
                for name, j in self.at[k][int(g[i])]:
                    hits.setdefault(name, []).append((int(i), j))
        out = []
        for name, pairs in hits.items():
            t = self.words[name]
            end = 0
            for i, j in sorted(pairs, key=lambda p: (p[0] - p[1], p[0])):
                if i < end:
                    continue
                a = max(0, i - j - BAND, end)
                b = min(len(words), i - j + len(t) + BAND)
                matched, first, last = align(t, words[a:b], i - j - a)
                if matched >= least * len(t):
                    end = a + last + 1
                    out.append((name, matched, len(t), matched / len(t), spans[a + first][0], spans[a + last][1]))
        return sorted(set(out), key=lambda r: (r[4], r[0]))


def align(template: list[str], words: list[str], shift: int) -> tuple[int, int, int]:
    """Most words matched in order within BAND words of the diagonal, and the first and last word matched.

    Of equal matches the shortest stretch counts, and of those the first.
    """
    n = len(words)
    best: dict[int, tuple[int, int]] = {}  # last word matched -> (matched, first word matched)
    for i, w in enumerate(template):
        new = dict(best)
        for j in range(max(0, i + shift - BAND), min(n, i + shift + BAND + 1)):
            if words[j] == w:
                before = max((v for e, v in best.items() if e < j), default=(0, j))
                new[j] = max(new.get(j, (0, 0)), (before[0] + 1, before[1] if before[0] else j))
        floor = i + shift - 2 * BAND
        old = max(((*v, e) for e, v in new.items() if e < floor), default=None)
        best = {e: v for e, v in new.items() if e >= floor}
        if old is not None:
            best[old[2]] = old[:2]
    if not best:
        return 0, 0, 0
    matched, _, first, last = max((m, f - e, -f, e) for e, (m, f) in best.items())
    return matched, -first, last


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: dict[str, str] | None = None, coverage: float = COVERAGE) -> DataFrame:
    """(id, template, matched_words, template_words, coverage, first_char, end_char) of every notice found.

    Spans are [first_char, end_char) code points. A null or empty text has no notices; a notice that occurs
    twice in a text gives two rows; rows that repeat an id are scanned each, a null id stays null. Texts of any length
    are scanned whole. Other columns are not read. An empty table gives an empty one.
    """
    given = templates or TEMPLATES
    Index(given, coverage)
    kind = docs.schema[id_col].dataType.simpleString()
    names = ["id", "template", "matched_words", "template_words", "coverage", "first_char", "end_char"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(given, coverage)
        for b in batches:
            place, found = [], []
            for i, text in enumerate(b.column(1).to_pylist()):
                for r in index.scan(text or "", coverage):
                    place.append(i)
                    found.append(r)
            cols = list(zip(*found, strict=True)) if found else [[]] * 6
            types = (pa.string(), pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(place, pa.int64())), *(pa.array(c, t) for c, t in zip(cols, types, strict=True))], names=names)

    return docs.select(id_col, text_col).mapInArrow(run, f"id {kind}, template string, matched_words long, template_words long, coverage double, first_char long, end_char long")


def op6_query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return scan_licenses(docs).withColumnRenamed("id", "doc_id")
