"""Queries over a whole table against plain loops, and odd rows of the operators on one document each."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import license_scan, merkle, near_dedup, quality_classifier, quality_rules, substring_dedup, suffix_dedup

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def rows(spark):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]


def by_id(df, columns):
    return {r.doc_id: tuple(r[c] for c in columns) for r in df.collect()}


def test_op1_query(spark, rows):
    want = suffix_dedup.op1_brute(rows)
    assert by_id(suffix_dedup.op1_query(spark, SF), ["n_bytes", "n_removed", "n_spans", "kept_sha256"]) == want and sum(w[1] for w in want.values()) > 500


def test_op2_query(spark, rows):
    got = by_id(quality_rules.op2_query(spark, SF), ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"])
    assert {i: v[:-1] for i, v in got.items()} == {i: quality_rules.op2_brute(t) for i, t in rows}
    assert not any(v[-1] for v in got.values() if v[-2])


def test_op5_query(spark, rows):
    want = substring_dedup.op5_brute(rows)
    assert by_id(substring_dedup.op5_query(spark, SF), ["n_words", "n_removed", "kept_sha256"]) == want and sum(w[1] for w in want.values()) > 100


def test_op10_query(spark, rows):
    assert by_id(near_dedup.op10_query(spark, SF), ["n_shingles", "component_id", "kept"]) == near_dedup.op10_brute(rows)


def texts_with(texts, template, least):
    """Numbers of the texts with a stretch of the template's length and BAND words more whose longest common subsequence with it is long enough."""
    words = license_scan.terms(template)[0]
    number = {w: i for i, w in enumerate(dict.fromkeys(words))}
    m = len(words) + license_scan.BAND
    flat, row = [], []
    for i, t in enumerate(texts):
        w = license_scan.terms(t or "")[0]
        flat += [number.get(x, -1) for x in w] + [-2] * m
        row += [i] * (len(w) + m)
    flat, n = np.array(flat), len(flat) - m + 1
    best = np.zeros((m + 1, n), np.int16)
    for w in words:
        before = best.copy()
        for j in range(1, m + 1):
            up = np.maximum(best[j - 1], before[j])
            best[j] = np.where(flat[j - 1 : j - 1 + n] == number[w], np.maximum(up, before[j - 1] + 1), up)
    return set(np.array(row)[:n][(best[m] >= least * len(words)) & (flat[:n] != -2)].tolist())


def test_op6_query_finds_all_notices_and_no_others(spark, rows):
    """Both ways, on the table and on notices with words changed or left out, some more than the coverage allows."""
    rng = random.Random(2)
    planted = []
    for text in license_scan.TEMPLATES.values():
        for changes in (0, 1, 2, 5, 12):
            w = text.split()
            for _ in range(min(changes, len(w) - 1)):
                i = rng.randrange(len(w))
                w[i : i + 1] = rng.choice([["changed"], []])
            planted.append("some words before " + " ".join(w) + " and after")
    texts = [t for _, t in rows] + planted
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {(r.id, r.template) for r in license_scan.scan_licenses(df).collect()}
    assert found == {(i, k) for k, v in license_scan.TEMPLATES.items() for i in texts_with(texts, v, license_scan.COVERAGE)} and len(found) > 40
    got = {(r.doc_id, r.template) for r in license_scan.op6_query(spark, SF).collect()}
    assert got == {(rows[i][0], k) for i, k in found if i < len(rows)}


def test_licenses_of_odd_rows(spark):
    notice = "All rights reserved."
    df = spark.createDataFrame([(None, notice, "x"), (5, notice, "x"), (5, notice, "x"), (6, None, "x"), (7, "word " * 100_000 + notice, "x")], "doc_id long, text string, template string")
    got = sorted((r.id or 0, r.template, r.first_char) for r in license_scan.scan_licenses(df).collect())
    assert got == [(0, "all-rights-reserved", 0), (5, "all-rights-reserved", 0), (5, "all-rights-reserved", 0), (7, "all-rights-reserved", 500_000)]
    assert license_scan.scan_licenses(df.limit(0)).count() == 0


def test_classifier_of_odd_rows(spark):
    """Null and repeated ids, names that clash, an empty table and a very long text."""
    good, bad = "a fair sentence about the river and the town . " * 6, "$$$ buy %%% now ### " * 9
    docs = [(i, good if i % 2 else bad, 0.5, 1) for i in range(40)] + [(None, good, 0.5, 1), (3, bad, 0.5, 1), (99, None, 0.5, 1), (100, good * 5000, 0.5, 1)]
    df = spark.createDataFrame(docs, "doc_id long, text string, score double, shard int")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)] + [(None, 1), (5, 0), (6, None)], "doc_id long, quality int")
    out = quality_classifier.score(df, quality_classifier.train(df, labels)).collect()
    assert len(out) == len(docs) and all(0 <= r.score <= 1 for r in out) and sum(r.id is None for r in out) == 1 and sum(r.id == 3 for r in out) == 2
    scores = {r.id: r.score for r in out if r.id not in (3, None)}
    assert scores[7] > 0.5 > scores[8] and scores[100] > 0.5
    assert quality_classifier.score(df.limit(0), quality_classifier.train(df.limit(0), labels)).count() == 0


def test_quality_rules_of_repeated_rows_and_ties(spark):
    """All rows alike: each is at both ends of every band, and within it."""
    rng = random.Random(4)
    text = " ".join("".join(rng.choice("abcdefghilmnorstu") for _ in range(rng.randrange(2, 9))) for _ in range(120))
    df = spark.createDataFrame([(1, text, "en", 0.0, "x"), (1, text, "en", 0.0, "x"), (2, text, "en", 0.0, "x"), (None, text, None, 0.0, "x"), (3, "short", "en", 0.0, "x"), (4, None, None, 0.0, "x")], "doc_id long, text string, lang string, octave double, band_group string")
    got = sorted((r.id or 0, r.base_failed, r.kept) for r in quality_rules.judge(df).collect())
    assert got == [(0, False, True), (1, False, True), (1, False, True), (2, False, True), (3, True, False), (4, True, False)]
    assert quality_rules.judge(df.limit(0)).count() == 0


@pytest.mark.parametrize("docs", [[], [(1, "one text")], [(1, None)], [(None, "no id"), (2, None), (2, "b"), (2, "b"), (3, "c " * 3000), (4, "")]])
def test_op4_query_of_odd_rows(spark, tmp_path, docs):
    spark.createDataFrame([(i, t, "x") for i, t in docs], "doc_id long, text string, fingerprint string").write.parquet(str(tmp_path / "documents.parquet"))
    out = merkle.op4_query(spark, str(tmp_path)).collect()
    assert sorted((r.doc_id or 0, r.n_chars) for r in out) == sorted((i or 0, len(t or "")) for i, t in docs)
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in out)
    same = {}
    for r in out:
        same.setdefault((r.doc_id, r.n_chars), set()).add(r.fingerprint)
    assert all(len(v) == 1 for v in same.values())
    if len(docs) == 1:
        assert out[0].near_next == 1.0
