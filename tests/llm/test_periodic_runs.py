"""Periodic runs against plain loops: random and hard sequences, odd rows, and a whole table."""

import random
import zlib

import pytest
from pyspark.sql import functions as F

from tidemark.llm import periodic_runs as P

SF = "/root/testdata/sf0.001"


def plain(words, least=12):
    found, n = {}, len(words)
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j - i >= q and j + q - i >= least:
                found.setdefault((i, j + q), q)
            i = j + 1
    return sorted((s, e - s, q) for (s, e), q in found.items())


def found(texts, least=12):
    return [[(r["start"], r["length"], r["period"]) for r in x] for x in P.texts_with_runs([" ".join(t).encode() for t in texts], least)[1]]


def made(rng):
    w = [f"w{rng.randrange(rng.choice([1, 2, 3, 50]))}" for _ in range(rng.choice([0, 1, 5, 30, 100, 300, 700]))]
    for _ in range(rng.randrange(4) if w else 0):
        p, s, at = rng.randrange(1, max(2, len(w) // 3)), rng.randrange(len(w)), rng.randrange(len(w))
        block = [w[(s + i) % len(w)] for i in range(p)] * rng.randrange(2, 6)
        w[at : at + rng.randrange(3)] = block[: rng.randrange(1, len(block) + 1)]
    if rng.random() < 0.2:  # periodic parts that abut, whose runs have no k-gram that is not periodic in a first period
        x = rng.choice([["a", "b"], ["a", "b", "a"]])
        w += x * rng.randrange(2, 80) + x[::-1] * rng.randrange(2, 80) + x * rng.randrange(2, 80)
    return w


@pytest.mark.parametrize("seed", range(12))
def test_random_sequences(seed):
    rng = random.Random(seed)
    texts = [made(rng) for _ in range(12)]
    assert found(texts) == [plain(t) for t in texts]


def test_words_of_many_runs():
    a, b = "a", "ab"
    while len(b) < 1600:
        a, b = b, b + a
    thue = "a"
    while len(thue) < 1024:
        thue += thue.translate(str.maketrans("ab", "ba"))
    texts = [list(b), list(thue), list("ab" * 400 + "ba" * 400), ["x"] * 900, list("aab" * 150 + "aba" * 150)]
    assert found(texts) == [plain(t) for t in texts]
    assert found(texts, 5) == [plain(t, 5) for t in texts]


def test_texts_do_not_meet():
    half = [f"w{i}" for i in range(40)]
    assert found([half, half, half]) == [[], [], []]


def test_odd_rows(spark):
    run = ("a b c " * 8).strip()
    rows = [(1, None, "x"), (2, "", "x"), (None, run, "x"), (3, run, "x"), (3, run, "x"), (4, " \t\n\x0b\x0c\r ", "x"), (5, "é ü " * 13, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, runs string")
    got = sorted(((r.id or 0, r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in P.periodic_runs(df).collect()))
    one = (24, [(0, 24, 3)], "a b c")
    assert got == [(0, *one), (1, 0, [], ""), (2, 0, [], ""), (3, *one), (3, *one), (4, 0, [], ""), (5, 13, [(0, 13, 1)], "é ü")]
    assert P.periodic_runs(df.limit(0)).count() == 0


def test_very_long_text(spark):
    rng = random.Random(1)
    block = [f"w{rng.randrange(900)}" for _ in range(21_000)]
    text = " ".join(["head", *block, *block, *block[:5000], "tail"])
    r = P.periodic_runs(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert (1, 47_000, 21_000) in [tuple(x) for x in r.runs] and len(r.collapsed.split()) <= 21_002


def test_whole_table_with_planted_periods(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    got = {r.doc_id: tuple(r)[1:] for r in P.op11_query(spark, SF).collect()}
    assert got == {d.doc_id: P.op11_brute(d.doc_id, d.text) for d in docs}
    assert sum(v[0] > 0 for v in got.values()) > 10


def test_planted_null_and_empty(spark):
    one = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 10 == 0)
    df = spark.createDataFrame([(None, "a b"), (one, None), (one, " ")], "doc_id long, text string")
    got = df.select("doc_id", P.planted(F.col("text"), F.col("doc_id")).alias("text")).collect()
    assert {tuple(r) for r in got} == {(None, "a b"), (one, None), (one, "")}
