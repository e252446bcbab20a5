"""Dedup operators against brute force: planted cases and odd rows."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import near_dedup, substring_dedup, suffix_dedup
from tidemark.llm.components import components

FIELDS = "doc_id long, text string, block int, payload string"


def corpus(seed=5):
    rng = random.Random(seed)
    vocab = ["".join(rng.choice("abcdeé ") for _ in range(rng.randint(1, 6))).strip() or "x" for _ in range(150)]
    say = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    shared, base = say(60), say(120)
    docs = [say(rng.randint(0, 90)) for _ in range(40)]
    docs += [say(20) + "\n" + shared + "\n" + say(15) for _ in range(6)]
    for k in range(8):
        w = base.split()
        for _ in range(k * 2):
            w[rng.randrange(len(w))] = rng.choice(vocab)
        docs.append(" ".join(w))
    docs += [docs[0], docs[0], base, "", None, " \n\t ", "Of " * 80, "Of " * 80, "aaaa" * 40, "one two", "ONE two", "a", say(3000)]
    return [(3 * i + 1, t) for i, t in enumerate(docs)]


@pytest.fixture(scope="module")
def docs(spark):
    rows = corpus()
    return rows, spark.createDataFrame([(i, t, 7, "p") for i, t in rows], FIELDS).repartition(5).cache()


def test_suffix_dedup(docs):
    rows, df = docs
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.sha) for r in suffix_dedup.remove_repeats(df, block_bytes=4000).select("*", F.sha2("kept_bytes", 256).alias("sha")).collect()}
    want = suffix_dedup.op1_brute(rows)
    assert got == want and sum(w[1] for w in want.values()) > 500


def test_suffix_dedup_spans_and_other_columns(spark):
    text = "x" * 10 + "0123456789" * 6
    df = spark.createDataFrame([(1, "0123456789" * 6, 1, "a"), (2, text, 2, "b"), (2, text, 3, "c"), (None, None, 4, "d")], FIELDS)
    got = {r.block: r for r in suffix_dedup.remove_repeats(df).collect()}
    assert got[2].removed_spans == [[10, 70]] and got[3].removed_spans == [[10, 70]] and got[2].payload == "b"
    assert got[4].doc_id is None and got[4].n_bytes == 0 and got[1].n_removed == 0


def test_substring_dedup(docs):
    rows, df = docs
    got = {r.doc_id: (r.n_words, r.n_removed, r.sha) for r in substring_dedup.remove_repeated_windows(df, block_bytes=4000).select("*", F.sha2("kept_text", 256).alias("sha")).collect()}
    want = substring_dedup.op5_brute(rows)
    assert got == want and sum(w[1] for w in want.values()) > 300


def test_near_dedup(docs):
    rows, df = docs
    got = {r.id: (r.n_shingles, r.component_id, r.kept) for r in near_dedup.near_duplicates(df).collect()}
    want = near_dedup.op10_brute(rows)
    assert got == want and sum(not w[2] for w in want.values()) > 4


def test_near_dedup_chain_is_one_component(spark):
    words = [f"w{i}" for i in range(200)]
    chain = [(100 - k, " ".join(words[k * 5 : k * 5 + 100])) for k in range(20)]  # neighbours alone are similar enough
    df = spark.createDataFrame([(i, t, 0, "") for i, t in chain], FIELDS)
    got = {r.id: (r.n_shingles, r.component_id, r.kept) for r in near_dedup.near_duplicates(df).collect()}
    assert got == near_dedup.op10_brute(chain) and {v[1] for v in got.values()} == {81}


def test_open_bands_find_links_that_stars_miss(spark):
    """Members of one band in different components are met with each other."""
    rng = random.Random(1)
    base = [f"b{i}" for i in range(150)]
    rows = []
    for i in range(60):
        w = list(base)
        for _ in range(rng.choice([2, 6, 7, 8])):
            w[rng.randrange(len(w))] = f"e{rng.randrange(10**6)}"
        rows.append((i, " ".join(w)))
    df = spark.createDataFrame([(i, t, 0, "") for i, t in rows], FIELDS)
    got = {r.id: (r.n_shingles, r.component_id, r.kept) for r in near_dedup.near_duplicates(df).collect()}
    assert got == near_dedup.op10_brute(rows)


@pytest.mark.parametrize("run", [suffix_dedup.remove_repeats, substring_dedup.remove_repeated_windows, near_dedup.near_duplicates])
def test_empty_table(spark, run):
    assert run(spark.createDataFrame([], FIELDS)).count() == 0


def test_components(spark):
    rng = random.Random(2)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(400, 460)]
    root = list(range(500))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in links:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    got = {r.id: r.component_id for r in components(spark.createDataFrame(links, "a long, b long"), spark.range(500)).collect()}
    assert got == {i: find(i) for i in range(500)}


def test_near_dedup_of_repeated_ids_and_nulls(spark):
    text = " ".join(f"w{i}" for i in range(60))
    df = spark.createDataFrame([(5, text, 0, ""), (5, text + " more", 0, ""), (7, text, 0, ""), (7, "else " * 9, 0, ""), (None, text, 0, ""), (9, None, 0, "")], FIELDS)
    got = sorted((r.id or -1, r.n_shingles, r.component_id, r.kept) for r in near_dedup.near_duplicates(df).collect())
    assert got == [(-1, 56, None, True), (5, 56, 5, True), (5, 57, 5, True), (7, 5 - 4, 5, False), (7, 56, 5, False), (9, 0, 9, True)]


def test_no_pair_that_shares_a_band_is_lost_inside_tasks(spark):
    """Several thousand pairs over the threshold, each a component of its own, given with every band they share."""
    rng = np.random.default_rng(5)
    n, size, common = 4000, 140, 123  # similarity 123 / 157
    sets = rng.integers(0, 2**64, (n, 2 * size - common), dtype=np.uint64)
    flat = np.concatenate((sets[:, :size], sets[:, size - common :]), 1).reshape(2 * n, size)
    regs = near_dedup.registers(flat.ravel(), np.arange(2 * n + 1) * size, near_dedup.WIDE)
    keys = near_dedup.band_keys(regs[:, : near_dedup.M]).view(np.int64)
    wide = near_dedup.wide_rows(regs)
    shared = keys[0::2] == keys[1::2]
    assert shared.any(1).all()
    rows = [(int(keys[i, b]), int(b), i, i, size, wide[i].tobytes(), True) for p, b in zip(*np.nonzero(shared), strict=True) for i in (2 * int(p), 2 * int(p) + 1)]
    members = spark.createDataFrame(rows, "key long, band int, id long, label long, n_shingles long, wide binary, whole boolean")
    assert sorted((r.a, r.b) for r in near_dedup._across(near_dedup._dealt(members), 0.75).collect()) == [(2 * p + 1, 2 * p) for p in range(n)]


def test_recall_on_thousands_of_documents_with_opened_bands(spark):
    """Families whose members are drawn so that many pairs lie about the threshold."""
    rng = random.Random(8)
    rows = []
    for f in range(60):
        base = [f"f{f}w{i}" for i in range(120)]
        for _ in range(50):
            w = list(base)
            for _ in range(rng.choice([1, 2, 3, 4, 5, 6])):
                w[rng.randrange(len(w))] = f"e{rng.randrange(10**7)}"
            rows.append((len(rows), " ".join(w)))
    rng.shuffle(rows)
    df = spark.createDataFrame([(i, t, 0, "") for i, t in rows], FIELDS)
    got = {r.id: (r.n_shingles, r.component_id, r.kept) for r in near_dedup.near_duplicates(df).collect()}
    want = near_dedup.op10_brute(rows)
    assert sum(got[i] == want[i] for i in want) >= 0.999 * len(want)


def test_open_bands_with_shared_ids(spark):
    """As above, with rows that share ids: their links add up."""
    rng = random.Random(6)
    base = [f"b{i}" for i in range(150)]
    rows = []
    for i in range(60):
        w = list(base)
        for _ in range(rng.choice([2, 6, 7, 8])):
            w[rng.randrange(len(w))] = f"e{rng.randrange(10**6)}"
        rows.append((i, " ".join(w)))
    plain = near_dedup.op10_brute(rows)
    shared = [(i if i < 50 else i - 50, t) for i, t in rows]
    df = spark.createDataFrame([(i, t, 0, "") for i, t in shared], FIELDS)
    got = {}
    for r in near_dedup.near_duplicates(df).collect():
        got.setdefault(r.id, set()).add(r.component_id)
    root = {i: i for i in range(50)}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, (_, c, _) in plain.items():
        a, b = find(i % 50), find(c % 50)
        root[max(a, b)] = min(a, b)
    assert got == {i: {find(i)} for i in range(50)}
