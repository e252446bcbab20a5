"""Tokens, shards, rules, fingerprints, licenses, classifier and mixing."""

import hashlib
import itertools
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidemark.llm import bpe_automaton, license_scan, merkle, mixing, quality_classifier, quality_rules, token_shards
from tidemark.llm.wordpieces import vocabulary_path

SF = "/root/testdata/sf0.001"
FIELDS = "doc_id long, text string, lang string, id int, key string"
ODD = ["", None, " \n\t", "Hello  wörld's <|endoftext|>foo 12 ## é", "a" * 3000, "Σ Ʀ İ\x1cx\x85y ́z", "<|startoftext|><|", "日本語 テキスト 𝔘𝔫𝔦", "'s's 'T don't", "x\ty\x0bz\x0c\rw"]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(i * 2, t, None, 1, "k") for i, t in enumerate(ODD)], FIELDS)


def library_ids(text):
    return Tokenizer.from_file(vocabulary_path()).encode(text or "", add_special_tokens=False).ids


def test_automaton_equals_library(spark, odd):
    t = Tokenizer.from_file(vocabulary_path())
    rng = random.Random(4)
    texts = ODD + ["".join(chr(rng.choice([rng.randint(32, 126), rng.randint(160, 0x5FF), rng.randint(0x3000, 0x30FF)])) for _ in range(30)) for _ in range(200)]
    texts += ["".join(rng.choice("aab aaa'stT. ") for _ in range(40)) for _ in range(200)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.id: r for r in bpe_automaton.token_digests(df, decoded=True).collect()}
    ids = {r.id: r.ids for r in bpe_automaton.encode_documents(df).collect()}
    for i, text in enumerate(texts):
        want = t.encode(text or "", add_special_tokens=False).ids
        assert ids[i] == want
        assert got[i].n_tokens == len(want) and got[i].ids_sha256 == hashlib.sha256(" ".join(map(str, want)).encode()).hexdigest()
        assert got[i].decoded == t.decode(want, skip_special_tokens=False)


def test_shards_round_trip_and_lookup(spark, odd, tmp_path):
    extra = spark.createDataFrame([(100, "again", None, 1, ""), (100, "again and", None, 1, ""), (None, "null key", None, 1, "")], FIELDS)
    docs = odd.union(extra)
    folder = f"file://{tmp_path}/shards"
    manifest = token_shards.write_shards(docs, folder, shards=3)
    got = sorted((r.key if r.key is not None else -1, r.start, r.n_tokens, r.ids_crc32) for r in token_shards.shard_documents(folder, manifest).collect())
    rows = sorted(((-1 if r.doc_id is None else r.doc_id, [*library_ids(r.text), 1]) for r in docs.collect()), key=lambda r: (r[0], np.array(r[1], "<u2").tobytes()))
    want, at = [], 0
    for key, ids in rows:
        want.append((key, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert got == sorted(want)
    found = {r.key: r.ids for r in token_shards.lookup(folder, manifest, spark.range(-3, 30), "id").collect()}
    assert found == {i * 2: [*library_ids(t), 1] for i, t in enumerate(ODD)}


def test_perfect_hash():
    keys = np.unique(np.random.default_rng(0).integers(-(2**62), 2**62, 5000))
    h = token_shards.PerfectHash.build(keys)
    assert sorted(h.slots(keys)) == list(range(len(keys)))


def test_lookup_reads_little():
    """A key is found by a few short reads, the same in number for few and for many documents."""
    import pyarrow as pa

    class Counted:
        def __init__(self, data):
            self.file, self.read_bytes, self.reads = pa.BufferReader(data), 0, 0

        def seek(self, at):
            self.file.seek(at)

        def read(self, size):
            self.read_bytes, self.reads = self.read_bytes + size, self.reads + 1
            return self.file.read(size)

    for n in (10, 50_000):
        keys = np.arange(n) * 7 - 99
        f = Counted(token_shards.shard_bytes(keys, np.full(n, 3), np.arange(3 * n).astype(np.uint16).tobytes(), 2, 1))
        shard = token_shards.Shard(f)
        before = f.read_bytes, f.reads
        for i in (0, n // 2, n - 1):
            assert shard.document(shard.find(int(keys[i]))).tolist() == [(3 * i + j) % 65536 for j in range(3)]
        assert f.read_bytes - before[0] < 3 * 700 and f.reads - before[1] < 3 * 12
        assert sum(shard.find(int(k) + 1) >= 0 for k in keys[:50]) == 0
        assert [(k, a) for k, a, _ in shard.documents()] == [(k, 3 * i) for i, k in enumerate(keys.tolist())]


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_op3_query_equals_library(spark, sf):
    docs = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"/root/testdata/{sf}/documents.parquet").collect())
    t, at, want = Tokenizer.from_file(vocabulary_path()), 0, {}
    for i, text in docs:
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 1]
        want[i] = (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    assert {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in token_shards.op3_query(spark, f"/root/testdata/{sf}").collect()} == want


def test_op7_query_equals_library(spark):
    t = Tokenizer.from_file(vocabulary_path())
    want = {}
    for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect():
        ids = t.encode(r.text or "", add_special_tokens=False).ids
        want[r.doc_id] = (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest())
    assert {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe_automaton.op7_query(spark, "/root/testdata/sf0.01").collect()} == want


def test_tokens_of_empty_table_long_words_and_clashing_columns(spark, tmp_path):
    rng = random.Random(8)
    texts = ["x" * 20000, "".join(rng.choice("etaoin") for _ in range(20000)), None, "", "a b " * 30000]
    df = spark.createDataFrame([(1, t, 5, "k", 3) for t in texts], "doc_id long, text string, id int, n_tokens string, ids int")
    got = sorted(r.ids for r in bpe_automaton.encode_documents(df).collect())
    assert got == sorted(library_ids(t) for t in texts)
    assert sorted(r.ids for r in bpe_automaton.token_digests(df, ids=True).collect()) == got
    assert bpe_automaton.token_digests(df.limit(0)).count() == 0
    folder = f"file://{tmp_path}/none"
    manifest = token_shards.write_shards(df.limit(0), folder, shards=2)
    assert token_shards.shard_documents(folder, manifest).count() == 0
    assert token_shards.lookup(folder, manifest, spark.range(3), "id").count() == 0


def test_base_counts(spark, odd):
    rng = random.Random(9)
    texts = [*ODD, "a b c a b c\na b\n\na b\n#x", "\n\n", "one\n", *["".join(rng.choice("ab \n#é") for _ in range(120)) for _ in range(40)]]
    df = spark.createDataFrame([(i, t, None, 1, "k") for i, t in enumerate(texts)], FIELDS)
    got = {r.id: r for r in quality_rules.judge(df).collect()}
    for i, t in enumerate(texts):
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == quality_rules.op2_brute(t)
        assert not (r.base_failed and r.kept)


def test_bands_keep_clean_documents_and_reject_junk(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    rows = quality_rules.judge(docs).where("not base_failed").join(labels, F.col("id") == labels.doc_id)
    rate = {r.quality: r.k for r in rows.groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("k")).collect()}
    assert rate[1] > 0.95 and rate[0] < 0.6


def test_bands_follow_length_where_classes_are_sparse(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    rows = quality_rules.judge(docs).where("not base_failed and n_words >= 2048").join(labels, F.col("id") == labels.doc_id, "left").collect()
    clean = [r.kept for r in rows if r.quality == 1]
    assert len(clean) == 40 and all(clean)
    assert np.mean([r.kept for r in rows if r.n_words >= 4096]) > 0.85


def brute_tree(text):
    """Root, sections, paragraphs and leaves by plain loops: (digest, children) each, digests in full."""
    import re

    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    phrases = [m.group() for m in re.finditer(r"(?:[^ \t\n]+[ \t]*){1,8}\n*|[ \t\n]+", text or "")]
    leaves = [(sha(p), "=" if "\n\n" in p else "-" if "\n" in p else ".") for p in phrases]

    def groups(nodes, ends):
        out, run = [], []
        for d, m in nodes:
            run.append((d, m))
            if ends(d, m):
                out.append(run)
                run = []
        return out + [run] * bool(run)

    level = lambda gs: [(sha("".join(d + m for d, m in g)), g[-1][1], len(g)) for g in gs]
    lines = level(groups(leaves, lambda d, m: m != "."))
    parts = level(groups([x[:2] for x in lines], lambda d, m: m == "=" or d[-1] == "0"))
    return sha("".join(d for d, _, _ in parts)), [(d, n) for d, _, n in parts], [(d, n) for d, _, n in lines], [d for d, _ in leaves]


def test_merkle_equals_plain_tree(spark, odd):
    rng = random.Random(6)
    texts = [*ODD, *["".join(rng.choice(["a ", "bb", " c", "\n", "\n\n", "\t", ". "]) for _ in range(rng.randint(0, 400))) for _ in range(60)], "word " * 20000]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id long, text string")
    for r in df.select("id", merkle.fingerprint(F.col("text")).alias("f")).collect():
        top, parts, lines, leaves = brute_tree(texts[r.id])
        show = lambda nodes: ",".join(f"{d[:8]}{n}" for d, n in nodes)
        assert r.f == ":".join([top, show(parts), show(lines), "".join(d[:8] for d in leaves)])
    fps = {}
    for r in odd.select("text", merkle.fingerprint(F.col("text")).alias("f")).collect():
        fps.setdefault(r.f.split(":")[0], set()).add(r.text or "")
    assert all(len(v) == 1 for v in fps.values()) and len(fps) == len({t or "" for t in ODD})


def test_edits_are_located_on_both_sides(spark):
    line = lambda k: f"line {k} of the text\n"
    base = "".join(map(line, range(60)))
    edited = base.replace(line(7), "another line\n").replace(line(40), "") + "one more\n"
    pairs = [(0, base, edited), (1, "same\n" * 3, "same\n"), (2, base, base), (3, "", "new\n"), (4, None, "x"), (5, "one line only", "one line oNly")]
    df = spark.createDataFrame(pairs, "key long, a string, b string").select("key", *[F.when(F.col(c).isNotNull(), merkle.fingerprint(F.col(c))).alias(c) for c in "ab"])
    got = {}
    for r in merkle.locate_edits(df, "key", "a", "b").collect():
        got.setdefault(r.id, set()).add((r.side, r.paragraph))
    assert got == {0: {("a", 7), ("a", 40), ("b", 7), ("b", 59)}, 1: {("a", 1), ("a", 2)}, 3: {("b", 0)}, 5: {("a", 0), ("b", 0)}}
    alike = {r.key: r.x for r in df.select("key", merkle.likeness(F.col("a"), F.col("b")).alias("x")).collect()}
    assert alike[2] == 1.0 and 0.8 < alike[0] < 1 and alike[3] == 0


def test_fingerprints_with_odd_ids_and_columns(spark):
    df = spark.createDataFrame([(None, "n", "x"), (3, "a", "y"), (3, "b", "z"), (1, None, "w")], "doc_id long, text string, next_text string")
    got = sorted((-1 if r.doc_id is None else r.doc_id, r.text or "", r.next_text or "") for r in merkle.with_next(df, "doc_id", ["text"]).collect())
    assert [g[:2] for g in got] == [(-1, "n"), (1, ""), (3, "a"), (3, "b")] and got[0][2] == "" and got[1][2] in "ab" and {g[2] for g in got} >= {"", "n"}
    one = merkle.with_next(df.where("text = 'n'"), "doc_id", ["text"]).collect()
    assert [(r.doc_id, r.next_text) for r in one] == [(None, "n")]


def test_clashing_columns_give_way(spark):
    from tidemark.llm import substring_dedup, suffix_dedup

    clash = ("n_words", "n_removed", "kept_text", "removed_spans", "n_bytes", "n_symbols", "chars_per_piece")
    df = spark.createDataFrame([(1, "a b c " * 30, "en", *clash), (2, "a b c " * 30, "en", *clash), (None, None, None, *clash)], f"doc_id long, text string, lang string, {', '.join(f'{c} string' for c in clash)}")
    for out in (suffix_dedup.remove_repeats(df, kept_text=True), substring_dedup.remove_repeated_windows(df), quality_rules.measure(df)):
        assert len(set(out.columns)) == len(out.columns) and out.count() == 3


@pytest.mark.parametrize("ranges", [1, 3, 50])
def test_next_rows(spark, ranges):
    rng = random.Random(ranges)
    ids = rng.sample(range(-500, 10**6), 40)
    df = spark.createDataFrame([(i, f"t{i}") for i in ids], "doc_id long, text string")
    got = {r.doc_id: r.next_text for r in merkle.with_next(df, "doc_id", ["text"], ranges).collect()}
    s = sorted(ids)
    assert got == {a: f"t{b}" for a, b in zip(s, s[1:] + s[:1], strict=True)}
    assert merkle.with_next(df.limit(0), "doc_id", ["text"], ranges).count() == 0


def test_edited_texts(spark):
    docs = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect())
    got = {r.doc_id: r for r in merkle.op4_query(spark, SF).collect()}
    for (i, x), (_, y) in zip(docs, docs[1:] + docs[:1], strict=True):
        h = len(x) // 2
        assert got[i].edited_sha256 == hashlib.sha256((x[: len(x) - h] + y[:h]).encode()).hexdigest()
    assert np.mean([r.near_edited for r in got.values()]) > 0.4 > 0.1 > np.mean([r.near_next for r in got.values()])


def test_licenses(spark):
    mit = license_scan.TEMPLATES["mit-grant"]
    texts = [None, "", "foo. " + mit.replace("merge", "combine") + " bar", "All rights\nreserved. x All rights reserved.", "nothing here is licensed", mit[: len(mit) // 2]]
    df = spark.createDataFrame([(i, t, None, 1, "k") for i, t in enumerate(texts)], FIELDS)
    got = [(r.id, r.template, r.first_char, r.end_char) for r in license_scan.scan_licenses(df).orderBy("id", "first_char").collect()]
    n = len(texts[2])
    assert got == [(2, "mit-grant", 5, n - 4), (3, "all-rights-reserved", 0, 20), (3, "all-rights-reserved", 23, 43)]


@pytest.mark.parametrize("least", [0.5, 0.8, 1.0])
def test_licenses_with_any_words_changed_that_coverage_allows(least):
    """Every choice of changed words in short templates, and many in long ones."""
    rng = random.Random(5)
    given = {**license_scan.TEMPLATES, "one": "Unlicense", "two": "Public domain", **{f"n{n}": " ".join(f"w{n}x{i}" for i in range(n)) for n in range(3, 30)}}
    index = license_scan.Index(given, least)
    for name, text in given.items():
        words = license_scan.terms(text)[0]
        n = len(words)
        e = max(e for e in range(n) if n - e >= least * n)
        for some in itertools.islice(itertools.combinations(range(n), e), 200) if n < 10 else [rng.sample(range(n), e) for _ in range(100)] + [range(2, n, 3)[:e], range(1, n, 2)[:e]]:
            new = [f"zz{i}" if i in some else w for i, w in enumerate(words)]
            found = index.scan("aa bb cc " + " ".join(new) + " dd ee", least)
            assert any(r[0] == name and r[1] >= n - e for r in found), (name, some)


def test_licenses_of_the_table_equal_plain_search(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    found = {(r.id, r.template) for r in license_scan.scan_licenses(docs).collect()}
    plain = {(r.doc_id, k) for r in docs.collect() for k in ("all-rights-reserved", "apache-2.0", "cc-by-nc-4.0", "gpl-3.0", "mit") if license_scan.TEMPLATES[k] in r.text}
    assert plain and plain <= found


def test_classifier(spark):
    sf = "/root/testdata/sf0.1"
    rows = quality_classifier.op9_query(spark, sf)
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    r = rows.where("held_out").join(labels, "doc_id").agg(F.avg((F.col("predicted") == F.col("quality")).cast("int")).alias("accuracy"), F.count("*").alias("n")).first()
    assert r.n > 500 and r.accuracy > 0.97
    assert {x.doc_id: x.held_out for x in rows.limit(50).collect()} == {x.doc_id: quality_classifier.crc_remainder(x.doc_id) == 0 for x in rows.limit(50).collect()}


def test_classifier_without_labels_or_texts(spark, odd):
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {r.score for r in quality_classifier.score(odd, quality_classifier.train(odd, none)).collect()} == {0.5}


def brute_rates(p, n, goal, steps=400_000):
    """Plain projected gradient on every rate, in the metric of tokens."""
    r, total = np.ones(len(p)), n.sum()
    for _ in range(steps):
        e = (r * n) @ p / total - goal
        r = np.maximum(0, r - (p @ e + mixing.RIDGE * (r - 1)))
        if np.abs(e).max() < 1e-9:
            break
    return r


def test_rates_equal_plain_projected_gradient(spark):
    rng = np.random.default_rng(0)
    p = rng.dirichlet([0.5, 0.3, 0.2], 300)
    n = rng.integers(10, 500, 300)
    df = spark.createDataFrame([(int(m), *map(float, q)) for m, q in zip(n, p, strict=True)], "n_tokens long, posterior_a double, posterior_b double, posterior_c double")
    for goal in ([0.6, 0.3, 0.1], [0.9, 0.05, 0.05]):
        x, totals = mixing.solve(df, ["a", "b", "c"], goal)
        assert np.abs(totals - goal).max() < 1e-4
        r = np.maximum(0, 1 - p @ x)
        plain = brute_rates(p, n.astype(float), np.array(goal))
        assert np.abs((plain * n) @ p / n.sum() - goal).max() < 1e-4
        far = lambda q: (n * (q - 1) ** 2).sum() / n.sum()
        assert far(r) <= far(plain) * 1.001 + 1e-9 and np.abs(r - plain).max() < 0.05


def test_targets_out_of_reach_give_the_nearest_totals(spark):
    df = spark.createDataFrame([(10, 0.8, 0.2), (30, 0.6, 0.4)], "n_tokens long, posterior_a double, posterior_b double")
    x, totals = mixing.solve(df, ["a", "b"], [0.1, 0.9])
    best = min((np.hypot(a * 0.8 + b * 0.6 - 0.1, a * 0.2 + b * 0.4 - 0.9), a, b) for a in np.linspace(0, 3, 301) for b in np.linspace(0, 3, 301))
    assert np.hypot(totals[0] - 0.1, totals[1] - 0.9) < best[0] + 1e-3


def test_mixing_meets_targets_on_the_given_table(spark):
    rows = mixing.op8_query(spark, "/root/testdata/sf0.01").collect()
    total = sum(r.n_tokens * r.rate for r in rows)
    for d, t in mixing.TARGETS.items():
        assert abs(sum(r.n_tokens * r.rate * r[f"posterior_{d}"] for r in rows) / total - t) < 1e-3 and abs(rows[0][f"share_{d}"] - t) < 1e-3
    assert all(r.rate >= 0 and abs(r.posterior_high + r.posterior_low + r.posterior_toxic - 1) < 1e-9 for r in rows)


def test_mixing(spark, odd):
    labels = spark.createDataFrame([(0, 1, 0), (2, 0, 0), (4, 1, 1), (6, None, None), (8, 0, 0), (8, 1, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    got = mixing.mix(odd, labels).collect()
    assert len(got) == len(ODD) and all(r.rate >= 0 for r in got)
    assert mixing.mix(odd.limit(0), labels).count() == 0
    assert mixing.mix(odd.union(odd), labels.limit(0)).count() == 2 * len(ODD)
    assert {r.c for r in spark.range(500).select(mixing.copies(F.lit(1.25), F.col("id")).alias("c")).collect()} == {1, 2}


def test_follow_equals_plain_loop():
    """FTRL of one row and class after the other, in scalars."""
    rng = np.random.default_rng(3)
    z, n, plain = np.zeros((1, 9)), np.zeros((1, 9)), [[0.0, 0.0] for _ in range(9)]
    q = quality_classifier
    for _ in range(60):
        f = np.sort(rng.choice(9, 4, replace=False))
        v, y = rng.random(4), float(rng.integers(2))
        q.follow(f, v, np.array([y]), z, n)
        w = [0.0 if abs(plain[i][0]) <= q.L1 else -(plain[i][0] - np.sign(plain[i][0]) * q.L1) / ((q.BETA + plain[i][1] ** 0.5) / q.ALPHA + q.L2) for i in f]
        p = 1 / (1 + np.exp(-sum(a * b for a, b in zip(w, v, strict=True))))
        for i, a, b in zip(f, v, w, strict=True):
            g = (p - y) * a
            plain[i] = [plain[i][0] + g - ((plain[i][1] + g * g) ** 0.5 - plain[i][1] ** 0.5) / q.ALPHA * b, plain[i][1] + g * g]
    assert np.allclose(z[0], [a for a, _ in plain]) and np.allclose(n[0], [b for _, b in plain])


def test_packed_table_equals_the_library_while_pieces_are_dropped(monkeypatch):
    """Words of all kinds, few of them kept, over many calls: known pieces in new words, line feeds, marks and letters beyond Latin."""
    import random

    from tokenizers import Tokenizer

    from tidemark.llm import wordpieces

    monkeypatch.setattr(wordpieces, "KEPT_PACKED", 60)
    monkeypatch.setattr(wordpieces, "KEPT_PIECES", 40)
    path = wordpieces.vocabulary_path()
    library, rng = Tokenizer.from_file(path), random.Random(3)
    some = ["Wort", "naïve,", "ÉCOLE's", "don't", "x\x1fy", "a\xa0b", "½kg", "12.5", "İstanbul", "Ⱥb", "слово", "é", "漢字", "<|endoftext|>", "<|x", "(foo)", "foo,", "\x85", "ſt", "...", "Größe42"]
    for kind, size in (("H", 2), ("I", 4)):
        table = wordpieces.PackedTable(path, kind)
        for _ in range(60):
            texts = [rng.choice([" ", "\n", "\t\r\n"]).join(rng.choice(some) + rng.choice(["", "", ".", str(rng.randrange(99))]) for _ in range(rng.randrange(12))) for _ in range(5)]
            want = [b"".join(i.to_bytes(size, "little") for i in library.encode(t, add_special_tokens=False).ids) for t in texts]
            assert table.joined([t.encode() for t in texts]) == want
