"""The pipeline: stage order, what each stage may change, and rows of brute force."""

from collections import Counter

from pyspark.sql import functions as F

import corpus_pipeline
from tidemark.llm import near_dedup, quality_rules
from tidemark.llm.suffix_dedup import whole_characters

SF = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "near_dedup", "suffix_dedup", "mixing", "bpe_tokens"]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        before = {r.doc_id: r.text for r in docs.collect()}
        stage(spark, docs, SF).write.parquet(f"{tmp_path}/{k}")
        after = spark.read.parquet(f"{tmp_path}/{k}")
        ids = [r.doc_id for r in after.collect()]
        assert ids and set(ids) <= set(before)
        if k < 4:
            assert after.columns == list(corpus_pipeline.COLUMNS)
        if k == 0:
            assert all(not quality_rules.op2_brute(before[i])[-1] for i in ids)
        if k == 1:
            assert sorted(ids) == sorted(i for i, v in near_dedup.op10_brute(list(before.items())).items() if v[2])
        if k == 4:
            assert len(ids) == docs.count()
        docs = after


def test_empty_documents(spark):
    empty = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, SF).count() == 0


def test_null_and_repeated_ids(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    fine = [r.text for r in corpus_pipeline.quality(spark, docs, SF).where("lang = 'en'").orderBy("doc_id").limit(6).collect()]
    row = lambda i, t: (i, t, "en", "x", len(t))
    make = lambda rows: spark.createDataFrame(rows, docs.schema)
    texts = lambda df: sorted((r.doc_id is None, r.doc_id or 0, r.text) for r in df.collect())
    as_is = lambda rows: sorted((i is None, i or 0, t) for i, t, *_ in rows)

    odd = [row(None, fine[0]), row(10**9, fine[1]), row(10**9, "too short"), row(None, "too short"), row(10**9 + 1, fine[2]), row(10**9 + 1, fine[2])]
    kept = corpus_pipeline.quality(spark, docs.union(make(odd)), SF).where("doc_id is null or doc_id >= 1000000000")
    assert texts(kept) == as_is([odd[0], odd[1], odd[4], odd[5]])

    rows = [row(None, fine[0]), row(None, fine[0]), row(7, fine[1]), row(7, fine[1]), row(7, fine[2]), row(None, fine[2]), row(-3, fine[3]), row(4, fine[3]), row(None, fine[4]), row(None, ""), row(None, "")]
    kept = corpus_pipeline.near_dedup(spark, make(rows), SF)
    assert texts(kept) == as_is([rows[k] for k in (0, 2, 4, 6, 8, 9, 10)])

    shared = "one and the same passage of well over fifty bytes that several rows have. "
    rows = [row(None, "Third " + shared), row(5, "Second " + shared), row(None, "Fourth " + shared), row(2, "First " + shared), row(5, "Later " + shared)]
    left = corpus_pipeline.passages(spark, make(rows), SF).collect()
    assert len(left) == 5 and [r.doc_id for r in left if shared in r.text] == [2]

    rows = [row(None, fine[0]), row(None, fine[1]), row(3, fine[2]), row(3, fine[3])]
    keyed = make(rows).withColumn("key", corpus_pipeline.row_key())
    rates = corpus_pipeline.mix(keyed, spark.read.parquet(f"{SF}/labels.parquet"), row_col="key", whole="high", most=2).withColumnRenamed("id", "key")
    counts = rates.select("key", corpus_pipeline.copies(F.col("rate"), F.col("key")).alias("n"))
    wanted = {(r.doc_id, r.text): r.n for r in keyed.join(counts, "key").collect() if r.n}
    got = Counter((r.doc_id, r.text) for r in corpus_pipeline.mixing(spark, make(rows), SF).collect())
    assert got == wanted and {i for i, _ in got} >= {None}


def test_passages_remove_cut_characters_alone(spark):
    shared = "x" * 60
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(1, "ab\u00e9" + shared + "\u20ac"), (2, "\ufffd genuine \u00c9 cd\u00e9" + shared + "\u20ad, \ufffd too"), (3, "no passage \ufffd")]
    got = {r.doc_id: (r.text, r.n_chars) for r in corpus_pipeline.passages(spark, spark.createDataFrame([(i, t, "en", "x", len(t)) for i, t in rows], docs.schema), SF).collect()}
    left = "\ufffd genuine \u00c9 cd, \ufffd too"
    assert got == {1: (rows[0][1], 64), 2: (left, len(left)), 3: (rows[2][1], 12)}
    raw = "ab\u20accd".encode()
    assert whole_characters(raw[:3] + raw[4:], [[3, 4]]) == "abcd"


def test_mixing_is_bounded_and_meets_reachable_targets(spark):
    """What follows the quality rules has little low-quality text: no document is repeated to make up for it."""
    big = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{big}/documents.parquet")
    keyed = corpus_pipeline.quality(spark, docs, big).withColumn("key", corpus_pipeline.row_key())
    rows = corpus_pipeline.mix(keyed, spark.read.parquet(f"{big}/labels.parquet"), row_col="key", whole="high", most=corpus_pipeline.MOST_COPIES).collect()
    total = sum(r.n_tokens * r.rate for r in rows)
    for d in ("high", "low", "toxic"):
        share = sum(r.n_tokens * r.rate * r[f"posterior_{d}"] for r in rows) / total
        assert abs(share - rows[0][f"target_{d}"]) < 1e-3 and abs(share - rows[0][f"share_{d}"]) < 1e-6
    assert all(0 <= r.rate <= corpus_pipeline.MOST_COPIES for r in rows)
    assert all(r.rate >= 1 for r in rows if r.posterior_high >= max(r.posterior_low, r.posterior_toxic))
    assert all(r.rate <= 1 + 1e-9 for r in rows if r.posterior_low + r.posterior_toxic > 0.9)


def test_null_texts_long_texts_and_extra_columns(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    fine = corpus_pipeline.quality(spark, docs, SF).where("lang = 'en'").orderBy("doc_id").first().text
    long = " ".join(f"{w}{i}" if i % 7 == 0 else w for i, w in enumerate((fine.split() * 200)[:30_000]))
    rows = [(1, None, None, None, None, "k"), (2, fine, "en", "x", len(fine), "k"), (3, long, "en", "x", len(long), "k")]
    odd = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, key string")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, odd, SF)
        got = {r.doc_id for r in out.collect()}
        assert (1 in got) == (name not in ("quality_rules",)) or name == "mixing", name
        assert {2} <= got or name == "mixing", name
        if name != "bpe_tokens":
            assert out.columns == list(corpus_pipeline.COLUMNS)
