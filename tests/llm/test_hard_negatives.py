"""Hard negatives against plain loops: kernels, ties, odd rows, cells of all sizes, and a whole table."""

import math
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import hard_negatives as H

SF = "/root/testdata/sf0.01"
FIELDS = "vec_id long, embedding array<double>, label int, row string"


def plain(rows, is_anchor, scale=256.0, k=5, m=3, percent=(50, 95)):
    sound = [(i, [math.floor(scale * x) for x in v], y) for i, v, y in rows if i is not None and y is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    dot = lambda a, b: sum(x * y for x, y in zip(a, b, strict=False))
    out = []
    for n, (i, v, y) in enumerate(sound):
        if not is_anchor(i):
            continue
        others = sorted(((-dot(v, w), j, z == y) for q, (j, w, z) in enumerate(sound) if q != n), key=lambda t: t[:2])
        for s, j, _ in [o for o in others if o[2]][:k]:
            fit = [o for o in others if not o[2] and percent[0] * -s <= 100 * -o[0] <= percent[1] * -s][:m]
            out += [(i, j, r + 1, o[1], -s, -o[0]) for r, o in enumerate(fit)]
    return sorted(out)


def made(seed, n, dims, step=1 / 64):
    rng = random.Random(seed)
    return [(i, [rng.randrange(-40, 60) * step for _ in range(dims)], rng.choice([0, 0, 0, 1, 2])) for i in range(n)]


def run(spark, rows, **more):
    df = spark.createDataFrame([(*r, "x") for r in rows], FIELDS)
    return sorted(tuple(r) for r in H.hard_negatives(df, F.col("vec_id") % 10 == 0, **more).collect())


@pytest.mark.parametrize("kind", [np.int32, np.int64])
def test_scores_are_inner_products(kind):
    rng = np.random.default_rng(1)
    a, r = rng.integers(-300, 300, (9, 24)).astype(kind), rng.integers(-512, 512, (50, 24))
    assert (H.scores(H.subset_sums(a), H.planes(r, 10)) == a.astype(np.int64) @ r.T).all()


@pytest.mark.parametrize(("seed", "dims"), [(1, 8), (2, 5), (3, 17)])
def test_random_rows(spark, seed, dims):
    rows = made(seed, 150, dims)
    want = plain(rows, lambda i: i % 10 == 0)
    assert run(spark, rows) == want and len(want) > 20


def test_ties_and_few_distinct_vectors(spark):
    rng = random.Random(4)
    rows = [(i, rng.choice([[0.5, 0.25], [0.25, 0.25], [0.5, 0.0], [0.0, 0.0], [-0.5, 0.1]]), rng.randrange(3)) for i in range(200)]
    assert run(spark, rows) == plain(rows, lambda i: i % 10 == 0)
    assert run(spark, rows, n_positives=2, n_negatives=7, percent=(10, 100)) == plain(rows, lambda i: i % 10 == 0, k=2, m=7, percent=(10, 100))


def test_odd_rows(spark):
    rows = [(0, [0.5, None], 1), (10, [float("nan"), 0.1], 1), (20, [float("inf"), 0.1], 1), (30, None, 1), (40, [0.5, 0.5], None), (None, [0.5, 0.5], 1), (50, [], 1), (60, [0.5], 1), (61, [0.5, 0.25], 1), (62, [0.4, 0.1, 0.3], 2), (70, [0.5, 0.5], 2), (70, [0.5, 0.5], 2), (70, [0.4, 0.5], 1)]
    want = plain(rows, lambda i: i % 10 == 0)
    assert run(spark, rows) == want and want
    assert run(spark, []) == [] and run(spark, rows[:6]) == [] and run(spark, [(1, [0.5], 1), (2, [0.5], 2)]) == []
    with pytest.raises(ValueError):
        run(spark, [(0, [1e10], 1)])


def test_many_cells_give_the_same(spark, monkeypatch):
    rows = made(5, 240, 8)
    for name, value in (("BLOCK", 7), ("CHUNK", 50), ("LEAST_CHUNK", 20), ("TILE_ROWS", 16), ("TILE_ANCHORS", 3)):
        monkeypatch.setattr(H, name, value)
    assert run(spark, rows) == plain(rows, lambda i: i % 10 == 0)


def test_whole_table(spark):
    rows = [(r.vec_id, None if r.embedding is None else list(r.embedding), None if r.label is None else (r.label + 1) % 10 if r.vec_id % 7 == 0 else r.label) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    got = sorted(tuple(r) for r in H.op13_query(spark, SF).collect())
    assert got == plain(rows, lambda i: i % 50 == 0) and got
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from '{SF}/embeddings.parquet'")
    assert got == sorted(con.execute(H.OP13_SQL).fetchall())
