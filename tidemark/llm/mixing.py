"""Mixing sources to target weights, with soft membership in domains.

The labelled table defines the domains (by default: toxic, low quality, high quality). One softmax model over hashed
n-grams gives every document a posterior over domains. Document rates, from low_d to MOST_RATE, are then the
least-squares solution of

    min  1/2 |sum_d r_d n_d p_d / N - t|^2 + RIDGE/2 sum_d (n_d / N) (r_d - 1)^2

for n_d tokens, posteriors p_d, N tokens in all and target weights t, so that the expected tokens of every domain
match its target, by rates as near to 1 as they can be. The gradient by the rates is n_d / N times p_d . (residual), so
projected-gradient steps that sum their gradients before they project leave every rate at 1 - p_d . x, cut to the
bounds, for one small vector x. A step adds to x the residual, preconditioned by the domains' Gram matrix over the rates
between the bounds, and is halved until it gains; steps go on until the gradient vanishes. A step is one aggregate over
(tokens, posterior) in built-in functions; no rate is moved or stored before the end.

low_d is 0. A domain can be named that is to stay whole: documents that are most likely of it have a low_d of 1, the
totals aimed at grow to hold them, and no other domain is aimed at more than the share it has: what is unwanted may be
thinned out, but is never repeated to reach a target. Targets that bounded rates can't meet give the nearest totals.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.quality_classifier import MOST_ROWS, features, fit_shards, probabilities, training_rows
from tidemark.llm.runtime import cut, drop_held
from tidemark.llm.textops import slices, text_bytes, words

DOMAINS = {"high": "quality = 1 and coalesce(toxic, 0) = 0", "low": "quality = 0 and coalesce(toxic, 0) = 0", "toxic": "toxic = 1"}
TARGETS = {"high": 0.90, "low": 0.07, "toxic": 0.03}
RIDGE = 1e-5
MOST_RATE = 8.0
NEAR_ENOUGH = 1e-7
MOST_STEPS = 200  # never reached in use: beyond it solve() fails rather than return what it has


def domain_model(docs: DataFrame, labels: DataFrame, domains: dict[str, str], id_col: str, text_col: str, most_rows: int = MOST_ROWS) -> np.ndarray:
    """A row of weights for every domain, learned on at most most_rows labelled rows, the least by a hash of the id."""
    y = F.array(*[F.expr(f"cast(coalesce({d}, false) as int)") for d in domains.values()])
    labelled = labels.select(F.col(id_col).alias("id"), y.alias("y")).where("aggregate(y, 0, (n, x) -> n + x) = 1")
    return fit_shards(training_rows(docs, labelled, id_col, text_col, most_rows), len(domains))


def memberships(docs: DataFrame, model: np.ndarray, names: list[str], id_col: str, text_col: str) -> DataFrame:
    """(id, n_tokens, posterior_<name>...) of every row: words, and the model's posterior."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    columns = [f"posterior_{d}" for d in names]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drop_held()
        for batch in batches:
            _, at = text_bytes(batch.column(1))
            for a, b in slices(at):
                part = batch.slice(a, b - a)
                raw, offsets = text_bytes(part.column(1))
                n = np.bincount(words(raw, offsets)[2], minlength=b - a)
                row, feature, value = features(raw, offsets)
                p = probabilities(np.stack([np.bincount(row, weights=m[feature] * value, minlength=b - a) for m in held.value], 1))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64()), *map(pa.array, np.ascontiguousarray(p.T))], names=["id", "n_tokens", *columns])

    fields = "".join(f", {c} double" for c in columns)
    return docs.select(id_col, text_col).mapInArrow(run, f"id {docs.schema[id_col].dataType.simpleString()}, n_tokens long" + fields)


def rate(posterior: list[Column], x: np.ndarray, low: Column | float = 0.0, most: float = MOST_RATE) -> Column:
    low = F.lit(float(low)) if isinstance(low, (int, float)) else low
    return F.greatest(low, F.least(F.lit(float(most)), 1.0 - sum((p * float(v) for p, v in zip(posterior, x, strict=True)), F.lit(0.0))))


def solve(members: DataFrame, names: list[str], targets: list[float], low: Column | float = 0.0, most: float = MOST_RATE) -> tuple[np.ndarray, np.ndarray]:
    """The vector x of the rates, and the domains' tokens at these rates by all tokens; members should be checkpointed."""
    k = len(names)
    goal = np.array(targets, float)
    p = [F.col(f"posterior_{d}") for d in names]
    tokens = float(members.agg(F.sum("n_tokens")).first()[0] or 0)
    if not tokens:
        return np.zeros(k), np.zeros(k)
    upper = [(i, j) for i in range(k) for j in range(i, k)]

    def at(x: np.ndarray) -> tuple[float, np.ndarray, np.ndarray, np.ndarray]:
        r, free, n = rate(p, x, low, most), rate(p, x, -np.inf, np.inf), F.col("n_tokens") / tokens
        # free is 1 - p . x: a document adds (r - 1)^2 / 2 + r p . x to the dual
        sums = [F.sum(n * ((r - 1) * (r - 1) / 2 + r * (1 - free))), *(F.sum(n * r * q) for q in p), *(F.sum(F.when(r == free, n * p[i] * p[j]).otherwise(0.0)) for i, j in upper)]
        got = np.array(members.agg(*[c.alias(f"s{i}") for i, c in enumerate(sums)]).first(), float)
        totals, gram = got[1 : k + 1], np.zeros((k, k))
        for (i, j), v in zip(upper, got[k + 1 :], strict=True):
            gram[i, j] = gram[j, i] = v
        return goal @ x + RIDGE / 2 * x @ x - got[0], goal - totals + RIDGE * x, gram, totals

    x = np.zeros(k)
    value, gradient, gram, totals = at(x)
    for _ in range(MOST_STEPS):
        if np.abs(gradient).max() < NEAR_ENOUGH:
            return x, totals
        move, size = -np.linalg.solve(gram + RIDGE * np.eye(k), gradient), 1.0
        while True:
            new = at(x + size * move)
            if new[0] <= value + 1e-4 * size * (gradient @ move) or size < 1e-6:
                break
            size /= 2
        x = x + size * move
        value, gradient, gram, totals = new
    raise RuntimeError(f"rates have not converged in {MOST_STEPS} steps: gradient {gradient}")


def aims(members: DataFrame, names: list[str], targets: list[float], whole: str | None, low: Column | float) -> list[float]:
    """Tokens of each domain to aim at, by all tokens."""
    goal = np.array(targets, float) / sum(targets)
    if whole is None:
        return goal.tolist()
    n = F.col("n_tokens")
    sums = members.agg(F.sum(n), *[F.sum(n * F.col(f"posterior_{d}") * r) for r in (F.lit(1.0), low) for d in names]).first()
    if not sums[0]:
        return goal.tolist()
    own, least = np.array(sums[1:], float).reshape(2, -1) / float(sums[0])
    at = names.index(whole)
    goal = np.minimum(goal, own)
    goal[at] = 0
    goal[at] = 1 - goal.sum()
    return (goal * max(1.0, least[at] / goal[at])).tolist()


def mix(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", domains: dict[str, str] | None = None, targets: dict[str, float] | None = None, row_col: str | None = None, whole: str | None = None, most: float = MOST_RATE) -> DataFrame:
    """(id, n_tokens, posterior_<domain>..., rate, share_<domain>..., target_<domain>...) of every row of docs.

    share_ is what the rates make of the expected tokens of a domain, as a share of all; target_ is the share aimed at,
    which is met wherever rates from 0 to `most` can meet it, and lowered for `whole` as the module says. A null or
    empty text has no tokens; its rate follows from the posterior that the model gives it. Without labels all posteriors
    are equal. An id with labels that differ does not count in training; rows that repeat count as often as they occur.
    Texts of any length count whole. Other columns are not read, but for row_col, which is returned as id where it is
    given. An empty table gives an empty one.
    """
    domains, targets = domains or DOMAINS, targets or TARGETS
    names = list(domains)
    members = cut(memberships(docs, domain_model(docs, labels, domains, id_col, text_col), names, row_col or id_col, text_col))
    p = [F.col(f"posterior_{d}") for d in names]
    low = (F.col(f"posterior_{whole}") >= F.greatest(*p)).cast("double") if whole else 0.0
    aim = aims(members, names, [targets[d] for d in names], whole, low)
    x, totals = solve(members, names, aim, low, most)
    share = lambda v, name: [F.lit(float(t / sum(v)) if sum(v) else 0.0).alias(f"{name}_{d}") for d, t in zip(names, v, strict=True)]
    return members.select("*", rate(p, x, low, most).alias("rate"), *share(totals, "share"), *share(aim, "target"))


def copies(rate: Column, id_: Column) -> Column:
    """Whole copies of a document for its rate: the rate rounded up or down by a hash of the id, right on average."""
    uniform = F.pmod(F.xxhash64(F.lit("mix"), id_), F.lit(1 << 30)) / float(1 << 30)
    return F.floor(rate + uniform).cast("int")


def op8_query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return mix(docs, labels).withColumnRenamed("id", "doc_id")
