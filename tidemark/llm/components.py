"""Connected components of a link table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.runtime import cut


def components(links: DataFrame, nodes: DataFrame) -> DataFrame:
    """(id, component_id): the least id that each node reaches over links (a, b).

    Alternates large-star and small-star steps, which need a number of rounds that is logarithmic in the
    longest chain. Only linked nodes take part; every round is checkpointed, and one number alone, the
    checksum of the edges, comes to the driver.
    """
    edges = cut(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    last = None
    while True:
        # large star: neighbours that are larger than the node link to its least neighbour
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.join(least, "a").where("b > a and b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        # small star: the node and its smaller neighbours link to the least of them
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).union(low.select("a", F.col("m").alias("b")))
        edges = cut(small.where("a <> b").distinct())
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(state) == last:
            break
        last = tuple(state)
    found = edges.groupBy("a").agg(F.min("b").alias("m"))
    return cut(nodes.join(found, nodes["id"] == found["a"], "left").select("id", F.coalesce("m", "id").alias("component_id")))
