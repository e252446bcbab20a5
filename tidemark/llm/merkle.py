"""Document fingerprints: a Merkle tree over paragraphs and sections, in built-in functions alone.

Paragraphs are the lines of a text with the line breaks after them. A paragraph's leaves are its phrases of up to
eight words, with the white space that follows, so leaves joined give the text back. A section is a run of
paragraphs up to a blank line, or to one whose digest ends in 0, so an edit moves the bounds of its own section only.
Every node is the SHA-256 of its children's SHA-256 digests in order, and the root is that of the sections: equal
roots mean equal leaves, and so equal texts.

A fingerprint is the text `root:sections:paragraphs:leaves`: the root in full, then 8 hex digits of each node, for
sections and paragraphs with the number of their children. Where roots differ, locate_edits descends the tree by
the branches that differ. Two fingerprints are alike by the share of their distinct leaves that they have in common.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.runtime import shuffle_partitions

PHRASE = r"(?:[^ \t\n]++[ \t]*+){1,8}+\n*+|[ \t\n]++"
#: Over digests that are each followed by a mark: = before a blank line, - at the end of a line, . elsewhere.
PARAGRAPH = r"(?:[0-9a-f]{64}\.)*+[0-9a-f]{64}[-=]|(?:[0-9a-f]{64}\.)++"
SECTION = r"(?:[0-9a-f]{63}[1-9a-f][-.])*+(?:[0-9a-f]{64}[-=.])?+"


def _mark(phrase: Column) -> Column:
    return F.when(phrase.contains("\n\n"), "=").when(phrase.contains("\n"), "-").otherwise(".")


def _nodes(children: Column, pattern: str) -> Column:
    """Of joined marked digests, the runs that are nodes."""
    return F.filter(F.regexp_extract_all(children, F.lit(pattern), 0), lambda x: x != "")


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with the value computed once: inside higher-order functions every mention of an expression is computed anew."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def fingerprint(text: Column) -> Column:
    """`root:sections:paragraphs:leaves` of a text of any length; null counts as the empty text, which has no nodes but the root."""
    text = F.coalesce(text, F.lit(""))
    phrases = F.regexp_extract_all(text, F.lit(PHRASE), 0)
    marked = lambda nodes, end: F.array_join(F.transform(nodes, lambda x: F.left(x, F.lit(end))), "")
    short = lambda nodes, count: F.array_join(F.transform(nodes, lambda x: F.concat(F.left(x, F.lit(8)), F.substring(x, F.lit(count), F.lit(12)))), ",")

    def nodes(children: Column, pattern: str, mark: bool = False) -> Column:
        """Digest, mark where there is one, and number of children of every node."""
        return F.transform(_nodes(children, pattern), lambda x: F.concat(F.sha2(x, 256), *([F.right(x, F.lit(1))] if mark else []), (F.length(x) / 65).cast("int").cast("string")))

    def joined(leaves: Column, lines: Column, parts: Column) -> Column:
        return F.concat_ws(":", F.sha2(marked(parts, 64), 256), short(parts, 65), short(lines, 66), marked(leaves, 8))

    def of_lines(leaves: Column, lines: Column) -> Column:
        return _once(nodes(marked(lines, 65), SECTION), lambda parts: joined(leaves, lines, parts))

    def of_leaves(leaves: Column) -> Column:
        return _once(nodes(F.array_join(leaves, ""), PARAGRAPH, mark=True), lambda lines: of_lines(leaves, lines))

    return _once(F.transform(phrases, lambda p: F.concat(F.sha2(p, 256), _mark(p))), of_leaves)


def root(fp: Column) -> Column:
    return F.substring_index(fp, ":", 1)


def leaves(fp: Column) -> Column:
    """Digests of the leaves of a fingerprint."""
    return F.regexp_extract_all(F.substring_index(fp, ":", -1), F.lit("[0-9a-f]{8}"), 0)


def inner(fp: Column, level: int) -> Column:
    """Nodes of level 1 (sections) or 2 (paragraphs): array of (digest, children)."""
    nodes = F.filter(F.split(F.element_at(F.split(fp, ":"), level + 1), ","), lambda x: x != "")
    return F.transform(nodes, lambda x: F.struct(F.left(x, F.lit(8)).alias("digest"), F.substring(x, 9, 12).cast("int").alias("children")))


def likeness(a: Column, b: Column) -> Column:
    """0 to 1: twice the distinct leaves in both, over those of each; 1 where the roots are equal."""

    def share(x: Column, y: Column) -> Column:
        n = F.size(x) + F.size(y)
        return F.when(n > 0, 2.0 * F.size(F.array_intersect(x, y)) / n).otherwise(0.0)

    distinct = lambda fp: F.array_distinct(leaves(fp))
    return F.when(root(a) == root(b), 1.0).otherwise(_once(distinct(a), lambda x: _once(distinct(b), lambda y: share(x, y))))


def _alone(nodes: DataFrame) -> DataFrame:
    """The nodes (id, side, place, digest...) without a partner on the other side: of equal ones, the first are partners."""
    nth = Window.partitionBy("id", "side", "digest").orderBy("place")
    sides = Window.partitionBy("id", "digest", "nth")
    return nodes.withColumn("nth", F.row_number().over(nth)).withColumn("sides", F.count("*").over(sides)).where("sides = 1").drop("nth", "sides")


def locate_edits(pairs: DataFrame, id_col: str, a_col: str, b_col: str) -> DataFrame:
    """(id, side, section, paragraph) of every paragraph of fingerprint a or b that the other side lacks; side is 'a' or 'b'.

    Places are 0-based; paragraphs are counted over the whole text. The descent goes from roots that differ to the
    sections without a partner, and to the paragraphs of those alone; a paragraph that occurs more often on one
    side has its later occurrences listed. Pairs with equal roots, or a null fingerprint, have no rows. Ids should
    be distinct; other columns are not read. Moving whole sections or paragraphs is no edit.
    """
    differ = pairs.select(F.col(id_col).alias("id"), F.col(a_col).alias("a"), F.col(b_col).alias("b")).where(root(F.col("a")) != root(F.col("b")))
    sides = differ.select("id", F.explode(F.array(*[F.struct(F.lit(s).alias("side"), F.col(s).alias("fp")) for s in "ab"])).alias("x")).select("id", "x.*")
    sections = inner(F.col("fp"), 1)
    first = F.transform(sections, lambda x, i: F.aggregate(F.slice(F.transform(sections, lambda y: y["children"]), 1, i), F.lit(0), lambda n, y: n + y))
    placed = F.arrays_zip(sections.alias("node"), first.alias("first"))
    rows = sides.select("id", "side", "fp", F.posexplode(placed).alias("place", "x")).select("id", "side", "fp", "place", "x.node.digest", "x.node.children", "x.first")
    inside = F.slice(inner(F.col("fp"), 2), F.col("first") + 1, F.col("children"))
    lines = _alone(rows).select("id", "side", F.col("place").alias("section"), "first", F.posexplode(inside).alias("at", "node"))
    found = _alone(lines.select("id", "side", "section", (F.col("first") + F.col("at")).alias("place"), "node.digest"))
    return found.select("id", "side", "section", F.col("place").alias("paragraph"))


def _range_of(value: Column, bounds: list[int]) -> Column:
    """How many of the sorted bounds are below the value, found in two steps of about sqrt(n) comparisons."""
    if not bounds:
        return F.lit(0)
    width = max(1, int(len(bounds) ** 0.5))
    groups = [bounds[i : i + width] for i in range(0, len(bounds), width)]
    below = lambda a: F.size(F.filter(a, lambda x: x < value))
    full = below(F.array(*[F.lit(g[-1]) for g in groups]))
    rest = F.get(F.array(*[F.array(*map(F.lit, g)) for g in groups]), full)
    return full * width + F.coalesce(below(rest), F.lit(0))


def with_next(rows: DataFrame, id_col: str, columns: list[str], ranges: int | None = None) -> DataFrame:
    """rows with `next_<column>` of the row that follows in order of the id; the first row follows the last.

    Ids are cut at quantiles into ranges, one shuffle brings each range together, and the first row of a range
    is also sent to the range before, as the one that follows its last row. Only the bounds and first ids,
    one for each range, come to the driver. A null id comes first; rows with one id are in the order of a hash of
    their columns. A column that is called as one of those added gives way to it. An empty table stays empty.
    """
    rows = rows.drop("_place", "_key", "_to", *[f"next_{c}" for c in columns])
    n = ranges or 4 * shuffle_partitions(rows.sparkSession)
    key = F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63)))
    bounds = rows.agg(F.percentile_approx(key, [i / n for i in range(1, n)], 10 * n)).first()[0] if n > 1 else None
    place = _range_of(key, sorted(set(bounds or [])))
    first = {r.place: r.first for r in rows.select(place.alias("place"), key.alias("k")).groupBy("place").agg(F.min("k").alias("first")).collect()}
    if not first:
        return rows.select("*", *[F.lit(None).cast(rows.schema[c].dataType).alias(f"next_{c}") for c in columns])
    order = sorted(first)
    before = {p: order[i - 1] for i, p in enumerate(order)}
    at = lambda d: F.get(F.array(*[F.lit(d.get(i)).cast("long") for i in range(order[-1] + 1)]), F.col("_place"))
    dealt = rows.withColumn("_place", place).withColumn("_key", key)
    guest = F.struct(at(before).alias("place"), F.lit(1).alias("guest"))
    home = F.struct(F.col("_place").cast("long").alias("place"), F.lit(0).alias("guest"))
    dealt = dealt.withColumn("_to", F.explode(F.when(F.col("_key") == at(first), F.array(home, guest)).otherwise(F.array(home))))
    w = Window.partitionBy("_to.place").orderBy("_to.guest", "_key", F.xxhash64(*columns))
    out = dealt.select("*", *[F.lead(c).over(w).alias(f"next_{c}") for c in columns])
    return out.where("_to.guest = 0").drop("_place", "_key", "_to")


def op4_query(spark, sf_dir: str) -> DataFrame:
    """Fingerprints of documents and of their edited texts. A null text is empty; the only document is its own next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = with_next(docs.withColumn("fingerprint", fingerprint(F.col("text"))), "doc_id", ["text", "fingerprint"])
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    rows = rows.withColumn("n_chars", n.cast("long")).withColumn("edited", F.concat(F.substring("text", F.lit(1), n - half), F.substring("next_text", F.lit(1), half)))
    rows = rows.withColumn("edited_fingerprint", fingerprint(F.col("edited")))
    return rows.select(
        "doc_id",
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        "fingerprint",
        "edited_fingerprint",
        likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"),
        likeness(F.col("fingerprint"), F.col("next_fingerprint")).alias("near_next"),
    )
