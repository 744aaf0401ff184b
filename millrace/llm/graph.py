"""Connected components on the executors: large-star and small-star rounds over a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from millrace.llm.store import cut, drop


def _print_of(edges: DataFrame) -> tuple:
    row = edges.agg(
        F.count(F.lit(1)).alias("n"),
        F.bit_xor(F.xxhash64("u", "v")).alias("x"),
    ).first()
    return row["n"], row["x"]


def _star(pairs: DataFrame, large: bool) -> DataFrame:
    """One star operation. pairs holds (u, v) with u > v."""
    if large:
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        both = pairs
    # The minimum of every neighbourhood is a table of its own, so that the join below has a plain
    # exchange on both sides and a hub's edges can be split at run time.
    least = cut(
        both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")),
        "cc-least",
    )
    joined = both.join(least, "u")
    if large:
        out = joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
            least.select("u", F.col("m").alias("v"))
        )
    result = cut(out.where("u <> v").distinct(), "cc-star")
    drop(least)
    return result


def connected_components(edges: DataFrame, label: str = "cc") -> DataFrame:
    """(node, root) for every node of an undirected edge table (a long, b long); root is the smallest node.

    Nodes without an edge do not appear. Self-loops, repeated edges and either direction are fine; an empty
    table gives an empty result. Every round is a pair of joins and aggregations; nothing is collected but
    one row with a count and a checksum, by which the end is recognised.
    """
    pairs = cut(
        edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(),
        f"{label}-edges",
    )
    seen = _print_of(pairs)
    while seen[0]:
        wide = _star(pairs, large=True)
        narrow = _star(wide, large=False)
        now = _print_of(narrow)
        drop(pairs, wide)
        pairs = narrow
        if now == seen:
            break
        seen = now
    return pairs.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        pairs.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    )
