"""All pairs inside groups of any size, without a row for each pair.

A group is dealt into chunks of bounded weight; a unit of work is a chunk with itself or with another one. A
unit returns one row for each member with links: how many (weighted by copies), and the smallest member it
is connected to inside the unit. The union of these forests over all units connects what the links connect.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, functions as F


def forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest index connected to each of 0 .. n - 1 by the links a[i] - b[i]."""
    root = np.arange(n)
    while len(a):
        low = np.minimum(root[a], root[b])
        before = root.copy()
        np.minimum.at(root, root[a], low)
        np.minimum.at(root, root[b], low)
        while (root[root] != root).any():
            root = root[root]
        if (root == before).all():
            break
        open_ = root[a] != root[b]
        a, b = a[open_], b[open_]
    return root


def linked_rows(ids: np.ndarray, copies: np.ndarray, a: np.ndarray, b: np.ndarray) -> dict[str, np.ndarray]:
    """Rows of a unit's result from its links (indices into ids, which ascend)."""
    n = np.zeros(len(ids), np.int64)
    np.add.at(n, a, copies[b])
    np.add.at(n, b, copies[a])
    root = forest(len(ids), a, b)
    have = np.flatnonzero(n)
    return {"node": ids[have], "other": ids[root[have]], "n": n[have]}


LINKED = "node long, other long, n long"


def deal(members: DataFrame, group: list[str], heaviest: list[tuple[str, float]]) -> DataFrame:
    """members with a column chunk: a hash of the group and, within it, of the member, so that a chunk stays
    near the given sums (column, most)."""
    sums = [F.sum(c).alias(f"_{i}") for i, (c, _) in enumerate(heaviest)]
    pieces = F.greatest(F.lit(1.0), *[F.col(f"_{i}") / F.lit(float(most)) for i, (_, most) in enumerate(heaviest)])
    totals = members.groupBy(*group).agg(*sums).select(*group, F.ceil(pieces).cast("long").alias("_pieces"))
    return (
        members.join(totals, group)
        .withColumn("chunk", F.xxhash64(*group, F.pmod(F.xxhash64("node", F.lit(17)), F.col("_pieces"))))
        .drop("_pieces")
    )


def with_units(chunks: DataFrame, pairs: DataFrame) -> DataFrame:
    """(unit, side, chunk): every chunk with itself (side 0 only), and every pair (c1 < c2) with both its sides."""
    alone = chunks.select(F.xxhash64("chunk", "chunk").alias("unit"), F.lit(0).alias("side"), "chunk")
    unit = F.xxhash64("c1", "c2").alias("unit")
    return alone.unionByName(
        pairs.select(unit, F.explode(F.array(F.struct(F.lit(1).alias("side"), F.col("c1").alias("chunk")), F.struct(F.lit(2).alias("side"), F.col("c2").alias("chunk")))).alias("x")).select("unit", "x.side", "x.chunk")
    )
