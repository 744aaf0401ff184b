"""Samplers, shuffles, repeats and caches: indices are computed on the driver by seeded generators and joined by position."""

from __future__ import annotations

import random
import warnings
from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame, functions as F

from millrace.operators.position import with_pos


def _shard_size(n: int, rank: int, world_size: int, drop_last: bool) -> int:
    if n <= 0:
        raise ValueError("there must be something to sample")
    if not 0 <= rank < world_size:
        raise ValueError("rank must be below world_size, and not negative")
    if drop_last and n < world_size:
        raise ValueError("fewer items than ranks")
    if drop_last and n % world_size:
        warnings.warn(f"the last {n % world_size} of {n} items go to no rank", stacklevel=3)
    return n // world_size * world_size if drop_last else n


def deterministic_shard(df: DataFrame, order: Sequence[str], *, rank: int, world_size: int, drop_last: bool = True) -> DataFrame:
    """Every world_size-th item from the rank's on, with pos. drop_last leaves out the tail that not all ranks share."""
    total = _shard_size(df.count(), rank, world_size, drop_last)
    return with_pos(df, order).where((F.col("pos") % world_size == rank) & (F.col("pos") < total))


def random_indices(
    n: int, *, rank: int, world_size: int, num_draws: int | None = None, weights: Sequence[float] | None = None, seed: int = 0, drop_last: bool = True
) -> list[int]:
    """The rank's share of one global draw, the same on all ranks: without replacement, or with it by weights."""
    draws = n if num_draws is None else num_draws
    total = _shard_size(draws, rank, world_size, drop_last)
    p = None
    if weights is not None:
        w = np.asarray(weights, float)
        if len(w) != n or not np.isfinite(w).all() or (w < 0).any() or not w.sum():
            raise ValueError("weights must be finite, not negative, one for each item, and not all 0")
        p = w / w.sum()
    elif draws > n:
        raise ValueError("more draws than items, without replacement")
    return np.random.default_rng(seed).choice(n, size=total, replace=p is not None, p=p)[rank::world_size].tolist()


def take(df: DataFrame, order: Sequence[str], indices: Sequence[int], draw: str = "draw_no") -> DataFrame:
    """The items at these positions, as often as named; draw is the place in the list of indices. The table of
    indices is as long as the draw; whether it is broadcast is left to the planner's size limit."""
    table = df.sparkSession.createDataFrame(list(enumerate(map(int, indices))), f"{draw} long, pos long")
    return with_pos(df, order).join(table, "pos")


def permutation(n: int, seed: int) -> list[int]:
    """The order of a list of n after a seeded shuffle."""
    out = list(range(n))
    random.Random(seed).shuffle(out)
    return out


def cumulative_permutation(n: int, seeds: Sequence[int]) -> list[int]:
    """Shuffles in place, one after the other: each permutes what the one before left."""
    out = list(range(n))
    for s in seeds:
        random.Random(s).shuffle(out)
    return out


def shuffled_epochs(df: DataFrame, order: Sequence[str], epochs: int, *, epoch: int = 0, shuffle_last: bool = False) -> DataFrame:
    """Passes over the items, each in the order that its number, as the seed, gives: columns epoch and draw_no.
    A shuffle with a seed doesn't depend on the passes before. With shuffle_last, a pass ends with the shuffle for the next one, so
    that the first has the items' own order, and pass e that of seed e - 1."""
    n = df.count()
    rows = [(e, d, i) for e in range(epoch, epoch + epochs) for d, i in enumerate(_pass(n, e, epoch, shuffle_last))]
    table = df.sparkSession.createDataFrame(rows, "epoch long, draw_no long, pos long")
    return with_pos(df, order).join(table, "pos")


def _pass(n: int, e: int, first: int, shuffle_last: bool) -> Sequence[int]:
    if not shuffle_last:
        return permutation(n, e)
    return range(n) if e == first else permutation(n, e - 1)


def shuffled(df: DataFrame, keys: Sequence[str], seed: int, *, epochs: int = 1) -> DataFrame:
    """Passes over the items in an order drawn by a keyed hash: columns epoch and draw_no. Made on the executors, for tables of any size:
    no list of positions is as long as the table. Another order than permutation's, but the same in every run; rows equal in all keys
    are interchangeable."""
    out = None
    for e in range(epochs):
        drawn = df.withColumn("_h", F.xxhash64(*keys, F.lit(seed), F.lit(e))).withColumn("epoch", F.lit(e).cast("long"))
        drawn = with_pos(drawn, ["_h", *keys], "draw_no").drop("_h")
        out = drawn if out is None else out.unionByName(drawn)
    if out is None:
        raise ValueError("there must be an epoch")
    return out


def repeated(df: DataFrame, order: Sequence[str], n: int) -> DataFrame:
    """The first n items of an endless repetition: columns epoch and pos, out_pos in the result."""
    size = df.count()
    if not size:
        raise ValueError("an empty source can't be repeated")
    epochs = -(-n // size)
    passes = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(max(0, epochs - 1)).cast("long"))).alias("epoch")
    out = with_pos(df, order).select("*", passes).withColumn("out_pos", F.col("epoch") * size + F.col("pos"))
    return out.where(F.col("out_pos") < n)


def cached_indices(n: int, num_caches: int, *, return_caches_after: int | None = None, stop_after: int) -> list[int]:
    """Positions of the items that a cache gives: the first ones fresh, then those cached, over and over."""
    run_for = num_caches if return_caches_after is None else return_caches_after
    if run_for < num_caches or stop_after < num_caches:
        raise ValueError("return_caches_after and stop_after must not be below num_caches")
    c = min(run_for, n)
    m = min(num_caches, c)
    if m == 0:
        raise ValueError("nothing was cached, so nothing would ever be returned")
    return [p if p < c else (p - c) % m for p in range(stop_after)]


def cached(df: DataFrame, order: Sequence[str], num_caches: int, *, return_caches_after: int | None = None, stop_after: int) -> DataFrame:
    """cache_iterator as a join by position: out_pos is the position in the result. The table of outputs is made on the executors."""
    n = df.count()
    run_for = num_caches if return_caches_after is None else return_caches_after
    cached_indices(n, num_caches, return_caches_after=return_caches_after, stop_after=num_caches)
    if stop_after < num_caches:
        raise ValueError("stop_after must not be below num_caches")
    c = min(run_for, n)
    m = min(num_caches, c)
    out = df.sparkSession.range(stop_after).select(F.col("id").alias("out_pos"), F.when(F.col("id") < c, F.col("id")).otherwise((F.col("id") - c) % m).alias("pos"))
    return with_pos(df, order).join(out, "pos")
