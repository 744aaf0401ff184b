"""Merging sources: as a bag, one after the other, in turns, by weight, by priority, and by epoch."""

from __future__ import annotations

import random
from collections.abc import Iterator, Sequence
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from millrace.operators.position import with_pos

PICKS = 10_000  # picks of a weighted merge in a batch


def bag(sources: Sequence[DataFrame]) -> DataFrame:
    """All items of all sources; no order is promised and nothing is deduplicated."""
    if not sources:
        raise ValueError("there is nothing to merge")
    if len({s.isStreaming for s in sources}) > 1:
        raise ValueError("continuous and finite sources can't be merged")
    return reduce(lambda a, b: a.unionByName(b), sources)


def placed(sources: Sequence[DataFrame], orders: Sequence[Sequence[str]]) -> DataFrame:
    """The union with src (number of the source) and k (position in it)."""
    return bag([with_pos(s, o, "k").withColumn("src", F.lit(i)) for i, (s, o) in enumerate(zip(sources, orders, strict=True))])


def concat(sources: Sequence[DataFrame], orders: Sequence[Sequence[str]]) -> DataFrame:
    """One source after the other: pos is the position in the result."""
    return with_pos(placed(sources, orders), ["src", "k"])


def round_robin(sources: Sequence[DataFrame], orders: Sequence[Sequence[str]], stop_after: int = 0) -> DataFrame:
    """An item of each source in turn. stop_after 0: until all are exhausted; n: after n items; -1: when a source whose
    turn it is has none left. The result's position is pos.

    Item k of source i comes at (k, i). The first source found exhausted is the one with the smallest (length, number).
    """
    both = placed(sources, orders)
    if stop_after < 0:
        # Lengths of all sources, empty ones too: a row each.
        lengths = bag([s.agg(F.count(F.lit(1)).alias("k_end")).withColumn("src_end", F.lit(i)) for i, s in enumerate(sources)])
        end = lengths.agg(F.min(F.struct("k_end", "src_end")).alias("end"))
        both = both.join(F.broadcast(end)).where(F.struct("k", "src") < F.col("end")).drop("end")
    out = with_pos(both, ["k", "src"])
    return out.where(F.col("pos") < stop_after) if stop_after > 0 else out


def picks(weights: Sequence[float], seed: int) -> Iterator[int]:
    """The sources picked, one after the other: blocks of 100 weighted choices of a seeded generator; they don't depend on the data."""
    rng = random.Random(seed)
    while True:
        yield from rng.choices(range(len(weights)), weights=weights, k=100)


def weighted(
    sources: Sequence[DataFrame],
    orders: Sequence[Sequence[str]],
    weights: Sequence[float],
    *,
    stop_after: int = 0,
    seed: int = 0,
) -> DataFrame:
    """Items in the order of weighted picks. Sources of weight 0 are left out first. Item j of a source comes at the
    (j + 1)-th pick of it; picks of exhausted sources give nothing. stop_after as for round_robin.

    The generator is serial, so one task draws the table of picks, PICKS at a time, as a stream: it holds no list of them, and the
    driver sees none.
    """
    if len(weights) != len(sources) or any(w < 0 for w in weights) or not any(weights):
        raise ValueError("each source needs a weight, none negative and not all 0")
    chosen = [i for i, w in enumerate(weights) if w]
    sources, orders, weights = [sources[i] for i in chosen], [orders[i] for i in chosen], [weights[i] for i in chosen]
    lengths = [s.count() for s in sources]
    target = sum(lengths) if stop_after <= 0 else min(stop_after, sum(lengths))

    def draw(_) -> Iterator[pa.RecordBatch]:
        taken, chosen = [0] * len(lengths), picks(weights, seed)
        done, over = 0, not target
        while not over:
            source, place = [], []
            while len(source) < PICKS:
                p = next(chosen)
                if taken[p] < lengths[p]:
                    source.append(p)
                    place.append(taken[p])
                    taken[p] += 1
                elif stop_after < 0:
                    over = True
                if over := over or done + len(source) == target:
                    break
            columns = [pa.array(range(done, done + len(source)), pa.int64()), pa.array(source, pa.int32()), pa.array(place, pa.int64())]
            done += len(source)
            yield pa.RecordBatch.from_arrays(columns, names=["pos", "src", "k"])

    order = sources[0].sparkSession.range(0, 1, 1, 1).mapInArrow(draw, "pos long, src int, k long")
    return placed(sources, orders).join(order, ["src", "k"])


def by_priority(df: DataFrame, priority: str, sequence: str) -> DataFrame:
    """The order of a queue that hands out the smallest priority first, and equal ones as they came."""
    return with_pos(df, [priority, sequence])


def by_epoch(sources: Sequence[DataFrame], epoch: str) -> DataFrame:
    """A merge that waits for all sources at each epoch's end: (epoch, src, items) one row for each source in each epoch."""
    tagged = bag([s.withColumn("src", F.lit(i)) for i, s in enumerate(sources)])
    return tagged.groupBy(epoch, "src").agg(F.count(F.lit(1)).alias("items"))
