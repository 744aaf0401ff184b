"""Positions: order is data. Every order-based operator takes an explicit total order and derives `pos` from it once."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

SAMPLED = 50  # keys looked at for each bound between ranges


def _bounds(df: DataFrame, keys: list[str], n: int) -> list:
    """n - 1 or fewer rows of keys, in order, between which about equal numbers of rows lie. A bounded sample, drawn by hash."""
    drawn = df.select(*keys).withColumn("_drawn", F.xxhash64(*keys)).orderBy("_drawn").limit(SAMPLED * n).drop("_drawn")
    rows = drawn.distinct().orderBy(*keys).collect()
    return [rows[i * len(rows) // n] for i in range(1, n)] if len(rows) >= n else rows[1:]


def _not_above(ascending: Column, n: int, value: Column) -> Column:
    """How many of n ascending values are not above this one: as many comparisons as n has binary digits."""
    between = F.struct(F.lit(0).alias("low"), F.lit(n).alias("high"))

    def halved(x: Column, _: Column) -> Column:
        middle = F.shiftright(x["low"] + x["high"], 1)
        below = (x["low"] < x["high"]) & (F.get(ascending, middle) <= value)
        return F.struct(F.when(below, middle + 1).otherwise(x["low"]).alias("low"), F.when(below, x["high"]).otherwise(F.least(middle, x["high"])).alias("high"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(n.bit_length())), between, halved, lambda x: x["low"])


def with_pos(
    df: DataFrame,
    keys: str | Sequence[str],
    name: str = "pos",
    *,
    within: Sequence[str] = (),
    ranges: int | None = None,
) -> DataFrame:
    """df with the 0-based position of each row in the order of keys, nulls first.

    Within groups it is a window by group. Over the whole table, rows are dealt into ranges of all keys together, of whatever types,
    numbered inside their range, and shifted by the counts of the ranges before: no task sorts the whole table. The
    bounds are literals, so the result doesn't depend on how the work was scheduled; only rows equal in every key, whose order
    is open, can't be split.
    """
    keys = [keys] if isinstance(keys, str) else list(keys)
    if within:
        w = Window.partitionBy(*within).orderBy(*keys)
        return df.withColumn(name, (F.row_number().over(w) - 1).cast("long"))
    n = ranges or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    bounds = _bounds(df, keys, n) if n > 1 else []
    if not bounds:
        return df.withColumn(name, (F.row_number().over(Window.orderBy(*keys)) - 1).cast("long"))

    def literal(row) -> Column:
        return F.struct(*[F.lit(row[i]).cast(df.schema[k].dataType).alias(f"k{i}") for i, k in enumerate(keys)])

    own = F.struct(*[F.col(k).alias(f"k{i}") for i, k in enumerate(keys)])
    # A row's range: how many bounds are not above its keys, by binary search. Structs compare key by key, nulls first, as rows are sorted.
    dealt = df.withColumn("_range", _not_above(F.array(*[literal(b) for b in bounds]), len(bounds), own))
    counts = dealt.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    shift = counts.select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_shift"))  # one row for each range
    w = Window.partitionBy("_range").orderBy(*keys)
    numbered = dealt.withColumn(name, F.row_number().over(w).cast("long") - 1)
    return numbered.join(F.broadcast(shift), "_range").withColumn(name, F.col(name) + F.col("_shift")).drop("_range", "_shift")
