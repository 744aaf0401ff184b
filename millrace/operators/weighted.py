"""Weighted draws made on the executors: no list of items, weights or draws is as long as the table on the driver.

Uniform numbers are digits of an MD5 of the seed and a key, so that a draw is the same in every run, on every cluster and in any SQL engine. (The
seeded generators of operators.sample give another draw, item by item that of a generator on the driver.)
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from millrace.operators.position import with_pos

BITS = 52


def uniform(seed: int, *keys: Column) -> Column:
    """A number in (0, 1) by the seed and the keys."""
    text = F.concat_ws(":", F.lit(str(seed)), *[k.cast("string") for k in keys])
    return (F.conv(F.substring(F.md5(text.cast("binary")), 1, BITS // 4), 16, 10).cast("double") + 0.5) / float(1 << BITS)


def _checked(weight: Column) -> Column:
    w = weight.cast("double")
    return F.when(w.isNull() | F.isnan(w) | (w < 0) | (w == float("inf")), F.raise_error(F.lit("weights must be finite and not negative"))).otherwise(w)


def _shard(rank: int, world_size: int, num_draws: int, drop_last: bool) -> int:
    if not 0 <= rank < world_size:
        raise ValueError("rank must be below world_size, and not negative")
    if num_draws <= 0:
        raise ValueError("num_draws must be positive")
    if drop_last and num_draws < world_size:
        raise ValueError("fewer draws than ranks")
    return num_draws // world_size * world_size if drop_last else num_draws


def without_replacement(
    df: DataFrame, keys: Sequence[str], weight: str, num_draws: int, *, rank: int = 0, world_size: int = 1, seed: int = 0, drop_last: bool = True
) -> DataFrame:
    """The rank's share of a draw of num_draws different items by weight, the same draw on all ranks: df with draw_no, the place in the draw.

    Each item gets an exponential key, -ln(u) / weight, and the smallest keys are drawn, in their order: that is the distribution of drawing
    one after the other. Items of weight 0 are never drawn; where fewer others are there, the draw is shorter. keys must tell the items apart.
    """
    total = _shard(rank, world_size, num_draws, drop_last)
    drawn = df.withColumn("_w", _checked(F.col(weight))).where("_w > 0").withColumn("_e", -F.ln(uniform(seed, *[F.col(k) for k in keys])) / F.col("_w"))
    first = drawn.orderBy("_e", *keys).limit(total) if total <= 10_000 else drawn  # a heap in each task, instead of an order of all of them
    placed = with_pos(first, ["_e", *keys], "draw_no")
    return placed.where((F.col("draw_no") < total) & (F.col("draw_no") % world_size == rank)).drop("_w", "_e")


def with_replacement(
    df: DataFrame, keys: Sequence[str], weight: str, num_draws: int, *, rank: int = 0, world_size: int = 1, seed: int = 0, drop_last: bool = True, block: int = 1 << 16
) -> DataFrame:
    """The rank's share of num_draws independent draws by weight, the same on all ranks: df once for each draw of it, with draw_no.

    Items lie one after the other on a line, each as long as its weight; a draw is a point on it. Weights are rounded to 2^-40 of the largest and
    added up exactly. The line is cut into stretches, as many as there are items or draws, whichever is more: an item is in each stretch
    it reaches into, so a heavy one is spread over many; a draw meets the items of its stretch only.
    """
    total = _shard(rank, world_size, num_draws, drop_last)
    spark = df.sparkSession
    checked = df.withColumn("_w", _checked(F.col(weight)))
    n, most = checked.agg(F.count(F.lit(1)), F.max("_w")).first()
    if not most:
        raise ValueError("some weight must be above 0")
    units = checked.withColumn("_u", F.round(F.col("_w") / most * float(1 << 40)).cast("decimal(38,0)")).drop("_w")
    placed = with_pos(units, keys, "_pos").withColumn("_block", F.floor(F.col("_pos") / block))
    sums = placed.groupBy("_block").agg(F.sum("_u").cast("decimal(38,0)").alias("_sum"))
    blocks = Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)  # a row for `block` items
    zero = F.lit(0).cast("decimal(38,0)")
    sums = sums.select("_block", F.coalesce(F.sum("_sum").over(blocks), zero).cast("decimal(38,0)").alias("_before"))
    inside = Window.partitionBy("_block").orderBy("_pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    line = placed.withColumn("_run", F.sum("_u").over(inside).cast("decimal(38,0)")).join(sums, "_block").where("_u > 0")
    line = line.withColumn("_to", (F.col("_run") + F.col("_before")).cast("decimal(38,0)")).withColumn("_from", (F.col("_to") - F.col("_u")).cast("decimal(38,0)"))
    length = int(units.agg(F.sum("_u")).first()[0])
    width = max(1, length // max(n, total))
    stretch = lambda x: F.floor(x.cast("double") / float(width)).cast("long")  # noqa: E731  the same rounding on both sides, and monotone
    items = line.select(*df.columns, "_from", "_to", F.explode(F.sequence(stretch(F.col("_from")), stretch(F.col("_to")))).alias("_stretch"))
    draws = spark.range(total).where(F.col("id") % world_size == rank).select(F.col("id").alias("draw_no"))
    draws = draws.withColumn("_x", F.least(F.floor(uniform(seed, F.col("draw_no")) * float(length)).cast("decimal(38,0)"), F.lit(length - 1).cast("decimal(38,0)")))
    draws = draws.withColumn("_stretch", stretch(F.col("_x")))
    return draws.join(items, "_stretch").where("_from <= _x and _x < _to").select("draw_no", *df.columns)
