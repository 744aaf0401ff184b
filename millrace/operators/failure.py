"""Failures: a failing item is dropped and counted; too many of them fail the pipeline.

The result is that of one task at a time, in the given order. `raise` fails the query; `truncate` keeps the items before
the breach, which a Spark action can't both deliver and fail on.
"""

from __future__ import annotations

from collections.abc import Sequence
from fractions import Fraction

from pyspark.sql import Column, DataFrame, Window, functions as F

from millrace.operators.position import with_pos

PROBATION = 100  # a rate is first looked at after so many invocations
BREACHED = "the limit of failures"


class PipelineFailure(RuntimeError):
    """Too many items failed."""


def breach(limit: int | Fraction, n: Column, failures: Column) -> Column:
    """Is the limit passed after n invocations? An integer allows that many failures, a negative one any number; a fraction
    in (0, 1] is a rate, exact in integers."""
    if isinstance(limit, Fraction):
        if not 0 < limit <= 1:
            raise ValueError("a rate must be above 0, and 1 at most")
        return (n >= PROBATION) & (failures * limit.denominator > n * limit.numerator)
    return failures > limit if limit >= 0 else F.lit(False)


def running(df: DataFrame, failed: Column, order: Sequence[str], calls: Column | None = None) -> DataFrame:
    """df with pos, failed, n (invocations so far) and failures (so far); calls: the invocations of a row, 1 if None.

    The running sum is taken in two steps as well: ranges of positions are summed, then rows within their range.
    """
    placed = with_pos(df, order).withColumn("failed", F.coalesce(failed.cast("boolean"), F.lit(True))).withColumn("_c", F.lit(1).cast("long") if calls is None else calls.cast("long"))
    placed = placed.withColumn("_block", F.floor(F.col("pos") / 65536))
    sums = placed.groupBy("_block").agg(F.sum(F.col("failed").cast("long")).alias("_s"), F.sum("_c").alias("_t"))
    before = Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("_block", F.coalesce(F.sum("_s").over(before), F.lit(0)).alias("_base"), F.coalesce(F.sum("_t").over(before), F.lit(0)).alias("_from"))  # one row for 65,536 items
    inside = Window.partitionBy("_block").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    out = placed.withColumn("_f", F.sum(F.col("failed").cast("long")).over(inside)).withColumn("_n", F.sum("_c").over(inside)).join(sums, "_block")
    return out.withColumn("n", F.col("_n") + F.col("_from")).withColumn("failures", F.col("_f") + F.col("_base")).drop("_block", "_f", "_base", "_n", "_from", "_c")


def shared(
    df: DataFrame, calls: Column, failed: Column, order: Sequence[str], limit: int | Fraction, *, before: DataFrame | None = None, on_breach: str = "raise"
) -> tuple[DataFrame, DataFrame]:
    """The rows up to a breach of a limit that several stages share, and the counters (n0, f0) after them, one row.

    A row stands for an item that went through `calls` stages, of which the last one failed if `failed`. before: counters that
    earlier stages left. Nothing runs here: with `raise`, the breach fails the action that reads the rows.
    """
    if on_breach not in ("raise", "truncate"):
        raise ValueError("on_breach must be 'raise' or 'truncate'")
    counted = running(df.withColumn("_calls", calls.cast("long")), failed, order, F.col("_calls"))
    start = before if before is not None else df.sparkSession.range(1).select(F.lit(0).cast("long").alias("n0"), F.lit(0).cast("long").alias("f0"))
    counted = counted.join(F.broadcast(start))
    n, f = F.col("n") + F.col("n0"), F.col("failures") + F.col("f0")
    over = breach(limit, n, f) & F.col("failed")
    if isinstance(limit, Fraction):
        # A rate may be passed at an invocation of the item that didn't fail, the first one that is looked at.
        first, had = F.greatest(n - F.col("_calls") + 1, F.lit(PROBATION)), f - F.col("failed").cast("long")
        over |= (first < n + F.when(F.col("failed"), 0).otherwise(1)) & breach(limit, first, had)
    at = counted.where(over).agg(F.min("pos").alias("_breach"))
    after = counted.agg(F.sum("_calls").alias("c"), F.sum(F.col("failed").cast("long")).alias("b")).join(F.broadcast(start))
    after = after.select((F.col("n0") + F.coalesce("c", F.lit(0))).alias("n0"), (F.col("f0") + F.coalesce("b", F.lit(0))).alias("f0"))
    gone = ("pos", "failed", "n", "failures", "n0", "f0", "_calls", "_breach")
    if on_breach == "truncate":
        kept = counted.join(F.broadcast(at)).where(~F.col("failed") & (F.col("_breach").isNull() | (F.col("pos") < F.col("_breach"))))
        return kept.drop(*gone), after
    # The breach is looked for in a branch of its own, which gives no row: it is run even where no item is left.
    kept = counted.where(~F.col("failed")).drop(*gone)
    message = F.concat(F.lit(f"{BREACHED} ({limit}) was passed at item "), F.col("_breach").cast("string"))
    # Its columns are some row's, not constants, by which the optimiser could tell that filters after it pass none.
    at = counted.where(over).agg(F.min("pos").alias("_breach"), *[F.first(c).alias(c) for c in kept.columns])
    guard = at.where(F.when(F.col("_breach").isNotNull(), F.raise_error(message).cast("boolean")).otherwise(False))
    return kept.unionByName(guard.drop("_breach")), after


def limited(df: DataFrame, failed: Column, order: Sequence[str], limit: int | Fraction, *, on_breach: str = "raise") -> DataFrame:
    """The items that didn't fail, up to a breach of the limit."""
    counted = running(df, failed, order)
    over = breach(limit, F.col("n"), F.col("failures"))
    first = counted.where(over).agg(F.min("pos").alias("_breach"))
    if on_breach == "raise":
        at = first.first()[0]
        if at is not None:
            raise PipelineFailure(f"the limit of failures ({limit}) was passed at item {at}")
        return counted.where(~F.col("failed"))
    if on_breach != "truncate":
        raise ValueError("on_breach must be 'raise' or 'truncate'")
    kept = counted.join(F.broadcast(first))
    return kept.where(~F.col("failed") & (F.col("_breach").isNull() | (F.col("pos") < F.col("_breach")))).drop("_breach")
