"""Places of rows within groups of any size: no group is one task's work."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from millrace.llm.store import cut


def numbered(rows: DataFrame, group: Sequence[str], order: Sequence[str], label: str, name: str = "idx", size: str = "size") -> DataFrame:
    """rows with their 0-based place in their group, in the order of these columns (nulls first), and the group's size.

    Rows are dealt into ranges of group and order together and sorted there; the sorted table is written once, with a number that ascends
    over ranges and rows. A range has a share of one or a few groups: how many rows of each, and where they begin, gives the shift from those numbers
    to places. So a group of a third of all rows is spread over a third of the ranges. Group columns must not be null. Rows that
    are equal in all these columns are in one range, in any order.
    """
    group = list(group)
    ranged = rows.repartitionByRange(*group, *order).sortWithinPartitions(*group, *order).withColumn("_at", F.monotonically_increasing_id())
    ranged = cut(ranged, label).withColumn("_range", F.shiftright("_at", 33))
    runs = ranged.groupBy(*group, "_range").agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_first"))
    ranges = Window.partitionBy(*group).orderBy("_range")  # a row of each range that the group reaches
    before = F.coalesce(F.sum("_n").over(ranges.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    everything = F.sum("_n").over(ranges.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    shifts = runs.select(*group, "_range", (before - F.col("_first")).alias("_shift"), everything.alias(size))
    return ranged.join(shifts, [*group, "_range"]).withColumn(name, F.col("_at") + F.col("_shift")).drop("_at", "_range", "_shift")
