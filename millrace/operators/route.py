"""Routing items to paths by a computed index."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from millrace.operators.batch import batch_ids


def checked(route: Column, paths: int) -> Column:
    """The route; one outside 0 .. paths - 1, or null, fails the query, as it fails a pipeline."""
    bad = route.isNull() | (route < 0) | (route >= paths)
    return F.when(bad, F.raise_error(F.concat(F.lit("route out of range: "), F.coalesce(route.cast("string"), F.lit("null"))))).otherwise(route)


def route_values(df: DataFrame, route: Column, paths: Sequence[Callable[[DataFrame], Column]], name: str) -> DataFrame:
    """Paths that map one item to one: the route is computed once, each path is a branch of one expression; no
    union, one scan. Null results drop their rows."""
    if not paths:
        raise ValueError("routing needs at least one path")
    routed = df.withColumn("route", checked(route, len(paths)))
    value = reduce(lambda rest, ip: F.when(F.col("route") == ip[0], ip[1](routed)).otherwise(rest), reversed(list(enumerate(paths))), F.lit(None))
    return routed.withColumn(name, value).where(F.col(name).isNotNull())


def route_frames(df: DataFrame, route: Column, paths: Sequence[Callable[[DataFrame], DataFrame]]) -> DataFrame:
    """Paths of any shape: each transforms the rows routed to it; results are united."""
    if not paths:
        raise ValueError("routing needs at least one path")
    routed = df.withColumn("route", checked(route, len(paths)))
    return reduce(lambda a, b: a.unionByName(b), [p(routed.where(F.col("route") == i)) for i, p in enumerate(paths)])


def route_batched(df: DataFrame, n: int, order: Sequence[str], route: Column, paths: Sequence[Callable[[DataFrame], Column]], name: str) -> DataFrame:
    """Routing inside batches of n: results stand in order of path, then of place in the batch; batches of which nothing is
    left vanish. (batch_id, n, items)."""
    ids = route_values(batch_ids(df, n, order), route, paths, name)
    items = F.array_sort(F.collect_list(F.struct("route", "pos", F.col(name).alias("item"))))
    return ids.groupBy("batch_id").agg(F.count(F.lit(1)).alias("n"), F.transform(items, lambda x: x["item"]).alias("items"))
