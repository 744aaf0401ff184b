"""Map, filter, flat-map, lookup and limit. A null result drops its row: nulls never flow between stages."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, functions as F


def emit(df: DataFrame, *columns: str) -> DataFrame:
    """The one place where the null rule holds: rows with a null in any of these columns go."""
    for c in columns:
        df = df.where(F.col(c).isNotNull())
    return df


def pipe(df: DataFrame, results: Mapping[str, Column], keep: list[str] | None = None) -> DataFrame:
    """Map: adds the result columns (keeping the columns in keep, or all), and drops rows with a null result."""
    kept = [F.col(c) for c in (df.columns if keep is None else keep) if c not in results]
    return emit(df.select(*kept, *[v.alias(k) for k, v in results.items()]), *results)


def flat_map(df: DataFrame, items: Column, name: str = "item", index: str | None = None) -> DataFrame:
    """Each element of an array becomes a row, nulls dropped; index names a column for its place among all elements."""
    if index:
        out = df.select("*", F.posexplode(items).alias(index, name))
    else:
        out = df.withColumn(name, F.explode(items))
    return emit(out, name)


def lookup(df: DataFrame, key: str, entries: DataFrame, entry_key: str, value: str) -> DataFrame:
    """Looks key up in a table of unique entries; rows whose key is missing, or whose value is null, go.

    Which side is broadcast, if any, is left to the planner and its size limit.
    """
    side = entries.select(F.col(entry_key).alias("_key"), F.col(value))
    return emit(df.join(side, df[key] == F.col("_key")).drop("_key"), value)


def lookup_list(df: DataFrame, index: Column, values: list, name: str = "value") -> DataFrame:
    """Looks an integer index up in a short list; negative ones count from its end, others beyond it drop the row."""
    n = len(values)
    at = F.when(index < 0, index + n).otherwise(index)
    found = F.when((at >= 0) & (at < n), F.get(F.array(*[F.lit(v) for v in values]), at.cast("int")))
    return emit(df.withColumn(name, found), name)


def missing_keys(df: DataFrame, key: str, entries: DataFrame, entry_key: str) -> DataFrame:
    """The rows whose lookup fails; a failing item is dropped and counted, see operators.failure."""
    return df.join(entries.select(F.col(entry_key).alias("_key")), df[key] == F.col("_key"), "left_anti")


def first_items(df: DataFrame, n: int, *order: str) -> DataFrame:
    """The first n items in the given order: a top-k per partition, then of those."""
    if n < 0:
        raise ValueError("n must not be negative")
    return df.orderBy(*order).limit(n)
