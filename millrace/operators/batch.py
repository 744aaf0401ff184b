"""Fixed-size batches, stateful folds, and their reverse."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import LongType, StructField, StructType

from millrace.operators.position import with_pos


def check_size(n: int) -> None:
    if not isinstance(n, int) or n < 1:
        raise ValueError(f"the batch size must be a positive integer: {n!r}")


def batch_ids(df: DataFrame, n: int, order: Sequence[str], *, workers: int = 1, within: Sequence[str] = ()) -> DataFrame:
    """df with pos, worker (pos modulo workers, as a region of workers deals items) and batch_id, counted within each
    worker and group. Batches never span groups, such as epochs."""
    check_size(n)
    if workers < 1:
        raise ValueError("workers must be at least 1")
    placed = with_pos(df, order, within=within)
    worker = (F.col("pos") % workers).cast("long")
    return placed.withColumn("worker", worker).withColumn("batch_id", F.floor(F.col("pos") / workers / n).cast("long") if workers > 1 else F.floor(F.col("pos") / n).cast("long"))


def batches(
    df: DataFrame,
    n: int,
    order: Sequence[str],
    items: Column,
    *,
    drop_last: bool = False,
    workers: int = 1,
    within: Sequence[str] = (),
    extra: Sequence[Column] = (),
) -> DataFrame:
    """One row for each batch: group columns, worker (with several), batch_id, n, items in order. drop_last drops batches
    that aren't full, for each worker and group. extra are further aggregates over the batch."""
    ids = batch_ids(df, n, order, workers=workers, within=within)
    keys = [*within, *(["worker"] if workers > 1 else []), "batch_id"]
    pairs = F.array_sort(F.collect_list(F.struct("pos", items.alias("item"))))
    out = ids.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.transform(pairs, lambda x: x["item"]).alias("items"), *extra)
    return out.where(F.col("n") == n) if drop_last else out


def unbatch(df: DataFrame, items: str = "items", name: str = "item") -> DataFrame:
    """Each element of a batch as a row; null elements are dropped, empty and null batches vanish."""
    out = df.withColumn(name, F.explode(items)).where(F.col(name).isNotNull())
    return out if name == items else out.drop(items)


def fold_until(
    df: DataFrame,
    order: str,
    size: str,
    threshold: int,
    *,
    within: Sequence[str] = (),
    drop_last: bool = False,
) -> DataFrame:
    """A stateful fold: items are gathered in order until their sizes reach the threshold; then the gathered items go out as
    one row, and the state is empty again. What is left at the end is flushed, unless drop_last.

    One row for each output: group columns, fold_id, n, total, last (the order key of its last item, a whole number). Null sizes count
    as 0. The fold is serial within a group by nature; `within` makes it parallel over groups such as epochs. Groups are
    streamed in order, and what is kept of one is its state: two numbers, whatever its size.
    """
    kinds = [df.schema[c] for c in within]
    keys = [F.col(c) for c in within]
    rows = df.select(*keys, F.col(order).cast("long").alias("_o"), F.coalesce(F.col(size).cast("long"), F.lit(0)).alias("_s"))
    rows = rows.repartition(*within) if within else rows.coalesce(1)
    rows = rows.sortWithinPartitions(*within, "_o")
    schema = StructType([*kinds, *(StructField(c, LongType()) for c in ("fold_id", "n", "total", "last"))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, fold, n, total, last = None, 0, 0, 0, None
        for batch in batches:
            groups = list(zip(*(batch.column(i).to_pylist() for i in range(len(kinds))))) if kinds else [()] * batch.num_rows
            out: list[tuple] = []
            for group, o, s in zip(groups, batch.column(len(kinds)).to_pylist(), batch.column(len(kinds) + 1).to_pylist(), strict=True):
                if group != key:
                    if n and not drop_last:
                        out.append((*key, fold, n, total, last))
                    key, fold, n, total = group, 0, 0, 0
                n, total, last = n + 1, total + s, o
                if total >= threshold:
                    out.append((*key, fold, n, total, last))
                    fold, n, total = fold + 1, 0, 0
            yield _record(out, batch, len(kinds))
        if n and not drop_last:
            yield _record([(*key, fold, n, total, last)], batch, len(kinds))

    return rows.mapInArrow(run, schema)


def _record(rows: list[tuple], like: pa.RecordBatch, keys: int) -> pa.RecordBatch:
    kinds = [like.schema.field(i).type for i in range(keys)] + [pa.int64()] * 4
    names = [like.schema.field(i).name for i in range(keys)] + ["fold_id", "n", "total", "last"]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)], names=names)


def fold_python(df: DataFrame, make, order: str, schema: str, within: Sequence[str], number: str | None = None):
    """A custom fold: make() gives an object with accumulate(row dict) and flush(), each returning a dict or None. Groups run
    in parallel, each in order, streamed: only the object's state is kept. `number` names a column for the place of an output
    in its group; columns of `within` that the schema names are filled in. An exception fails the query, as an aggregator's
    failure fails a pipeline."""
    kinds = StructType.fromDDL(schema)
    arrow = to_arrow_schema(kinds)
    named = [c for c in within if c in kinds.fieldNames()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state, k, out = None, None, 0, []

        def put(r: dict | None) -> None:
            nonlocal k
            if r is not None:
                out.append({c: key[within.index(c)] for c in named} | ({number: k} if number else {}) | r)
                k += 1

        for batch in batches:
            for row in batch.to_pylist():
                group = tuple(row[c] for c in within)
                if state is None or group != key:
                    if state is not None:
                        put(state.flush())
                    key, state, k = group, make(), 0
                put(state.accumulate(row))
            yield from pa.Table.from_pylist(out, schema=arrow).to_batches()
            out.clear()
        if state is not None:
            put(state.flush())
            yield from pa.Table.from_pylist(out, schema=arrow).to_batches()

    within = list(within)
    rows = df.repartition(*within) if within else df.coalesce(1)
    return rows.sortWithinPartitions(*within, order).mapInArrow(run, kinds)
