"""Sources that are Python iterables, one for each of some parts, read on the executors. A fault of one of them is a row of its own."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import LongType, StringType, StructField, StructType

from millrace.operators.failure import BREACHED

FAULT = "_fault"
ORDER = ("part", "item_no")
BATCH = 1024


def iterated(spark: SparkSession, parts: DataFrame | Sequence, make: Callable[[object], Iterable[dict]], schema: str) -> DataFrame:
    """(part, item_no, *schema, _fault): the items, dicts, of make(part) for each part, numbered in their order.

    parts is a table of one column of numbers, or a list of numbers. An iterable that raises gives a row with the error in _fault after the
    items before it, and no more of that part: the marked last row. Items are sent on in batches, so an iterable may be endless if a limit follows.
    """
    frame = parts if isinstance(parts, DataFrame) else spark.createDataFrame([(int(p),) for p in parts], "part long").repartition(max(1, len(parts)))
    name = frame.columns[0]
    kinds = StructType.fromDDL(schema)
    out = StructType([StructField("part", LongType()), StructField("item_no", LongType()), *kinds.fields, StructField(FAULT, StringType())])
    arrow = to_arrow_schema(out)

    def run(batches):
        for batch in batches:
            for part in batch.column(0).to_pylist():
                rows, n = [], 0
                try:
                    for item in make(part):
                        rows.append({"part": part, "item_no": n, **item})
                        n += 1
                        if len(rows) == BATCH:
                            yield pa.RecordBatch.from_pylist(rows, schema=arrow)
                            rows = []
                except Exception as e:  # a source's fault is data, too: what came before it is delivered
                    rows.append({"part": part, "item_no": n, FAULT: f"{type(e).__name__}: {e}"})
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=arrow)

    return frame.select(F.col(name).cast("long")).mapInArrow(run, out)


def delivered(source: DataFrame, order: Sequence[str] = ORDER, *, on_fault: str = "raise") -> DataFrame:
    """The items of a source with faults: those in order before the first fault. With 'raise', the action then fails; with 'truncate' it
    ends there. With 'skip' a fault ends its own part only.

    A Spark action is all or nothing: with 'raise' it fails, from a branch of the plan that gives no row. Iterating a pipeline (plans.compile.iterate,
    Consumer) delivers the items before the fault first, and then fails.
    """
    if on_fault not in ("raise", "truncate", "skip"):
        raise ValueError("on_fault must be 'raise', 'truncate' or 'skip'")
    items = source.where(F.col(FAULT).isNull()).drop(FAULT)
    if on_fault == "skip":
        return items
    place = F.struct(*order)
    first = source.where(F.col(FAULT).isNotNull()).agg(F.min(F.struct(place.alias("at"), FAULT)).alias("_f"))  # one row
    before = items.join(F.broadcast(first)).where(F.col("_f").isNull() | (place < F.col("_f.at"))).drop("_f")
    if on_fault == "truncate":
        return before
    message = F.concat(F.lit(f"{BREACHED}: the source failed: "), F.col(f"_f.{FAULT}"))
    # Its columns are some row's, not constants, by which the optimiser could tell that filters after it pass none.
    some = source.agg(*[F.first(c).alias(c) for c in items.columns]).join(F.broadcast(first))
    guard = some.where(F.when(F.col("_f").isNotNull(), F.raise_error(message).cast("boolean")).otherwise(False))
    return before.unionByName(guard.drop("_f"))


def fault(source: DataFrame, order: Sequence[str] = ORDER) -> str | None:
    """The first fault of a source, in order; None if there is none. One row comes to the driver."""
    found = source.where(F.col(FAULT).isNotNull()).agg(F.min(F.struct(F.struct(*order).alias("at"), FAULT)).alias("f")).first()["f"]
    return None if found is None else found[FAULT]
