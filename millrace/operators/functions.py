"""Python functions as stages: plain, generator, async and async-generator functions, or objects that are called or indexed.

Rows go to Python in Arrow batches. Each batch is a list of items; results are columns. A function that fails gives a row with
_error set, which operators.failure drops and counts.
"""

from __future__ import annotations

import asyncio
import inspect
import time
from collections.abc import Callable, Iterable, Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType

from millrace.hooks import TaskHook, around, hooked
from millrace.operators.pieces import pieces, sent


def kind_of(fn) -> str:
    """How fn is to be run: 'plain', 'generator', 'async', 'async generator', or 'lookup' for what is indexed, not called."""
    if not callable(fn):
        if hasattr(fn, "__getitem__"):
            return "lookup"
        raise ValueError(f"neither a function nor a table: {fn!r}")
    for f in (fn, getattr(fn, "__call__", None)):
        if inspect.isasyncgenfunction(f):
            return "async generator"
        if inspect.iscoroutinefunction(f):
            return "async"
        if inspect.isgeneratorfunction(f):
            return "generator"
    return "plain"


#: What an item came to: its results, the seconds up to each of them and to the end, and the error that ended it, if one did.
Outcome = tuple[list, list[float], str | None]


def _one(fn: Callable, item) -> Outcome:
    began, out, error = time.perf_counter(), [], None
    try:
        out.append(fn(item))
    except Exception as e:  # an item's failure is data: it is counted, and the pipeline goes on
        error = f"{type(e).__name__}: {e}"
    return out, [time.perf_counter() - began], error


def _many(fn: Callable, item) -> Outcome:
    out, times, error = [], [time.perf_counter()], None
    try:
        for x in fn(item):
            out.append(x)
            times.append(time.perf_counter())
    except Exception as e:  # what came before stays
        error = f"{type(e).__name__}: {e}"
    times.append(time.perf_counter())
    return out, [b - a for a, b in zip(times, times[1:])], error


async def _gathered(fn: Callable, items: list, concurrency: int, many: bool) -> list[Outcome]:
    gate = asyncio.Semaphore(concurrency)

    async def one(item):
        out, error = [], None
        async with gate:
            times = [time.perf_counter()]
            try:
                if many:
                    async for x in fn(item):
                        out.append(x)
                        times.append(time.perf_counter())
                else:
                    out.append(await fn(item))
            except Exception as e:
                error = f"{type(e).__name__}: {e}"
            times.append(time.perf_counter())
        return out, [b - a for a, b in zip(times, times[1:])], error

    return list(await asyncio.gather(*map(one, items)))


def _run(fn, kind: str, items: list, concurrency: int) -> Iterable[Outcome]:
    if kind.startswith("async"):
        return asyncio.run(_gathered(fn, items, concurrency, kind == "async generator"))
    call = {"plain": _one, "generator": _many, "lookup": _one}[kind]
    target = fn.__getitem__ if kind == "lookup" else fn
    if concurrency == 1:
        return (call(target, x) for x in items)
    with ThreadPoolExecutor(concurrency) as pool:
        return list(pool.map(lambda x: call(target, x), items))


def mapped(df: DataFrame, fn, results: str, *, item: str | None = None, index: str | None = None, concurrency: int = 1, hooks: Sequence[TaskHook] = ()) -> DataFrame:
    """df with the result columns (a DDL string), _error, _calls, the number of invocations the row stands for, and _seconds, which they took.

    fn gets the value of the column `item`, or the row as a dict, and gives a value (for one result column) or a dict. A generator
    gives any number of rows, told apart by `index`; its last invocation, which ends it, is a row without results. None
    gives a row without results, which core.emit drops. Up to `concurrency` items of a piece of a batch are under way at once. hooks
    run around invocations and tasks, see millrace.hooks. Results are sent on before they are many or large, so that a task holds few of them;
    where concurrency is more than 1 or fn is async, it holds those of a piece, of up to pieces.SENT items.
    """
    kind, kinds = kind_of(fn), StructType.fromDDL(results)
    fn, kind = hooked(fn, kind, hooks)
    names = [f.name for f in kinds.fields]
    many = kind.endswith("generator")
    if many and not index:
        raise ValueError("a generator's items need an index")
    kept = [f for f in df.schema.fields if f.name not in names]
    extra = [StructField(index, LongType())] if many else []
    schema = StructType([*kept, *extra, *[StructField(f.name, f.dataType) for f in kinds.fields], StructField("_error", StringType()), StructField("_calls", LongType()), StructField("_seconds", DoubleType())])
    arrow = to_arrow_schema(schema)

    def row(base: dict, value, error: str | None, at: int, seconds: float) -> dict:
        out = {f.name: base[f.name] for f in kept} | {"_error": error, "_calls": 1, "_seconds": seconds}
        if many:
            out[index] = at
        if value is not None:
            out |= value if isinstance(value, dict) else {names[0]: value}
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with around(hooks, stage=True):
            yield from each(batches)

    def streamed(rows: list[dict]) -> Iterator[dict]:
        """A generator's results one by one: none of them waits for those that follow."""
        for base in rows:
            began, at, error = time.perf_counter(), 0, None
            try:
                for x in fn(base if item is None else base[item]):
                    now = time.perf_counter()
                    yield row(base, x, None, at, now - began)
                    began, at = time.perf_counter(), at + 1
            except Exception as e:  # what came before stays
                error = f"{type(e).__name__}: {e}"
            yield row(base, None, error, at, time.perf_counter() - began)

    def gathered(rows: list[dict]) -> Iterator[dict]:
        found = _run(fn, kind, rows if item is None else [r[item] for r in rows], concurrency)
        for base, (values, times, error) in zip(rows, found, strict=True):
            yield from (row(base, v, None, k, t) for k, (v, t) in enumerate(zip(values, times)))
            if error is not None or many:
                yield row(base, None, error, len(values), times[-1])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        some = streamed if kind == "generator" and concurrency == 1 else gathered
        for rows in pieces(batches):
            yield from sent(some(rows), arrow)

    return df.mapInArrow(run, schema)
