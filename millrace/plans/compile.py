"""Specs compiled to DataFrames: declarative plans that Catalyst optimises. Nothing runs until an action, but for pipelines with a limit of failures that
several stages share: what reaches the second of them and each one after it is written to a table first."""

from __future__ import annotations

import queue
import threading
from collections.abc import Iterator
from contextlib import contextmanager
from fractions import Fraction
from functools import reduce

from pyspark.sql import Column, DataFrame, Row, functions as F
from pyspark.sql.types import StructType

from millrace import hooks, stats
from millrace.operators import batch, core, failure, functions, merge, route
from millrace.operators.position import with_pos
from millrace.plans import spec
from millrace.sources import iterables
from millrace.tables import cut


def _source(s: spec.Source | spec.MergeSource, on_fault: str = "raise") -> tuple[DataFrame, tuple[str, ...], str | None]:
    if isinstance(s, spec.Source):
        # A source of Python iterables marks its faults.
        df = iterables.delivered(s.df, s.order, on_fault=on_fault) if iterables.FAULT in s.df.columns else s.df
        return df, s.order, s.epoch
    compiled = [_stages(p, on_fault) for p in s.pipelines]
    frames, orders = [c[0] for c in compiled], [c[1] for c in compiled]
    epoch = compiled[0][2]
    if callable(s.strategy):
        return s.strategy(frames, orders), ("pos",), epoch
    if s.strategy == "bag":
        tagged = [f.withColumn("src", F.lit(i)) for i, f in enumerate(frames)]
        return merge.bag(tagged), ("src", *orders[0]), epoch
    if s.strategy == "concat":
        out = merge.concat(frames, orders)
    elif s.strategy == "round_robin":
        out = merge.round_robin(frames, orders, s.stop_after)
    else:
        out = merge.weighted(frames, orders, s.weights, stop_after=s.stop_after, seed=s.seed)
    return out, ("pos",), epoch


class _Run:
    """What the stages of one pipeline share while it is compiled: the limit of failures and its counters."""

    def __init__(self, limit: int | Fraction, on_breach: str, counted: bool):
        self.limit, self.on_breach = limit, on_breach
        self.counted = counted and not (isinstance(limit, int) and limit < 0)
        self.before: DataFrame | None = None  # counters after the stages so far, one row

    def share(self, df: DataFrame, calls: Column, failed: Column, order: tuple[str, ...]) -> DataFrame:
        if self.before is not None:
            # What is counted is read in several branches. Written once behind each counted stage, reads grow with the number of these, not as its power.
            df = df.withColumns({"_counted_calls": calls, "_counted_failed": failed})
            df, self.before = cut(df, "counted"), cut(self.before, "counters")
            out, self.before = failure.shared(df, F.col("_counted_calls"), F.col("_counted_failed"), order, self.limit, before=self.before, on_breach=self.on_breach)
            return out.drop("_counted_calls", "_counted_failed")
        out, self.before = failure.shared(df, calls, failed, order, self.limit, before=self.before, on_breach=self.on_breach)
        return out

    def alone(self, df: DataFrame, calls: Column, failed: Column, order: tuple[str, ...], limit: int | Fraction) -> DataFrame:
        if isinstance(limit, int) and limit < 0:
            return df.where(~F.coalesce(failed, F.lit(True)))
        return failure.shared(df, calls, failed, order, limit, on_breach=self.on_breach)[0]


def _pipes(df: DataFrame, order: tuple[str, ...], run: _Run, stages: list[spec.Pipe]) -> DataFrame:
    """Pipes in a row that count together. Items that fail, or are dropped, are marked, so that each has its number of invocations."""
    df = df.withColumns({"_alive": F.lit(True), "_tried": F.lit(0).cast("long"), "_bad": F.lit(False)})
    for stage in stages:
        failed = F.col("_alive") & (F.lit(False) if stage.failed is None else F.coalesce(stage.failed, F.lit(True)))
        df = df.withColumns({"_tried": F.col("_tried") + F.col("_alive").cast("long"), "_now": failed})
        df = df.withColumns({"_bad": F.col("_bad") | F.col("_now"), "_alive": F.col("_alive") & ~F.col("_now")})
        df = df.withColumns({k: F.when(F.col("_alive"), v) for k, v in stage.results.items()})
        df = df.withColumn("_alive", reduce(lambda a, k: a & F.col(k).isNotNull(), stage.results, F.col("_alive")))
    return run.share(df, F.col("_tried"), F.col("_bad"), order).where("_alive").drop("_alive", "_tried", "_bad", "_now")


def _hooks(stage: spec.Call) -> tuple:
    if stage.hooks is not None:
        return tuple(stage.hooks)
    make = hooks.default("hooks")
    return tuple(make(stage.name)) if make is not None else ()


def _call(df: DataFrame, order: tuple[str, ...], run: _Run, stage: spec.Call) -> tuple[DataFrame, tuple[str, ...]]:
    index = f"{stage.name}_index"
    out = functions.mapped(df, stage.fn, stage.results, item=stage.item, index=index, concurrency=stage.concurrency, hooks=_hooks(stage))
    if index in out.columns:
        order = (*order, index)
    bad = F.col("_error").isNotNull()
    names = [f.name for f in StructType.fromDDL(stage.results).fields]
    if stage.max_failures is not None:
        out = run.alone(out, F.col("_calls"), bad, order, stage.max_failures)
    else:
        out = run.share(out, F.col("_calls"), bad, order) if run.counted else hooks.watched(out, stage.name, bad).where(~bad)
    return core.emit(out, *names).drop("_error", "_calls", "_seconds"), order


def _batched(df: DataFrame, order: tuple[str, ...], run: _Run, stage: spec.PathVariants) -> DataFrame:
    parts = df.select(*order, F.posexplode("items").alias("_place", "item"))
    parts = parts.withColumn("_route", route.checked(stage.router, len(stage.paths)))
    outs = []
    for i, path in enumerate(stage.paths):
        out = _through(parts.where(F.col("_route") == i), (*order, "_place"), None, 1, path, run)[0]
        outs.append(out.select(*order, "_route", "_place", "item"))
    both = reduce(lambda a, b: a.unionByName(b), outs)
    items = F.array_sort(F.collect_list(F.struct("_route", "_place", "item")))  # a batch
    return both.groupBy(*order).agg(F.count(F.lit(1)).alias("n"), F.transform(items, lambda x: x["item"]).alias("items"))


def _apply(df: DataFrame, order: tuple[str, ...], epoch: str | None, workers: int, stage: spec.Stage, run: _Run) -> tuple[DataFrame, tuple[str, ...]]:
    within = [epoch] if epoch else []
    if isinstance(stage, spec.Pipe):
        if stage.failed is not None:
            df = run.alone(df, F.lit(1), stage.failed, order, -1 if stage.max_failures is None else stage.max_failures)
        return core.pipe(df, stage.results), order
    if isinstance(stage, spec.Call):
        return _call(df, order, run, stage)
    if isinstance(stage, spec.Generate):
        return core.flat_map(df, stage.items, stage.name, f"{stage.name}_index"), (*order, f"{stage.name}_index")
    if isinstance(stage, spec.Lookup):
        return core.lookup(df, stage.key, stage.entries, stage.entry_key, stage.value), order
    if isinstance(stage, spec.Aggregate):
        out = batch.batches(df, stage.n, list(order), F.col(stage.item), drop_last=stage.drop_last, workers=workers, within=within)
        return out, (*within, *(["worker"] if workers > 1 else []), "batch_id")
    if isinstance(stage, spec.Fold):
        return batch.fold_until(df, order[-1], stage.size, stage.threshold, within=within, drop_last=stage.drop_last), (*within, "fold_id")
    if isinstance(stage, spec.CustomFold):
        placed = with_pos(df, list(order), "_pos", within=within).withColumn("worker", F.pmod(F.col("_pos"), F.lit(workers)))
        kinds = [f"{c} {df.schema[c].dataType.simpleString()}" for c in within]
        out = batch.fold_python(placed, stage.make, "_pos", ", ".join([*kinds, "worker long", f"{stage.name}_id long", stage.results]), [*within, "worker"], f"{stage.name}_id")
        return out, (*within, "worker", f"{stage.name}_id")
    if isinstance(stage, spec.Disaggregate):
        out = df.select("*", F.posexplode("items").alias(f"{stage.name}_index", stage.name)).drop("items")
        return core.emit(out, stage.name), (*order, f"{stage.name}_index")
    if isinstance(stage, spec.PathVariants):
        if stage.batched:
            return _batched(df, order, run, stage), order
        routed = df.withColumn("route", route.checked(stage.router, len(stage.paths)))
        outs = [_through(routed.where(F.col("route") == i), order, epoch, workers, path, run) for i, path in enumerate(stage.paths)]
        return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [o[0] for o in outs]), outs[0][1]
    raise ValueError(f"not a stage: {stage!r}")


def _through(df: DataFrame, order: tuple[str, ...], epoch: str | None, workers: int, stages, run: _Run) -> tuple[DataFrame, tuple[str, ...]]:
    """df after these stages, and its order."""
    waiting: list[spec.Pipe] = []
    for stage in [*stages, None]:
        if run.counted and isinstance(stage, spec.Pipe) and stage.max_failures is None:
            waiting.append(stage)
            continue
        if waiting:
            df, waiting = _pipes(df, order, run, waiting), []
        if isinstance(stage, spec.To):
            workers = 1 if stage.target == spec.MAIN else stage.target
        elif stage is not None:
            df, order = _apply(df, order, epoch, workers, stage, run)
    return df, order


def _can_fail(stages) -> bool:
    return any(
        isinstance(s, spec.Call) and s.max_failures is None or isinstance(s, spec.Pipe) and s.failed is not None and s.max_failures is None
        or isinstance(s, spec.PathVariants) and any(map(_can_fail, s.paths)) for s in stages
    )


def _stages(p: spec.Pipeline, on_fault: str = "raise") -> tuple[DataFrame, tuple[str, ...], str | None]:
    df, order, epoch = _source(p.source, on_fault)
    if hooks.setting(df.sparkSession, "millrace.diagnostic") == "true" and not df.isStreaming:
        df = core.first_items(df, int(hooks.setting(df.sparkSession, "millrace.diagnostic.items")), *order)
    df, order = _through(df, order, epoch, 1, p.stages, _Run(p.max_failures, p.on_breach, _can_fail(p.stages)))
    return df, order, epoch


def compile_pipeline(p: spec.Pipeline) -> DataFrame:
    """The pipeline's output. Its order is data: see output_order()."""
    _built(p)
    return _stages(p)[0]


def _built(p: spec.Pipeline) -> None:
    callback = hooks.default("build_callback")
    if callback is not None:
        callback(p)


def output_order(p: spec.Pipeline) -> tuple[str, ...]:
    return _stages(p)[1]


def figures(p: spec.Pipeline) -> DataFrame:
    """A row of task statistics (see stats.task_row) for each function stage outside paths, of a run of the pipeline up to it."""
    df, order, epoch = _source(p.source)
    run, workers, rows = _Run(p.max_failures, "truncate", _can_fail(p.stages)), 1, []
    for k, stage in enumerate(p.stages):
        if isinstance(stage, spec.Call):
            out = functions.mapped(df, stage.fn, stage.results, item=stage.item, index=f"{stage.name}_index", concurrency=stage.concurrency)
            rows.append(stats.task_row(out, hooks.stage_name(0, str(k), stage.name, stage.concurrency)))
        if isinstance(stage, spec.To):
            workers = 1 if stage.target == spec.MAIN else stage.target
        else:
            df, order = _through(df, order, epoch, workers, [stage], run)
    if not rows:
        raise ValueError("there is no function stage")
    return reduce(lambda a, b: a.unionByName(b), rows)


@contextmanager
def _failures():
    """A breach that an action raised is the pipeline's failure."""
    try:
        yield
    except Exception as e:
        if failure.BREACHED in str(e):
            raise failure.PipelineFailure(str(e).split("\n")[0]) from e
        raise


def _faults(s: spec.Source | spec.MergeSource) -> Iterator[str]:
    if isinstance(s, spec.MergeSource):
        for p in s.pipelines:
            yield from _faults(p.source)
    elif iterables.FAULT in s.df.columns:
        found = iterables.fault(s.df, s.order)
        if found is not None:
            yield found


def iterate(p: spec.Pipeline, epoch=None) -> Iterator[Row]:
    """The items in order, fetched a partition ahead; of a continuous pipeline, those of one epoch. Where a source fails, the items before the fault
    are delivered, and then the failure is raised."""
    _built(p)
    with _failures():
        df, order, column = _stages(p, "truncate")
    if (column is None) != (epoch is None):
        raise ValueError("a continuous pipeline is iterated by epoch, and only such a one")
    if epoch is not None:
        df = df.where(F.col(column) == epoch)
    with _failures():
        yield from df.orderBy(*order).toLocalIterator(prefetchPartitions=True)
    for found in _faults(p.source):
        raise failure.PipelineFailure(f"the source failed: {found}")


class Consumer:
    """A pipeline's items one at a time, fetched by a thread into a buffer of the sink's size; use it as a context, or start() and stop().

    get_item(timeout) raises TimeoutError if the next item isn't there in time, EOFError after the last one, and what the
    pipeline failed with after the items before it. Each iteration of a continuous pipeline is one epoch of `epochs`.
    """

    def __init__(self, p: spec.Pipeline, epochs=None):
        self._p, self._epochs = p, None if epochs is None else iter(epochs)
        self._items: queue.Queue = queue.Queue(p.sink.buffer_size)
        self._stopped, self._thread = threading.Event(), None
        self._beside: list = []  # what ends the background tasks

    def _put(self, kind: str, x=None) -> None:
        while not self._stopped.is_set():
            try:
                return self._items.put((kind, x), timeout=0.1)
            except queue.Full:
                continue

    def _fetch(self, epoch) -> None:
        try:
            for row in iterate(self._p, epoch):
                self._put("item", row)
                if self._stopped.is_set():
                    return
            self._put("end")
        except Exception as e:
            self._put("error", e)

    def start(self) -> Consumer:
        if not self._beside:
            self._beside = [hooks.background(task) for task in hooks.default("background_tasks")]
        if self._thread is None:
            epoch = None if self._epochs is None else next(self._epochs)
            self._thread = threading.Thread(target=self._fetch, args=(epoch,), daemon=True)
            self._thread.start()
        return self

    def stop(self) -> None:
        self._stopped.set()
        if self._thread is not None:
            self._thread.join(10)
        for end in self._beside:
            end()
        self._beside = []

    __enter__ = start

    def __exit__(self, *_) -> None:
        self.stop()

    def get_item(self, timeout: float | None = None) -> Row:
        if self._thread is None:
            raise RuntimeError("the pipeline wasn't started")
        try:
            kind, x = self._items.get(timeout=timeout)
        except queue.Empty:
            raise TimeoutError(f"no item within {timeout} seconds") from None
        if kind == "item":
            return x
        self._thread = None  # the next start() is the next epoch
        if kind == "error":
            raise x
        raise EOFError

    def __iter__(self) -> Iterator[Row]:
        self.start()
        while True:
            try:
                yield self.get_item()
            except EOFError:
                return
