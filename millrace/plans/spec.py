"""Pipelines as specs: frozen descriptions of a source, stages and a sink, checked when they are made."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field
from fractions import Fraction

from pyspark.sql import Column, DataFrame

from millrace.operators.functions import kind_of

MAIN = "main"  # a placement: back to the main process


@dataclass(frozen=True)
class Source:
    """A DataFrame in a total order. epoch names the column of passes of a continuous source."""

    df: DataFrame
    order: tuple[str, ...]
    epoch: str | None = None

    def __post_init__(self):
        if not isinstance(self.df, DataFrame):
            raise ValueError("a source must be a DataFrame")
        if not self.order:
            raise ValueError("a source needs an order")


@dataclass(frozen=True)
class MergeSource:
    """Several pipelines as one source. strategy: 'bag' (by arrival), 'concat', 'round_robin', 'weighted', or a function of the
    pipelines' DataFrames and their orders that gives a DataFrame with a column pos, its order."""

    pipelines: tuple[Pipeline, ...]
    strategy: str | Callable[[list[DataFrame], list[tuple[str, ...]]], DataFrame] = "bag"
    stop_after: int = 0
    weights: tuple[float, ...] | None = None
    seed: int = 0

    def __post_init__(self):
        if not self.pipelines:
            raise ValueError("there is nothing to merge")
        if not callable(self.strategy) and self.strategy not in ("bag", "concat", "round_robin", "weighted"):
            raise ValueError(f"unknown strategy: {self.strategy}")
        if (self.strategy == "weighted") != (self.weights is not None):
            raise ValueError("weights go with the weighted strategy")
        if len({p.continuous for p in self.pipelines}) > 1:
            raise ValueError("continuous and finite pipelines can't be merged")


class Stage:
    """A stage of a pipeline."""


def _positive(n: int, what: str) -> None:
    if not isinstance(n, int) or isinstance(n, bool) or n < 1:
        raise ValueError(f"{what} must be a positive integer: {n!r}")


@dataclass(frozen=True)
class Pipe(Stage):
    """Map and filter: named results as Columns of the row; a null result drops the item. ordered: the output keeps the
    input's order as data; else none is promised. concurrency is a limit that Column expressions, which run as their
    partitions do, don't need. A failing item is one for which `failed` is true; it is dropped and counted against max_failures, of
    the stage alone; if that is None, by the counters that all stages without a limit of their own share."""

    results: Mapping[str, Column] = field(hash=False)
    ordered: bool = False
    concurrency: int = 1
    max_failures: int | Fraction | None = None
    failed: Column | None = None
    name: str | None = None

    def __post_init__(self):
        _positive(self.concurrency, "concurrency")
        if not self.results:
            raise ValueError("a pipe needs a result")


@dataclass(frozen=True)
class Generate(Stage):
    """Flat-map: an item for each element that isn't null of an array. Its output has no input order to keep."""

    items: Column
    name: str = "item"
    ordered: bool = False

    def __post_init__(self):
        if self.ordered:
            raise ValueError("a generator can't keep its input's order")


@dataclass(frozen=True)
class Call(Stage):
    """A Python function, plain, generator or async, or an object that is indexed: see operators.functions.mapped. results is a DDL
    string. Items it fails on are dropped and counted like a Pipe's; None drops the item."""

    fn: Callable = field(hash=False)
    results: str
    item: str | None = None
    ordered: bool = False
    concurrency: int = 1
    max_failures: int | Fraction | None = None
    name: str = "call"
    hooks: tuple | None = None  # millrace.hooks.TaskHook objects; None means the default ones

    def __post_init__(self):
        _positive(self.concurrency, "concurrency")
        if self.ordered and kind_of(self.fn) == "async generator":
            raise ValueError("an async generator can't keep its input's order")


@dataclass(frozen=True)
class CustomFold(Stage):
    """A fold by an object of make(), with accumulate(row) and flush(): see operators.batch.fold_python. One for each epoch, or for
    each worker of a region."""

    make: Callable = field(hash=False)
    results: str
    name: str = "fold"


@dataclass(frozen=True)
class Lookup(Stage):
    """Replaces a key by its value in a table; a missing key drops the item."""

    key: str
    entries: DataFrame
    entry_key: str
    value: str


@dataclass(frozen=True)
class Aggregate(Stage):
    """Batches of n items of a column, in order, within each epoch (and each worker of a region)."""

    n: int
    item: str
    drop_last: bool = False

    def __post_init__(self):
        _positive(self.n, "the batch size")


@dataclass(frozen=True)
class Fold(Stage):
    """Gathers items until the sizes in a column reach a threshold."""

    size: str
    threshold: int
    drop_last: bool = False

    def __post_init__(self):
        _positive(self.threshold, "the threshold")


@dataclass(frozen=True)
class Disaggregate(Stage):
    """The elements of batches as items."""

    name: str = "item"


@dataclass(frozen=True)
class PathVariants(Stage):
    """Routes each item by a computed index through one of several lists of stages; the outputs are united.

    batched: the input is batches; their elements, as column `item`, are routed each, and a batch's results stand together again, in order
    of path, then of place. A batch of which nothing is left vanishes. Paths then hold Pipes and Calls that set `item`."""

    router: Column
    paths: tuple[tuple[Stage, ...], ...]
    batched: bool = False

    def __post_init__(self):
        if not self.paths or any(not p for p in self.paths):
            raise ValueError("routing needs at least one path, and none empty")
        for p in self.paths:
            if any(not isinstance(s, Stage) or isinstance(s, To) for s in p):
                raise ValueError("a path holds stages only")
            if self.batched and any(not isinstance(s, (Pipe, Call)) for s in p):
                raise ValueError("a batched path holds pipes and calls only")


@dataclass(frozen=True)
class To(Stage):
    """Opens a region of that many workers, or closes it with MAIN. Items are dealt to workers in turn, so a batch inside a
    region is made of one worker's items; maps and filters aren't affected."""

    target: int | str

    def __post_init__(self):
        if self.target != MAIN:
            _positive(self.target, "the number of workers")


@dataclass(frozen=True)
class Sink:
    buffer_size: int = 3

    def __post_init__(self):
        _positive(self.buffer_size, "the buffer size")


@dataclass(frozen=True)
class Pipeline:
    source: Source | MergeSource
    stages: tuple[Stage, ...] = ()
    sink: Sink = Sink()
    max_failures: int | Fraction = -1
    on_breach: str = "raise"

    def __post_init__(self):
        open_, inside = False, 0
        for s in self.stages:
            if not isinstance(s, Stage):
                raise ValueError(f"not a stage: {s!r}")
            if isinstance(s, To):
                if s.target == MAIN:
                    if not open_:
                        raise ValueError("there is no region to close")
                    if not inside:
                        raise ValueError("a region needs a stage")
                    open_ = False
                else:
                    if open_:
                        raise ValueError("a region inside a region")
                    open_, inside = True, 0
            elif open_:
                inside += 1
                if getattr(s, "ordered", False):
                    raise ValueError("a stage inside a region can't keep the input's order")
        if open_:
            raise ValueError("a region that isn't closed")

    @property
    def continuous(self) -> bool:
        s = self.source
        return s.epoch is not None if isinstance(s, Source) else s.pipelines[0].continuous


class Builder:
    """Pipelines step by step."""

    def __init__(self):
        self._source: Source | MergeSource | None = None
        self._stages: list[Stage] = []
        self._sink: Sink | None = None

    def add_source(self, df: DataFrame | MergeSource, order: Sequence[str] = (), *, epoch: str | None = None) -> Builder:
        if self._source is not None:
            raise ValueError("the source was already set")
        self._source = df if isinstance(df, MergeSource) else Source(df, tuple(order), epoch)
        return self

    def add(self, stage: Stage) -> Builder:
        self._stages.append(stage)
        return self

    def pipe(self, results: Mapping[str, Column], **options) -> Builder:
        return self.add(Pipe(results, **options))

    def aggregate(self, n: int, item: str, *, drop_last: bool = False) -> Builder:
        return self.add(Aggregate(n, item, drop_last))

    def disaggregate(self, name: str = "item") -> Builder:
        return self.add(Disaggregate(name))

    def call(self, fn: Callable, results: str, **options) -> Builder:
        return self.add(Call(fn, results, **options))

    def fold(self, make: Callable, results: str) -> Builder:
        return self.add(CustomFold(make, results))

    def path_variants(self, router: Column, paths: Sequence[Sequence[Stage]], *, batched: bool = False) -> Builder:
        return self.add(PathVariants(router, tuple(tuple(p) for p in paths), batched))

    def to(self, target: int | str) -> Builder:
        return self.add(To(target))

    def add_sink(self, buffer_size: int = 3) -> Builder:
        if self._sink is not None:
            raise ValueError("the sink was already set")
        self._sink = Sink(buffer_size)
        return self

    def build(self, *, max_failures: int | Fraction = -1, on_breach: str = "raise") -> Pipeline:
        if self._source is None:
            raise ValueError("a pipeline needs a source")
        return Pipeline(self._source, tuple(self._stages), self._sink or Sink(), max_failures, on_breach)


