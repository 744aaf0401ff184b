"""Hooks: figures observed while a plan runs, background tasks, and defaults in the session's conf."""

from __future__ import annotations

import inspect
import logging
import threading
from collections.abc import Callable, Iterator, Sequence
from contextlib import ExitStack, contextmanager
from functools import partial

from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F

_LOG = logging.getLogger(__name__)

#: Keys of the session's conf and their defaults. With stats, function stages of a pipeline without a limit of failures are observed
#: while it runs, see observations(). In diagnostic mode a pipeline reads the first items of its source only.
DEFAULTS = {"millrace.stats": "false", "millrace.diagnostic": "false", "millrace.diagnostic.items": "1000"}


def setting(spark: SparkSession, key: str) -> str:
    if key not in DEFAULTS:
        raise KeyError(key)
    return spark.conf.get(key, DEFAULTS[key])


def stage_name(pipeline: int, stage: str, name: str, concurrency: int = 1) -> str:
    return f"{pipeline}:{stage}:{name}" + (f"[{concurrency}]" if concurrency > 1 else "")


def observed(df: DataFrame, name: str, failed: Column | None = None) -> tuple[DataFrame, Observation]:
    """df, and an observation that has num_tasks and num_failures once an action on it has run. No extra pass over the data."""
    seen = Observation(name)
    bad = F.lit(False) if failed is None else F.coalesce(failed, F.lit(True))
    return df.observe(seen, F.count(F.lit(1)).alias("num_tasks"), F.sum(bad.cast("long")).alias("num_failures")), seen


_SEEN: list[Observation] = []


def observations() -> list[Observation]:
    """The observations made since the last call, in order of compilation; each has its figures once an action has run."""
    out = _SEEN[:]
    _SEEN.clear()
    return out


def watched(df: DataFrame, name: str, failed: Column) -> DataFrame:
    """df, observed if the session's conf asks for it."""
    if setting(df.sparkSession, "millrace.stats") != "true":
        return df
    out, seen = observed(df, name, failed)
    _SEEN.append(seen)
    return out


def background(task: Callable[[threading.Event], None]) -> Callable[[], None]:
    """Runs task(stop) beside the pipeline; returns what ends it. Its errors are logged only."""
    stop = threading.Event()

    def run():
        try:
            task(stop)
        except Exception:
            _LOG.exception("a background task failed")

    thread = threading.Thread(target=run, daemon=True)
    thread.start()

    def end():
        stop.set()
        thread.join(10)

    return end


# -- hooks around function stages ------------------------------------------------------------------------------


class TaskHook:
    """What runs around a function stage, on the executors; subclasses override either method. Hooks must pickle.

    stage_hook() surrounds all that one Spark task does for the stage. task_hook(item) surrounds each invocation and sees its input; a generator's
    invocations are those of its items, and the one that ends it. An error that task_hook swallows is no failure: the item
    is dropped, or the generator ends. An error that task_hook raises is the item's failure, whatever the function gave. Spark may run a
    task again, so an item can be seen more than once.
    """

    @contextmanager
    def stage_hook(self) -> Iterator[None]:
        yield

    @contextmanager
    def task_hook(self, item) -> Iterator[None]:  # noqa: ARG002
        yield


@contextmanager
def around(hooks: Sequence[TaskHook], item=None, stage: bool = False) -> Iterator[None]:
    """The first hook is the outermost one."""
    with ExitStack() as stack:
        for h in hooks:
            stack.enter_context(h.stage_hook() if stage else h.task_hook(item))
        yield


_END = object()


def _plain(fn, hooks, item):
    with around(hooks, item):
        return fn(item)
    return None


def _generated(fn, hooks, item):
    items = iter(fn(item))
    while True:
        x = _END
        with around(hooks, item):
            x = next(items, _END)
        if x is _END:
            return
        yield x


async def _awaited(fn, hooks, item):
    with around(hooks, item):
        return await fn(item)
    return None


async def _async_generated(fn, hooks, item):
    items = aiter(fn(item))
    while True:
        x = _END
        with around(hooks, item):
            x = await anext(items, _END)
        if x is _END:
            return
        yield x


def hooked(fn, kind: str, hooks: Sequence[TaskHook]) -> tuple[Callable, str]:
    """fn with hooks around each invocation, and its kind then (see operators.functions.kind_of)."""
    if not hooks:
        return fn, kind
    wrap = {"plain": _plain, "lookup": _plain, "generator": _generated, "async": _awaited, "async generator": _async_generated}[kind]
    return partial(wrap, fn.__getitem__ if kind == "lookup" else fn, tuple(hooks)), "plain" if kind == "lookup" else kind


class ProfileHook:
    """What runs around profiling (plans.profiling), on the driver."""

    @contextmanager
    def stage_profile_hook(self, stage: str, concurrency: int) -> Iterator[None]:  # noqa: ARG002
        yield

    @contextmanager
    def pipeline_profile_hook(self) -> Iterator[None]:
        yield


# -- defaults --------------------------------------------------------------------------------------------------

_NONE = {"hooks": None, "profile_hook": ProfileHook(), "profile_callback": None, "build_callback": None, "background_tasks": ()}
_CHOSEN: dict[str, object] = {}


def set_default(what: str, value) -> None:
    """Sets a default of this Python process, None to unset it: 'hooks', a function that gives the hooks of a function stage by its name, where the stage names
    none; 'profile_hook'; 'profile_callback', called with each stage's result; 'build_callback', called with each pipeline that is compiled;
    'background_tasks', functions task(stop) that run while a consumer of a pipeline is open."""
    if what not in _NONE:
        raise KeyError(what)
    if value is not None and what not in ("profile_hook", "background_tasks") and not callable(value):
        raise ValueError(f"the default of {what} must be callable")
    if what == "background_tasks" and value is not None:
        value = tuple(value)
        if not all(map(callable, value)) or any(inspect.iscoroutinefunction(t) for t in value):
            raise ValueError("background tasks are plain functions")
    if value is None:
        _CHOSEN.pop(what, None)
    else:
        _CHOSEN[what] = value


def default(what: str):
    return _CHOSEN.get(what, _NONE[what])
