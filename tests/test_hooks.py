"""Hooks around function stages, defaults of the process, background tasks and profiles."""

import os
import threading
from contextlib import contextmanager

import pytest
from pyspark.sql import functions as F

from millrace import hooks
from millrace.operators import functions
from millrace.plans import compile as plans, profiling, spec


class Log(hooks.TaskHook):
    """Writes what it sees to files, and swallows one kind of error."""

    def __init__(self, folder, swallow=()):
        self.folder, self.swallow = str(folder), tuple(swallow)

    def say(self, text):
        with open(f"{self.folder}/{os.getpid()}", "a") as f:
            f.write(text + "\n")

    @contextmanager
    def stage_hook(self):
        self.say("begin")
        yield
        self.say("end")

    @contextmanager
    def task_hook(self, item):
        try:
            yield
            self.say(f"good {item}")
        except self.swallow:
            self.say(f"swallowed {item}")
        except ValueError:
            self.say(f"bad {item}")
            raise


class Refuse(hooks.TaskHook):
    @contextmanager
    def task_hook(self, item):
        yield
        if item == 3:
            raise ValueError("refused")


def said(folder):
    return sorted(line for f in os.listdir(folder) for line in open(f"{folder}/{f}").read().splitlines())


def half(v):
    if v % 2:
        raise ValueError("odd")
    return v // 2


async def half_later(v):
    return half(v)


def parts(v):
    yield from range(v)
    if v == 3:
        raise ValueError("odd")


async def parts_later(v):
    for k in range(v):
        yield k
    if v == 3:
        raise ValueError("odd")


@pytest.mark.parametrize("fn", [half, half_later])
def test_hooks_see_items(spark, numbers, tmp_path, fn):
    df = numbers([2, 3, 4]).coalesce(1)
    out = functions.mapped(df, fn, "h long", item="v", hooks=[Log(tmp_path)]).orderBy("ord").collect()
    assert [(r.h, r._error is None) for r in out] == [(1, True), (None, False), (2, True)]
    assert said(tmp_path) == ["bad 3", "begin", "end", "good 2", "good 4"]


@pytest.mark.parametrize("fn", [half, half_later])
def test_hooks_swallow_errors(spark, numbers, tmp_path, fn):
    out = functions.mapped(numbers([2, 3, 4]).coalesce(1), fn, "h long", item="v", hooks=[Log(tmp_path, [ValueError])]).orderBy("ord").collect()
    assert [(r.h, r._error) for r in out] == [(1, None), (None, None), (2, None)] and "swallowed 3" in said(tmp_path)


@pytest.mark.parametrize("fn", [parts, parts_later])
def test_hooks_of_generators(spark, numbers, tmp_path, fn):
    out = functions.mapped(numbers([2, 3]).coalesce(1), fn, "p long", item="v", index="i", hooks=[Log(tmp_path)]).orderBy("ord", "i").collect()
    assert [r.p for r in out if r.p is not None] == [0, 1, 0, 1, 2] and sum(r._error is not None for r in out) == 1
    assert said(tmp_path) == ["bad 3", "begin", "end", "good 2", "good 2", "good 2", "good 3", "good 3", "good 3"]


def test_hooks_refuse_and_nest(spark, numbers, tmp_path):
    out = functions.mapped(numbers([2, 3]).coalesce(1), {2: 20, 3: 30}, "h long", item="v", hooks=[Log(tmp_path), Refuse()]).orderBy("ord").collect()
    assert [r.h for r in out] == [20, None] and "refused" in out[1]._error and "bad 3" in said(tmp_path)  # the first is the outermost


@pytest.fixture
def defaults():
    yield hooks.set_default
    for what in hooks._NONE:
        hooks.set_default(what, None)


def pipeline(numbers, **options):
    return spec.Builder().add_source(numbers([1, 2, 3, 4]), ["ord"]).call(half, "h long", item="v", name="halves", **options).add_sink(2).build()


def test_default_hooks(spark, numbers, tmp_path, defaults):
    seen = []
    defaults("hooks", lambda name: seen.append(name) or [Log(tmp_path)])
    assert [r.h for r in plans.iterate(pipeline(numbers))] == [1, 2] and seen == ["halves"]
    assert {x for x in said(tmp_path) if x[0] == "g"} == {"good 2", "good 4"}  # some tasks run twice, to sort by sample


def test_build_callback_and_background_tasks(spark, numbers, defaults):
    built, began, ended = [], threading.Event(), threading.Event()

    def beside(stop):
        began.set()
        stop.wait(60)
        ended.set()

    defaults("build_callback", built.append)
    defaults("background_tasks", [beside])
    p = pipeline(numbers)
    with plans.Consumer(p) as c:
        assert [r.h for r in c] == [1, 2] and began.wait(10) and not ended.is_set()
    assert ended.wait(10) and built == [p]
    plans.compile_pipeline(p)
    assert len(built) == 2


def test_bad_defaults(defaults):
    with pytest.raises(KeyError):
        defaults("colour", 1)
    with pytest.raises(ValueError):
        defaults("build_callback", 1)
    with pytest.raises(ValueError):
        defaults("background_tasks", [1])
    assert hooks.default("background_tasks") == () and hooks.default("hooks") is None


def test_profile(spark, numbers, defaults):
    order, told = [], []

    class Hook(hooks.ProfileHook):
        @contextmanager
        def stage_profile_hook(self, stage, concurrency):
            order.append((stage, concurrency))
            yield

        @contextmanager
        def pipeline_profile_hook(self):
            order.append("begin")
            yield
            order.append("end")

    defaults("profile_hook", Hook())
    defaults("profile_callback", told.append)
    b = spec.Builder().add_source(numbers(list(range(20))), ["ord"]).pipe({"w": F.col("v") + 1}).call(half, "h long", item="v", name="halves").aggregate(4, "h")
    results = profiling.profile_pipeline(b.build(), items=10, concurrencies=(2, 1))
    assert [len(r.stats) for r in results] == [2, 1] and told == results and "halves" in results[0].name
    assert order == ["begin", ("halves", 2), ("halves", 1), ("aggregate", 1), "end"]
    assert all(s.qps > 0 and 0 <= s.occupancy_rate <= 1 for r in results for s in r.stats)
    with pytest.raises(ValueError):
        profiling.profile_pipeline(spec.Builder().add_source(numbers([1]).limit(0), ["ord"]).call(half, "h long", item="v").build())
