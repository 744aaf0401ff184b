"""Profiles of a pipeline's function stages: each is run alone on the items that reach it, at several degrees of concurrency."""

from __future__ import annotations

import time
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import functions as F

from millrace import hooks
from millrace.operators import batch, core, functions
from millrace.plans import compile as plans, spec
from millrace.tables import cut, drop

CONCURRENCIES = (32, 16, 8, 4, 1)


@dataclass(frozen=True)
class StageProfile:
    """concurrency: invocations under way at once in each task. qps: items a second. occupancy_rate: the share of the time in which the stage had a result to
    pass on, 1 less the share that its invocations took of what its tasks could have run at once, and never below 0."""

    concurrency: int
    qps: float
    occupancy_rate: float


@dataclass(frozen=True)
class ProfileResult:
    name: str
    stats: tuple[StageProfile, ...]


def profile_pipeline(
    p: spec.Pipeline, *, items: int = 1000, concurrencies: Sequence[int] = CONCURRENCIES, hook: hooks.ProfileHook | None = None, callback: Callable[[ProfileResult], None] | None = None
) -> list[ProfileResult]:
    """A result for each function stage and batching stage of p, in order, batching stages at a concurrency of 1 only.

    The first `items` items of the source are used. What a stage gives, they and what becomes of them, is written to a table
    that the next stages read, so each stage is timed alone. hook and callback: None means the default ones, see hooks.set_default.
    """
    hook = hook or hooks.default("profile_hook")
    callback = callback or hooks.default("profile_callback") or (lambda _: None)
    df, order, epoch = plans._source(p.source)
    now = cut(core.first_items(df, items, *order), "profile")
    if not now.head(1):
        raise ValueError("there are no items to profile with")
    run, results, slots = plans._Run(-1, "raise", False), [], now.sparkSession.sparkContext.defaultParallelism
    with hook.pipeline_profile_hook():
        for k, stage in enumerate(p.stages):
            if isinstance(stage, (spec.Call, spec.Aggregate, spec.Disaggregate)):
                rows, stats = now.count(), []
                at = concurrencies if isinstance(stage, spec.Call) else (1,)
                for c in at:
                    with hook.stage_profile_hook(stage.name if hasattr(stage, "name") else type(stage).__name__.lower(), c):
                        stats.append(_timed(now, order, stage, c, rows, slots))
                name = getattr(stage, "name", type(stage).__name__.lower())
                results.append(ProfileResult(hooks.stage_name(0, str(k), name), tuple(stats)))
                callback(results[-1])
            if isinstance(stage, spec.To):
                continue
            before = now
            out, order = plans._through(now, order, epoch, 1, [stage], run)
            now = cut(out, "profile")
            drop(before)
    drop(now)
    return results


def _timed(df, order, stage: spec.Stage, concurrency: int, rows: int, slots: int) -> StageProfile:
    busy = None
    began = time.monotonic()
    if isinstance(stage, spec.Call):
        out = functions.mapped(df, stage.fn, stage.results, item=stage.item, index=f"{stage.name}_index", concurrency=concurrency)
        busy = out.agg(F.sum("_seconds")).first()[0] or 0.0
    elif isinstance(stage, spec.Aggregate):
        batch.batches(df, stage.n, list(order), F.col(stage.item), drop_last=stage.drop_last).write.format("noop").mode("overwrite").save()
    else:
        df.select(F.explode("items")).write.format("noop").mode("overwrite").save()
    took = max(1e-9, time.monotonic() - began)
    share = 0.0 if busy is None else busy / (took * concurrency * min(slots, max(1, df.rdd.getNumPartitions())))
    return StageProfile(concurrency, rows / took, max(0.0, 1 - share))
