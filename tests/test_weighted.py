"""Weighted draws on the executors, and sources that fail."""

import math
import random

import pytest
from pyspark.sql import functions as F

from millrace.operators import failure, weighted
from millrace.plans import compile as plans, spec
from millrace.sources import iterables


def items(spark, weights):
    return spark.createDataFrame(list(enumerate(weights)), "k long, w double").repartition(3)


def draws(df):
    return [r.k for r in sorted(df.collect(), key=lambda r: r.draw_no)]


def test_uniform_numbers(spark):
    u = [r.u for r in spark.range(20_000).select(weighted.uniform(3, F.col("id")).alias("u")).collect()]
    assert 0 < min(u) and max(u) < 1 and abs(sum(u) / len(u) - 0.5) < 0.01 and len(set(u)) == len(u)


@pytest.mark.parametrize("block", [1 << 16, 7])
def test_with_replacement_by_frequency(spark, block):
    weights = [0.0, 1.0, 2.0, 4.0, 0.0, 100.0, *[0.01] * 300, 30.0]
    n = 40_000
    got = draws(weighted.with_replacement(items(spark, weights), ["k"], "w", n, seed=5, block=block))
    assert len(got) == n and not {0, 4} & set(got)
    for k in (1, 2, 3, 5, 306):
        p = weights[k] / sum(weights)
        assert abs(got.count(k) - n * p) < 5 * math.sqrt(n * p * (1 - p))
    tail = sum(6 <= k < 306 for k in got)
    p = 3 / sum(weights)
    assert abs(tail - n * p) < 5 * math.sqrt(n * p)
    assert got == draws(weighted.with_replacement(items(spark, weights).repartition(5), ["k"], "w", n, seed=5))
    assert got != draws(weighted.with_replacement(items(spark, weights), ["k"], "w", n, seed=6))


def test_every_draw_has_one_item(spark):
    """Points on the ends of items, with weights far apart."""
    rng = random.Random(9)
    weights = [rng.choice([1e-12, 1e-6, 1.0, 3.0, 1e9]) for _ in range(500)]
    out = weighted.with_replacement(items(spark, weights), ["k"], "w", 3000, seed=1)
    assert out.count() == 3000 == out.select("draw_no").distinct().count()


def test_ranks_share_one_draw(spark):
    df = items(spark, [1.0, 2.0, 3.0, 4.0, 5.0, 0.0])
    for draw in (weighted.with_replacement, weighted.without_replacement):
        whole = draws(draw(df, ["k"], "w", 5, seed=2))
        parts = [draws(draw(df, ["k"], "w", 5, seed=2, rank=r, world_size=2)) for r in (0, 1)]
        assert parts == [whole[0:4:2], whole[1:4:2]]
        assert draws(draw(df, ["k"], "w", 5, seed=2, rank=0, world_size=2, drop_last=False)) == whole[::2]


def test_without_replacement_by_frequency(spark):
    weights, first, pairs = [1.0, 2.0, 3.0, 0.0], {}, {}
    df = spark.range(3000).crossJoin(items(spark, weights)).withColumn("g", F.col("id"))
    e = -F.ln(weighted.uniform(7, F.col("g"), F.col("k"))) / F.col("w")
    rows = df.where("w > 0").withColumn("e", e).groupBy("g").agg(F.array_sort(F.collect_list(F.struct("e", "k"))).alias("o")).collect()
    for r in rows:
        order = tuple(x.k for x in r.o)
        first[order[0]] = first.get(order[0], 0) + 1
        pairs[order[:2]] = pairs.get(order[:2], 0) + 1
    assert abs(first[2] / 3000 - 0.5) < 0.05 and abs(first[0] / 3000 - 1 / 6) < 0.04
    assert abs(pairs[2, 1] / 3000 - 0.5 * 2 / 3) < 0.05
    got = draws(weighted.without_replacement(items(spark, weights), ["k"], "w", 4, seed=3))
    assert sorted(got) == [0, 1, 2]  # the item without weight is never drawn


def test_large_draws_without_replacement(spark):
    df = spark.range(30_000).select(F.col("id").alias("k"), (F.col("id") % 3).cast("double").alias("w"))
    got = draws(weighted.without_replacement(df, ["k"], "w", 15_000, seed=4))
    assert len(set(got)) == 15_000 and not any(k % 3 == 0 for k in got)
    assert sum(k % 3 == 2 for k in got[:3000]) > 1800  # heavier ones come first


@pytest.mark.parametrize("bad", [-1.0, float("nan"), float("inf"), None])
def test_bad_weights(spark, bad):
    for draw in (weighted.with_replacement, weighted.without_replacement):
        with pytest.raises(Exception, match="finite"):
            draw(items(spark, [1.0, bad]), ["k"], "w", 1).collect()


def test_bad_draws(spark):
    df = items(spark, [1.0, 2.0])
    for bad in ({"num_draws": 0}, {"num_draws": 1, "world_size": 2}, {"num_draws": 2, "rank": 1}):
        with pytest.raises(ValueError):
            weighted.with_replacement(df, ["k"], "w", **bad)
    with pytest.raises(ValueError):
        weighted.with_replacement(items(spark, [0.0]), ["k"], "w", 1)


# -- sources that fail -----------------------------------------------------------------------------------------


def failing(part):
    for i in range(10):
        yield {"v": part * 100 + i}
    if part == 1:
        raise ValueError("out of paper")
    yield {"v": -1}


def pipeline(df):
    return spec.Builder().add_source(df, iterables.ORDER).pipe({"w": F.col("v") * 2 + 1}).add_sink(100).build()


def test_items_before_a_fault_are_delivered(spark):
    source = iterables.iterated(spark, [0, 1, 2], failing, "v long")
    got = []
    with pytest.raises(failure.PipelineFailure, match="out of paper"):
        for r in plans.iterate(pipeline(source)):
            got.append(r.w)
    assert got == [2 * v + 1 for v in [*range(10), -1, *range(100, 110)]]


def test_a_consumer_gets_them_too(spark):
    got = []
    with plans.Consumer(pipeline(iterables.iterated(spark, [1], failing, "v long"))) as c:
        with pytest.raises(failure.PipelineFailure, match="out of paper"):
            while True:
                got.append(c.get_item(60).w)
    assert got == [2 * v + 1 for v in range(100, 110)]


def test_an_action_fails(spark):
    source = iterables.iterated(spark, [0, 1], failing, "v long")
    with pytest.raises(Exception, match="the source failed: ValueError: out of paper"):
        plans.compile_pipeline(pipeline(source)).collect()
    with pytest.raises(Exception, match="out of paper"):
        plans.compile_pipeline(pipeline(source)).agg(F.count(F.lit(1))).collect()
    assert iterables.delivered(source, on_fault="truncate").count() == 21
    assert iterables.delivered(source, on_fault="skip").count() == 21
    assert iterables.delivered(iterables.iterated(spark, [1, 2], failing, "v long"), on_fault="skip").count() == 21
    assert iterables.delivered(iterables.iterated(spark, [1, 2], failing, "v long"), on_fault="truncate").count() == 10
    with pytest.raises(ValueError):
        iterables.delivered(source, on_fault="ignore")


def test_a_source_without_faults(spark):
    source = iterables.iterated(spark, [0, 2], failing, "v long")
    assert [r.w for r in plans.iterate(pipeline(source))] == [2 * v + 1 for v in [*range(10), -1, *range(200, 210), -1]]
    assert iterables.fault(source) is None
    assert not list(plans.iterate(pipeline(iterables.iterated(spark, [0], lambda p: [], "v long"))))


def test_many_items_come_in_batches(spark):
    source = iterables.iterated(spark, [3], lambda p: ({"v": i} for i in range(5000)), "v long")
    assert [r.v for r in source.orderBy("item_no").collect()] == list(range(5000))
