"""Trees of any depth, with cycles, and repeated proposals."""

import random

import pytest
from pyspark.sql import functions as F

from millrace import experiments


def plain_levels(nodes):
    """Breadth first from the roots; the smallest id where there is none."""
    children = {}
    for i, p in nodes.items():
        children.setdefault(p, []).append(i)
    roots = [i for i, p in nodes.items() if p is None or p not in nodes] or [min(nodes)]
    out, todo = {}, [(r, r, 0) for r in roots]
    while todo:
        i, root, depth = todo.pop(0)
        if i in out:
            continue
        out[i] = (root, depth)
        todo += [(c, root, depth + 1) for c in children.get(i, [])]
    return out


def trees():
    rng = random.Random(6)
    yield {0: None}
    yield {i: i - 1 if i else None for i in range(1500)}  # one path, deeper than a recursive query goes
    yield {i: (i - 1) // 3 if i else None for i in range(400)}
    yield {i: rng.choice([None, 1000, *range(max(1, i))]) for i in range(300)}
    yield {**{i: i - 1 if i else None for i in range(20)}, 30: 31, 31: 32, 32: 30, 33: 30, 34: 34}  # two cycles beside a path
    yield {5: 7, 6: 5, 7: 6, 8: 6, 9: 8}  # nothing but a cycle and what hangs on it
    yield {1: 1}


@pytest.mark.parametrize("k", range(7))
def test_levels(spark, k):
    nodes = list(trees())[k]
    df = spark.createDataFrame(list(nodes.items()), "id long, parent_id long")
    assert {r.id: (r.root, r.depth) for r in experiments.levels(df).collect()} == plain_levels(nodes)


def test_no_levels(spark):
    assert not experiments.levels(spark.createDataFrame([], "id long, parent_id long")).collect()


@pytest.mark.parametrize("k", range(7))
def test_best_path(spark, k):
    nodes = list(trees())[k]
    rng = random.Random(k)
    rows = [(i, p, rng.choice([None, 0.0, -1.0, 2.0 + i % 13, 1.0 if i > len(nodes) // 2 else 9.0])) for i, p in nodes.items()]
    df = spark.createDataFrame(rows, "id long, parent_id long, duration double")
    good = [(d, i) for i, _, d in rows if d and d > 0]
    want, at, seen = set(), min(good)[1] if good else None, set()
    while at is not None and at in nodes and at not in seen:
        seen.add(at)
        if nodes[at] in nodes:
            want.add((nodes[at], at))
        at = nodes[at]
    assert {tuple(r) for r in experiments.best_path(df).collect()} == want


def test_repeated_proposals(spark):
    rows = [(1, ["a", "b"], "failed"), (2, ["b", "a"], "completed"), (3, ["a", "b", "a"], "queued"), (4, ["a"], None), (5, ["a"], "failed"), (6, [], "queued"), (7, [], "queued"), (8, None, "queued"), (9, ["a"], "queued")]
    df = spark.createDataFrame(rows, "id long, changes array<string>, status string")
    got = experiments.repeated_proposals(df, "id", "changes", F.col("status") == "failed").collect()
    assert sorted(map(tuple, got)) == [(3, 2), (9, 4)]
