"""Statistics by interval, and sinks of several tables."""

import math
import os
import random

import pytest
from pyspark.sql import functions as F

from millrace import stats


@pytest.fixture(scope="module")
def calls():
    rng = random.Random(4)
    rows = [(rng.choice("ab"), round(rng.uniform(0, 50), 3), round(rng.lognormvariate(-3, 1), 6), "bad" if rng.random() < 0.1 else None) for _ in range(3000)]
    return rows + [("c", 5.0, 1.0, "bad"), ("c", 31.0, 0.0, None), ("c", 31.5, 2.0, None)]


def frame(spark, rows):
    return spark.createDataFrame(rows, "name string, at double, _seconds double, _error string")


def exact(rows, percent):
    s = sorted(rows)
    return s[math.ceil(len(s) * percent / 100) - 1] if s else 0.0


def near(a, b):
    return abs(a - b) <= stats.ACCURACY * b + 2 * stats.LEAST


def check(row, mine):
    good = [r[2] for r in mine if r[3] is None]
    assert (row.num_tasks, row.num_failures) == (len(mine), len(mine) - len(good))
    assert row.ave_time == pytest.approx(sum(good) / len(good) if good else 0.0)
    for percent, got in ((90, row.p90_time), (99, row.p99_time)):
        assert near(got, exact(good, percent))


def test_intervals(spark, calls):
    got = stats.interval_rows(stats.sketched(frame(spark, calls), "name", "at", 10.0), 10.0).collect()
    keys = {(n, int(t // 10)) for n, t, _, _ in calls}
    assert {(r.name, int(r.timestamp / 10) - 1) for r in got} == keys
    for r in got:
        check(r, [c for c in calls if c[0] == r.name and int(c[1] // 10) == int(r.timestamp / 10) - 1])


def test_sketches_merge(spark, calls):
    halves = [stats.sketched(frame(spark, calls[k::2]), "name", "at", 10.0) for k in (0, 1)]
    merged = stats.interval_rows(stats.merged(halves[0].unionByName(halves[1])), 10.0)
    whole = stats.interval_rows(stats.sketched(frame(spark, calls), "name", "at", 10.0), 10.0)
    rows = lambda df: sorted(tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in df.collect())
    assert rows(merged) == rows(whole)


def test_running_and_laps(spark, calls):
    running = stats.running_rows(stats.sketched(frame(spark, calls), "name", "at", 10.0), 10.0)
    for r in running.collect():
        check(r, [c for c in calls if c[0] == r.name and c[1] < r.timestamp])
    for r in stats.lap_rows(running).collect():
        good = [c[2] for c in calls if c[0] == r.name and r.timestamp - 10 <= c[1] < r.timestamp and c[3] is None]
        if r.name != "c":  # c has no row in every interval
            assert r.lap_n == len(good) and r.lap_mean == pytest.approx(sum(good) / len(good), rel=1e-6)


def test_nothing_called(spark):
    empty = stats.sketched(frame(spark, []), "name", "at", 10.0)
    assert not stats.interval_rows(empty, 10.0).collect() and not stats.running_rows(empty, 10.0).collect()


def test_t_interval(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("a", 3.0), ("b", 5.0)], "name string, v double")
    rows = {r.name: r for r in stats.t_interval(df, "name", "v").collect()}
    assert rows["a"].high == pytest.approx(2 + 4.303 / math.sqrt(3)) and rows["b"].low == rows["b"].high == 5.0


# -- sinks -----------------------------------------------------------------------------------------------------

NAMES = [c.split()[0] for c in stats.ENTRIES.split(", ")]


def entry(kind, t, name, **more):
    return tuple({**dict.fromkeys(NAMES), "kind": kind, "timestamp": t, "name": name, **more}[c] for c in NAMES)


def read(spark, root):
    schema = lambda s: ", ".join(c for c in s.split(", ") if not c.startswith("id "))
    tables = {"task_stats": schema(stats.TASK_STATS), "queue_stats": schema(stats.QUEUE_STATS), "event_stats": schema(stats.EVENT_STATS)}
    return {k: sorted((r.timestamp, r.batch) for r in stats.committed(spark, root, k, v).collect()) for k, v in tables.items()}


def test_three_tables_together(spark, tmp_path):
    root, source = f"file://{tmp_path}/stats", tmp_path / "in"
    df = lambda rows: spark.createDataFrame(rows, stats.ENTRIES).coalesce(1)
    assert read(spark, root) == {"task_stats": [], "queue_stats": [], "event_stats": []}
    df([entry("task", 1.0, "a", num_tasks=3), entry("queue", 2.0, "q"), entry("event", 3.0, "gc")]).write.parquet(str(source))

    def run():
        stream = spark.readStream.schema(stats.ENTRIES).option("maxFilesPerTrigger", 1).parquet(str(source))
        stats.sink(stream, root, f"{tmp_path}/checkpoint", stats.entry_tables()).awaitTermination()

    run()
    assert read(spark, root) == {"task_stats": [(1.0, 0)], "queue_stats": [(2.0, 0)], "event_stats": [(3.0, 0)]}
    # An entry of no kind fails its batch: nothing of it counts, in any table, though some were written.
    df([entry("task", 4.0, "a"), entry("noise", 5.0, "?")]).write.mode("append").parquet(str(source))
    with pytest.raises(Exception, match="unknown kind"):
        run()
    assert read(spark, root) == {"task_stats": [(1.0, 0)], "queue_stats": [(2.0, 0)], "event_stats": [(3.0, 0)]}


def test_a_batch_counts_once_and_whole(spark, tmp_path):
    root = f"file://{tmp_path}/stats"
    a = spark.createDataFrame([(1.0, "x")], "timestamp double, event_name string")
    stats.commit_batch({"event_stats": a}, root, 0)
    stats.commit_batch({"event_stats": a.union(a)}, root, 0)  # comes again: left as it is
    assert stats.committed(spark, root, "event_stats", "timestamp double, event_name string").count() == 1
    # A batch that stopped before its row in the table of commits is invisible, and replaced when it comes again.
    a.union(a).write.parquet(f"{root}/event_stats/batch=1")
    assert stats.committed(spark, root, "event_stats", "timestamp double, event_name string").count() == 1
    stats.commit_batch({"event_stats": a}, root, 1)
    assert stats.committed(spark, root, "event_stats", "timestamp double, event_name string").count() == 2
    assert os.path.isdir(f"{tmp_path}/stats/{stats.COMMITS}/at=1")
    assert stats.committed(spark, root, "task_stats", "timestamp double").count() == 0


def test_rows_of_the_right_types(spark, tmp_path):
    e = spark.createDataFrame([entry("queue", 2.0, "q", num_items=3, elapsed=1.5)], stats.ENTRIES)
    (r,) = stats.entry_tables()["queue_stats"](e).collect()
    assert (r.name, r.num_items, r.elapsed) == ("q", 3, 1.5)
    (r,) = stats.entry_tables()["event_stats"](spark.createDataFrame([entry("event", 2.0, "e")], stats.ENTRIES)).select(F.col("event_name").alias("n")).collect()
    assert r.n == "e"
