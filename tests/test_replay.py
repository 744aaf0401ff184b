"""Continuous sources with numbered epochs, barriers, and folds over keyed streams."""

import threading
import time

import pytest
from pyspark.sql import functions as F

from millrace.streaming import replay, state


def write(spark, folder, values, epoch=None):
    path = str(folder) if epoch is None else f"{folder}/epoch={epoch}"
    spark.createDataFrame([(v,) for v in values], "v long").coalesce(2).write.mode("append").parquet(path)


def test_a_table_again_and_again(spark, tmp_path):
    write(spark, tmp_path / "t", range(10))
    write(spark, tmp_path / "t", range(10, 15))
    seen = []

    def each(df, batch):
        seen.append((batch, sorted((r.epoch, r.source, r.v) for r in df.collect())))

    stream = replay.replayed(spark, f"file://{tmp_path}/t", "v long", epochs=3)
    assert stream.isStreaming and replay.run_epochs(stream, each, f"{tmp_path}/c") == 2
    assert [b for b, _ in seen] == [0, 1, 2] and all(rows == [(b, 0, v) for v in range(15)] for b, rows in seen)
    # Started again, it goes on behind the last epoch that was finished.
    seen.clear()
    replay.run_epochs(replay.replayed(spark, f"file://{tmp_path}/t", "v long", epochs=5), each, f"{tmp_path}/c")
    assert [b for b, _ in seen] == [3, 4] and all(rows == [(b, 0, v) for v in range(15)] for b, rows in seen)


def test_an_epoch_that_fails_comes_again(spark, tmp_path):
    write(spark, tmp_path / "t", range(4))
    seen, broken = [], [True]

    def each(df, batch):
        if batch == 1 and broken:
            broken.clear()
            raise ValueError("no space left")
        seen.append((batch, sorted((r.epoch, r.v) for r in df.collect())))

    with pytest.raises(Exception, match="no space left"):
        replay.run_epochs(replay.replayed(spark, f"file://{tmp_path}/t", "v long", epochs=3), each, f"{tmp_path}/c")
    replay.run_epochs(replay.replayed(spark, f"file://{tmp_path}/t", "v long", epochs=3), each, f"{tmp_path}/c")
    assert seen == [(b, [(b, v) for v in range(4)]) for b in range(3)]


def test_sources_wait_for_each_other(spark, tmp_path):
    a, b, seen = tmp_path / "a", tmp_path / "b", []
    for e in range(3):  # a is fast, b slow
        write(spark, a, [10 * e, 10 * e + 1], e)
    write(spark, b, [100], 0)

    def each(df, batch):
        seen.append((batch, sorted((r.epoch, r.source, r.v) for r in df.collect())))

    query = replay.aligned(spark, [f"file://{a}", f"file://{b}"], "v long").writeStream.foreachBatch(each).option("checkpointLocation", f"{tmp_path}/c").start()
    try:
        query.processAllAvailable()
        assert seen == [(0, [(0, 0, 0), (0, 0, 1), (0, 1, 100)])]  # what a has more waits
        write(spark, b, [101], 1)
        query.processAllAvailable()
        assert seen[1:] == [(1, [(1, 0, 10), (1, 0, 11), (1, 1, 101)])]
        write(spark, b, [], 2)
        query.processAllAvailable()
        assert seen[2:] == [(2, [(2, 0, 20), (2, 0, 21)])]
    finally:
        query.stop()


def test_own_names(spark, tmp_path):
    with pytest.raises(ValueError, match="epoch"):
        replay.replayed(spark, str(tmp_path), "epoch long")
    with pytest.raises(ValueError):
        replay.aligned(spark, [], "v long")


class Pairs:
    """Sums of two values at a time."""

    def __init__(self):
        self.values = []

    def accumulate(self, row):
        self.values.append(int(row["v"]))
        return self.flush() if len(self.values) == 2 else None

    def flush(self):
        out = {"n": len(self.values), "total": sum(self.values)} if self.values else None
        self.values = []
        return out


def keyed(spark, folder, rows):
    spark.createDataFrame(rows, "k string, v long").coalesce(1).write.mode("append").parquet(str(folder))


def stream(spark, folder):
    return spark.readStream.schema("k string, v long").option("maxFilesPerTrigger", 1).parquet(str(folder))


def run(df, tmp_path, seen):
    query = df.writeStream.foreachBatch(lambda d, b: seen.append((b, sorted(tuple(r) for r in d.collect())))).option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    query.awaitTermination()


def test_a_fold_over_batches_and_restarts(spark, tmp_path):
    keyed(spark, tmp_path / "in", [("a", 3), ("a", 1), ("a", 2), ("b", 9)])
    seen = []
    make = lambda: state.folded(stream(spark, tmp_path / "in"), "k", Pairs, "n long, total long", order="v")
    run(make(), tmp_path, seen)
    assert seen == [(0, [("a", 2, 3)])]  # 1 + 2; 3 is kept
    keyed(spark, tmp_path / "in", [("b", 1), ("a", 10)])
    run(make(), tmp_path, seen)  # from the checkpoint
    assert seen[1:] == [(1, [("a", 2, 13), ("b", 2, 10)])]


def test_a_fold_flushed_at_epochs(spark, tmp_path):
    keyed(spark, tmp_path / "in", [("a", 1), ("a", 2), ("a", 3)])
    time.sleep(1.1)  # files are taken by their time
    keyed(spark, tmp_path / "in", [("a", 4)])
    seen = []
    run(state.folded(stream(spark, tmp_path / "in"), "k", Pairs, "n long, total long", order="v", flush_at_epoch=True), tmp_path, seen)
    assert seen == [(0, [("a", 1, 3), ("a", 2, 3)]), (1, [("a", 1, 4)])]


def test_a_quiet_key_is_flushed(spark, tmp_path):
    keyed(spark, tmp_path / "in", [("a", 5)])
    seen, done = [], threading.Event()

    def each(df, batch):
        rows = sorted(tuple(r) for r in df.collect())
        seen.extend(rows)
        if rows:
            done.set()

    folded = state.folded(stream(spark, tmp_path / "in"), "k", Pairs, "n long, total long", quiet=1.0)
    query = folded.writeStream.foreachBatch(each).option("checkpointLocation", f"{tmp_path}/c").trigger(processingTime="500 milliseconds").start()
    try:
        assert done.wait(90) and seen == [("a", 1, 5)]
    finally:
        query.stop()


def test_one_way_to_flush(spark):
    with pytest.raises(ValueError):
        state.folded(spark.readStream.format("rate").load().withColumn("k", F.lit("a")), "k", Pairs, "n long", flush_at_epoch=True, quiet=1.0)
