"""Continuous sources as Structured Streaming: one epoch is one micro-batch."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from millrace.operators import batch


def file_epochs(spark: SparkSession, folder: str, schema: str, files: int = 1) -> DataFrame:
    """A stream of Parquet files, so many to an epoch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(folder)


def check_same_mode(sources: Sequence[DataFrame]) -> None:
    if len({s.isStreaming for s in sources}) > 1:
        raise ValueError("continuous and finite sources can't be mixed")


def run_epochs(stream: DataFrame, each: Callable[[DataFrame, int], None], checkpoint: str, timeout: float | None = None) -> None:
    """Runs `each` on the rows of every epoch that is there, then returns. Errors of an epoch surface here."""
    if not stream.isStreaming:
        raise ValueError("not a continuous source")
    query = stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    if not query.awaitTermination(timeout) and timeout is not None:
        query.stop()
        raise TimeoutError("the epochs took too long")


def epoch_batches(stream: DataFrame, n: int, order: Sequence[str], item: str, sink: str, checkpoint: str, *, drop_last: bool = False) -> None:
    """Batches within each epoch, appended to a Parquet table with the epoch's number; an epoch's rest is flushed (or dropped) at
    its end. An epoch that is run again after a failure replaces what it wrote before."""

    def each(df: DataFrame, epoch: int) -> None:
        out = batch.batches(df, n, order, F.col(item), drop_last=drop_last)
        out.write.mode("overwrite").parquet(f"{sink}/epoch={epoch}")

    run_epochs(stream, each, checkpoint)


def windowed_counts(stream: DataFrame, time: str, key: str, *, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts by event-time window and key, with a watermark that bounds the state."""
    return stream.withWatermark(time, late).groupBy(F.window(time, width), key).agg(F.count(F.lit(1)).alias("n"))


def session_counts(stream: DataFrame, time: str, key: str, *, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    return stream.withWatermark(time, late).groupBy(F.session_window(time, gap), key).agg(F.count(F.lit(1)).alias("n"))


def fold_stream(stream: DataFrame, key: str, size: str, threshold: int, order: str | None = None) -> DataFrame:
    """A keyed fold over a stream: (key, n, total) each time the sizes gathered for a key reach the threshold.

    State is two numbers for each key, kept by applyInPandasWithState across micro-batches. A key's rows of one micro-batch are folded in
    the order of a column, or without one as they arrive.
    """
    from pyspark.sql.streaming.state import GroupStateTimeout

    kind = stream.schema[key].dataType.simpleString()

    def step(k, frames, state):
        import pandas as pd

        n, total = state.get if state.exists else (0, 0)
        rows = []
        batch = pd.concat(list(frames))  # a key's rows of one micro-batch
        for s in (batch.sort_values(order) if order else batch)[size].tolist():
            n, total = n + 1, total + int(s)
            if total >= threshold:
                rows.append((k[0], n, total))
                n, total = 0, 0
        state.update((n, total))
        yield pd.DataFrame(rows, columns=[key, "n", "total"])

    return stream.groupBy(key).applyInPandasWithState(step, f"{key} {kind}, n long, total long", "n long, total long", "append", GroupStateTimeout.NoTimeout)
