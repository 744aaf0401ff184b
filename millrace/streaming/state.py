"""Folds of a user's own over keyed streams: an object for each key, kept across micro-batches, flushed at epochs' ends or when a key is quiet."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_PROVIDER_KEY = "spark.sql.streaming.stateStore.providerClass"


class _Fold(StatefulProcessor):
    def __init__(self, make: Callable[[], object], key: str, columns: list[str], order: str | None, flush_at_epoch: bool, quiet_ms: int | None):
        self.make, self.key, self.columns, self.order, self.flush_at_epoch, self.quiet_ms = make, key, columns, order, flush_at_epoch, quiet_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.fold = handle.getValueState("fold", "state binary")

    def _frame(self, key, outs: list[dict]):
        import pandas as pd

        rows = [{self.key: key, **o} for o in outs if o is not None]
        return pd.DataFrame(rows, columns=[self.key, *self.columns])

    def _load(self):
        return pickle.loads(self.fold.get()[0]) if self.fold.exists() else self.make()

    def handleInputRows(self, key, rows, timerValues) -> Iterator:
        fold = self._load()
        frames = rows
        if self.order is not None:
            import pandas as pd

            frames = [pd.concat(list(rows)).sort_values(self.order, kind="stable")]
        for frame in frames:
            yield self._frame(key[0], [fold.accumulate(r) for r in frame.to_dict("records")])
        if self.flush_at_epoch:
            yield self._frame(key[0], [fold.flush()])
            return
        self.fold.update((pickle.dumps(fold),))
        if self.quiet_ms is not None:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer if isinstance(timer, int) else timer[0])
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.quiet_ms)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator:
        if self.fold.exists():
            fold = self._load()
            self.fold.clear()
            yield self._frame(key[0], [fold.flush()])

    def close(self) -> None:
        pass


def folded(
    stream: DataFrame, key: str, make: Callable[[], object], results: str, *, order: str | None = None, flush_at_epoch: bool = False, quiet: float | None = None
) -> DataFrame:
    """(key, *results): what a fold of the user's gives for each key of a stream. make() gives an object with accumulate(row), a dict or None for each row,
    and flush(), the same for what it has gathered so far; it must pickle.

    The object is the key's state, kept over micro-batches and restarts. flush_at_epoch: it is flushed and dropped at the end of each
    micro-batch (an epoch, see streaming.replay). quiet: it is flushed and dropped when the key has had no rows for so many seconds, by a timer.
    Without either it ends with the stream, unflushed, as a key may always have more rows.

    Rows of a key come a frame at a time, as they arrive. With an order, a key's rows of one micro-batch are sorted by that column first, which holds
    those rows in memory; other keys' rows, and those of other micro-batches, are never held. Needs the state store provider PROVIDER,
    which is set in the session if no other one is.
    """
    from pyspark.sql.types import StructType

    if flush_at_epoch and quiet is not None:
        raise ValueError("a fold is flushed at epochs' ends or when its key is quiet, not both")
    spark = stream.sparkSession
    if "RocksDB" not in spark.conf.get(_PROVIDER_KEY, ""):
        spark.conf.set(_PROVIDER_KEY, PROVIDER)
    kind, columns = stream.schema[key].dataType.simpleString(), StructType.fromDDL(results).names
    processor = _Fold(make, key, columns, order, flush_at_epoch, None if quiet is None else int(quiet * 1000))
    return stream.groupBy(key).transformWithStateInPandas(processor, f"{key} {kind}, {results}", "append", "ProcessingTime" if quiet is not None else "None")
