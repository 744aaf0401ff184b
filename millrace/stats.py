"""Run statistics: their tables, the three queries on them, summaries and running figures."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Mapping, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from millrace.experiments import best_path  # noqa: F401  kept under this name, too

TASK_STATS = "id bigint, timestamp double, name string, num_tasks bigint, num_failures bigint, ave_time double, p90_time double, p99_time double"
QUEUE_STATS = (
    "id bigint, timestamp double, name string, elapsed double, num_items bigint, ave_put_time double, ave_get_time double, p90_put_time double, "
    "p99_put_time double, p90_get_time double, p99_get_time double, occupancy_rate double"
)
EVENT_STATS = "id bigint, timestamp double, event_name string"


def query(df: DataFrame, *, name: str | None = None, start: float | None = None, end: float | None = None, name_column: str = "name", ascending: bool = False) -> DataFrame:
    """Rows of a stats table by name and time window, both ends included; newest first, or oldest first."""
    if name is not None:
        df = df.where(F.col(name_column) == name)
    if start is not None:
        df = df.where(F.col("timestamp") >= start)
    if end is not None:
        df = df.where(F.col("timestamp") <= end)
    return df.orderBy(F.col("timestamp").asc() if ascending else F.col("timestamp").desc())


def _ratio(total: Column, weight: Column) -> Column:
    return F.when(weight > 0, total / weight).otherwise(F.lit(0.0))


def task_summary(tasks: DataFrame) -> DataFrame:
    """Totals by name: tasks, failures, mean time weighted by tasks, success rate in percent, log entries."""
    n, bad = F.sum("num_tasks"), F.sum("num_failures")
    return tasks.groupBy("name").agg(
        n.alias("total_tasks"),
        bad.alias("total_failures"),
        _ratio(F.sum(F.col("ave_time") * F.col("num_tasks")), n).alias("avg_time"),
        ((n - bad) / F.greatest(F.lit(1), n) * 100).alias("success_rate"),
        F.count(F.lit(1)).alias("entries"),
    ).orderBy("name")


def queue_summary(queues: DataFrame) -> DataFrame:
    """Totals by name: items, rate, and mean put time, get time and occupancy weighted by items."""
    n, t = F.sum("num_items"), F.sum("elapsed")
    mean = lambda c: _ratio(F.sum(F.col(c) * F.col("num_items")), n)
    return queues.groupBy("name").agg(
        n.alias("total_items"), _ratio(n, t).alias("avg_qps"), mean("ave_put_time").alias("avg_put_time"), mean("ave_get_time").alias("avg_get_time"),
        mean("occupancy_rate").alias("avg_occupancy"), F.count(F.lit(1)).alias("entries"),
    ).orderBy("name")


def lap(df: DataFrame, name: str, order: str, n: str, mean: str) -> DataFrame:
    """Figures between one row of running totals and the next: lap_n, and lap_mean = (mean n - mean' n') / (n - n'), or 0."""
    w = Window.partitionBy(name).orderBy(order)
    n0, m0 = F.coalesce(F.lag(n).over(w), F.lit(0)), F.coalesce(F.lag(mean).over(w), F.lit(0.0))
    d = F.col(n) - n0
    return df.withColumn("lap_n", d).withColumn("lap_mean", F.when(d > 0, (F.col(mean) * F.col(n) - m0 * n0) / d).otherwise(F.lit(0.0)))


def qps(items: Column, elapsed: Column) -> Column:
    return F.when(elapsed > 0, items / elapsed).otherwise(F.lit(0.0))


def occupancy(empty: Column, elapsed: Column) -> Column:
    """The share of the time in which the queue had items; never below 0, and 0 without time."""
    return F.when(elapsed > 0, F.greatest(F.lit(0.0), 1 - empty / elapsed)).otherwise(F.lit(0.0))


def event_pairs(df: DataFrame, order: str, kind: str, start: str, stop: str, within: list[str] | None = None) -> DataFrame:
    """Each stop with the earliest start before it that has no stop yet; stops without one are left out. (started, stopped).

    A stop is matched if it isn't beyond the starts so far: with m stops matched before it and s starts, if m < s. The
    number matched after i events is then s_i + min over j <= i of (e_j - s_j), capped at e_i, so that it needs only running sums
    and a running minimum, no fold.
    """
    within = within or []
    w = Window.partitionBy(*within).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    rows = df.where(F.col(kind).isin(start, stop)).withColumn("_d", F.when(F.col(kind) == start, 1).otherwise(-1))
    rows = rows.withColumn("_level", F.sum("_d").over(w))
    # Stops that found nothing so far: how far the level fell below 0.
    rows = rows.withColumn("_lost", F.greatest(F.lit(0), -F.min("_level").over(w)))
    rows = rows.withColumn("_stops", F.sum(F.when(F.col(kind) == stop, 1).otherwise(0)).over(w))
    before = Window.partitionBy(*within).orderBy(order)
    rows = rows.withColumn("_was", F.coalesce(F.lag("_lost").over(before), F.lit(0)))
    starts = rows.where(F.col(kind) == start)
    starts = starts.withColumn("_k", F.row_number().over(before))
    stops = rows.where((F.col(kind) == stop) & (F.col("_lost") == F.col("_was"))).withColumn("_k", F.col("_stops") - F.col("_lost"))
    a = starts.select(*within, "_k", F.col(order).alias("started"))
    return a.join(stops.select(*within, "_k", F.col(order).alias("stopped")), [*within, "_k"]).select(*within, "started", "stopped")


def running_best(df: DataFrame, order: str, value: str, *, within: list[str] | None = None) -> DataFrame:
    """best (largest value so far) and is_new (is the row better than all before it; the first is)."""
    w = Window.partitionBy(*(within or [])).orderBy(order)
    before = F.max(value).over(w.rowsBetween(Window.unboundedPreceding, -1))
    return df.withColumn("best", F.max(value).over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn(
        "is_new", before.isNull() | (F.col(value) > before)
    )


class P2:
    """The P-square estimate of one percentile in five markers, after Jain and Chlamtac (1985)."""

    def __init__(self, percent: float):
        self.p, self.seen, self.heights = percent / 100, 0, []
        self.at = self.want = self.step = None

    def add(self, x: float) -> None:
        self.seen += 1
        h = self.heights
        if self.seen <= 5:
            h.append(x)
            if self.seen == 5:
                h.sort()
                p = self.p
                self.at, self.want, self.step = [0, 1, 2, 3, 4], [0, 2 * p, 4 * p, 2 + 2 * p, 4], [0, p / 2, p, (1 + p) / 2, 1]
            return
        h[0], h[4] = min(h[0], x), max(h[4], x)
        cell = next((k for k in range(3) if x < h[k + 1]), 3)
        self.at = [a + (k > cell) for k, a in enumerate(self.at)]
        self.want = [a + b for a, b in zip(self.want, self.step, strict=True)]
        for k in (1, 2, 3):
            ahead, behind = self.at[k + 1] - self.at[k], self.at[k] - self.at[k - 1]
            off = self.want[k] - self.at[k]
            if (off >= 1 and ahead > 1) or (off <= -1 and behind > 1):
                s = 1 if off > 0 else -1
                up, down = (h[k + 1] - h[k]) / ahead, (h[k] - h[k - 1]) / behind
                new = h[k] + s / (ahead + behind) * ((behind + s) * up + (ahead - s) * down)
                h[k] = new if h[k - 1] < new < h[k + 1] else h[k] + (up if s > 0 else -down)
                self.at[k] += s

    @property
    def value(self) -> float:
        if not self.seen:
            return 0.0
        if self.seen < 5:
            return sorted(self.heights)[min(int(self.seen * self.p), self.seen - 1)]
        return self.heights[2]


def p2_percentiles(df: DataFrame, name: str, order: str, value: str, percents: tuple[float, ...] = (90, 99)) -> DataFrame:
    """(name, count, and p90, p99, ...): P-square estimates over the values of each name, in order. The estimate depends on the
    order, so each name is one task's work, as a stream whose state is five markers for each percentile; percentile_approx is the
    parallel figure, with other numbers."""
    columns = [f"p{p:g}" for p in percents]
    rows = df.select(name, order, F.col(value).cast("double").alias("_v")).repartition(name).sortWithinPartitions(name, order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, n, marks, kind = None, 0, None, None

        def row() -> pa.RecordBatch:
            columns_ = [pa.array([key], kind), pa.array([n], pa.int64()), *(pa.array([m.value], pa.float64()) for m in marks)]
            return pa.RecordBatch.from_arrays(columns_, names=[name, "count", *columns])

        for batch in batches:
            kind = batch.schema.field(0).type
            for group, x in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if marks is None or group != key:
                    if marks is not None:
                        yield row()
                    key, n, marks = group, 0, [P2(p) for p in percents]
                n += 1
                for m in marks:
                    m.add(x)
        if marks is not None:
            yield row()

    kind = df.schema[name].dataType.simpleString()
    return rows.mapInArrow(run, f"{name} {kind}, count long, {', '.join(f'{c} double' for c in columns)}")


def task_row(df: DataFrame, name: str, seconds: str = "_seconds", failed: str = "_error") -> DataFrame:
    """A row of task statistics from the invocations of a stage (see operators.functions.mapped): tasks, failures, and mean, P90 and
    P99 of the seconds that successful ones took, 0 where there are none."""
    good = F.when(F.col(failed).isNull(), F.col(seconds))
    each = F.percentile_approx(good, [0.9, 0.99], 10_000)
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return df.agg(
        F.lit(name).alias("name"), F.count(F.lit(1)).alias("num_tasks"), F.count(F.col(failed)).alias("num_failures"), zero(F.avg(good)).alias("ave_time"),
        zero(F.get(each, F.lit(0))).alias("p90_time"), zero(F.get(each, F.lit(1))).alias("p99_time"),
    )


def read_log(spark, path: str, schema: str) -> DataFrame:
    """A log of tab-separated values with a header line; rows in no promised order."""
    return spark.read.csv(path, sep="\t", header=True, schema=schema)


def append_log(df: DataFrame, path: str) -> None:
    """Adds rows to a log, a folder of such files; all of them or, if the job fails, none."""
    df.write.mode("append").csv(path, sep="\t", header=True)


def comparison(throughput: Column, step_ms: Column, duration: Column) -> tuple[Column, Column]:
    """(kind, value) by which runs are compared, larger being better: throughput, else step time, else duration, if positive."""
    kind = F.when(throughput > 0, "throughput").when(step_ms > 0, "step_ms").when(duration > 0, "duration_s").otherwise("none")
    value = F.when(throughput > 0, throughput.cast("double")).when(step_ms > 0, -step_ms.cast("double")).when(duration > 0, -duration.cast("double"))
    return kind, F.coalesce(value, F.lit(float("-inf")))


def mean_interval(df: DataFrame, name: str, value: str, quantile: float = 1.96) -> DataFrame:
    """(name, n, mean, low, high): an interval of the mean of repeated runs, of `quantile` standard errors to each side."""
    out = df.groupBy(name).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("_s"))
    half = F.coalesce(quantile * F.col("_s") / F.sqrt("n"), F.lit(0.0))
    return out.select(name, "n", "mean", (F.col("mean") - half).alias("low"), (F.col("mean") + half).alias("high"))


#: Two-sided 95 % quantiles of Student's t by degrees of freedom (fixed values); between them the next lower degrees count, which is the wider interval.
T95 = {
    1: 12.706, 2: 4.303, 3: 3.182, 4: 2.776, 5: 2.571, 6: 2.447, 7: 2.365, 8: 2.306, 9: 2.262, 10: 2.228, 11: 2.201, 12: 2.179, 13: 2.160, 14: 2.145, 15: 2.131, 16: 2.120, 17: 2.110,
    18: 2.101, 19: 2.093, 20: 2.086, 25: 2.060, 30: 2.042, 40: 2.021, 60: 2.000, 120: 1.980, 1000: 1.962,
}


def t_interval(df: DataFrame, name: str, value: str) -> DataFrame:
    """(name, n, mean, low, high): the 95 % interval of the mean of repeated runs by Student's t. A single run has no width."""
    out = df.groupBy(name).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("_s"))
    quantile = F.lit(None).cast("double")
    for degrees, t in sorted(T95.items()):
        quantile = F.when(F.col("n") - 1 >= degrees, t).otherwise(quantile)
    half = F.coalesce(quantile * F.col("_s") / F.sqrt("n"), F.lit(0.0))
    return out.select(name, "n", "mean", (F.col("mean") - half).alias("low"), (F.col("mean") + half).alias("high"))


# -- intervals -------------------------------------------------------------------------------------------------

#: A sketch of durations: counts by steps of their logarithm. A quantile read from it is within ACCURACY of the true one, and sketches of any parts
#: of the data are merged by adding their counts. Durations up to LEAST seconds share a step.
ACCURACY = 0.01
_GAMMA = (1 + ACCURACY) / (1 - ACCURACY)
LEAST = 1e-9


def _step(seconds: Column) -> Column:
    return F.ceil(F.ln(F.greatest(seconds, F.lit(LEAST))) / math.log(_GAMMA))


def _seconds(step: Column) -> Column:
    """The middle of a step, by which no value in it is missed by more than ACCURACY."""
    return F.pow(F.lit(_GAMMA), step) * (2 / (1 + _GAMMA))


def sketched(calls: DataFrame, name: str, at: str, width: float, seconds: str = "_seconds", failed: str = "_error") -> DataFrame:
    """(name, bucket, step, n, failures, total) of invocations: counts of successful ones by interval and step of their duration, with the sum of these;
    failed ones have a null step. Rows of this kind, of any parts of the calls, are merged by summing over name, bucket and step."""
    ok = F.col(failed).isNull()
    rows = calls.select(F.col(name).alias("name"), F.floor(F.col(at) / width).alias("bucket"), F.when(ok, _step(F.col(seconds))).alias("step"), F.when(ok, F.col(seconds)).alias("_s"), ok.alias("_ok"))
    return merged(rows.select("name", "bucket", "step", F.col("_ok").cast("long").alias("n"), (~F.col("_ok")).cast("long").alias("failures"), F.coalesce("_s", F.lit(0.0)).alias("total")))


def merged(sketches: DataFrame) -> DataFrame:
    return sketches.groupBy("name", "bucket", "step").agg(*[F.sum(c).alias(c) for c in ("n", "failures", "total")])


def _quantiles(counts: DataFrame, by: list[str], percents: Sequence[int]) -> DataFrame:
    """by and p90, p99, ... of counts (by, step, n): the value of the step in which the ceil(p / 100 N)-th smallest lies."""
    order = Window.partitionBy(*by).orderBy("step").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    total = Window.partitionBy(*by)
    ranked = counts.where("step is not null and n > 0").withColumn("_below", F.sum("n").over(order)).withColumn("_all", F.sum("n").over(total))
    return ranked.groupBy(*by).agg(*[_seconds(F.min(F.when(F.col("_below") * 100 >= F.col("_all") * p, F.col("step")))).alias(f"p{p}_time") for p in percents])


def interval_rows(sketches: DataFrame, width: float) -> DataFrame:
    """A row of task statistics for each name and interval in which something was called: (name, timestamp, num_tasks, num_failures, ave_time, p90_time,
    p99_time), timestamp being the interval's end. Figures of the interval alone; 0 where no call of it succeeded."""
    by = ["name", "bucket"]
    sums = sketches.groupBy(*by).agg(F.sum("n").alias("_n"), F.sum("failures").alias("num_failures"), F.sum("total").alias("_t"))
    found = sums.join(_quantiles(sketches, by, (90, 99)), by, "left")
    return found.select(
        "name", ((F.col("bucket") + 1) * F.lit(float(width))).alias("timestamp"), (F.col("_n") + F.col("num_failures")).alias("num_tasks"), "num_failures",
        _ratio(F.col("_t"), F.col("_n")).alias("ave_time"), F.coalesce("p90_time", F.lit(0.0)).alias("p90_time"), F.coalesce("p99_time", F.lit(0.0)).alias("p99_time"),
    )


def running_rows(sketches: DataFrame, width: float) -> DataFrame:
    """As interval_rows, but of all calls up to the end of each interval: counts are added up over intervals by step, then summed. A name's rows are those of
    its intervals times its steps, some hundreds each, whatever the number of calls."""
    by = ["name", "bucket"]
    so_far = Window.partitionBy("name", "step").orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    buckets, steps = sketches.select(*by).distinct(), sketches.groupBy("name", "step").agg(F.min("bucket").alias("_first"))
    # Each step from its first interval on.
    grid = buckets.join(steps, "name").where("bucket >= _first").drop("_first")
    key = F.coalesce("step", F.lit(-(2**62))).alias("_key")
    at = sketches.select("name", "bucket", key, "n", "failures", "total")
    full = grid.select("*", key).join(at, ["name", "bucket", "_key"], "left")
    sums = full.select("name", "bucket", "step", *[F.sum(F.coalesce(c, F.lit(0))).over(so_far).alias(c) for c in ("n", "failures", "total")])
    return interval_rows(sums, width)


def lap_rows(running: DataFrame) -> DataFrame:
    """Running rows with lap_n and lap_mean: what came between one row and the next, from their differences."""
    good = running.withColumn("_good", F.col("num_tasks") - F.col("num_failures"))
    return lap(good, "name", "timestamp", "_good", "ave_time").drop("_good")


# -- sinks -----------------------------------------------------------------------------------------------------


def append(stream: DataFrame, table: str, checkpoint: str):
    """A sink of statistics: each micro-batch is added to a Parquet table, which takes all of it or nothing."""
    return stream.writeStream.format("parquet").option("path", table).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


COMMITS = "_committed_batches"


def commit_batch(tables: Mapping[str, DataFrame], root: str, batch: int) -> None:
    """Writes the rows of one batch to several tables below root, all or nothing. Each table gets a folder of the batch; the batch counts once its row
    is in the table of commits, which is written last. Written again after a failure, a batch replaces its folders; one that
    has its row is left as it is."""
    spark = next(iter(tables.values())).sparkSession
    if _exists(spark, f"{root}/{COMMITS}/at={batch}/_SUCCESS"):
        return
    for name, rows in tables.items():
        rows.write.mode("overwrite").parquet(f"{root}/{name}/batch={batch}")
    spark.range(1).selectExpr(f"cast({batch} as long) batch").coalesce(1).write.mode("overwrite").parquet(f"{root}/{COMMITS}/at={batch}")


def _exists(spark, path: str) -> bool:
    sc = spark.sparkContext
    hadoop = sc._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(sc._jsc.hadoopConfiguration()).exists(hadoop)


def committed(spark, root: str, name: str, schema: str) -> DataFrame:
    """The rows of a table below root, of those batches that count, with batch. An empty one where there is none."""
    if not _exists(spark, f"{root}/{COMMITS}") or not _exists(spark, f"{root}/{name}"):
        return spark.createDataFrame([], f"{schema}, batch long")
    rows = spark.read.schema(f"{schema}, batch long").option("basePath", f"{root}/{name}").parquet(f"{root}/{name}")
    done = spark.read.schema("batch long").parquet(f"{root}/{COMMITS}").select("batch")
    return rows.join(done, "batch", "left_semi")


def sink(stream: DataFrame, root: str, checkpoint: str, split: Mapping[str, Callable[[DataFrame], DataFrame]]):
    """A sink of statistics in several tables: every micro-batch of the stream is split into rows of each, and committed to all of them together."""

    def each(df: DataFrame, batch: int) -> None:
        kept = df.persist()
        try:
            commit_batch({name: part(kept) for name, part in split.items()}, root, batch)
        finally:
            kept.unpersist()

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


#: Entries of a log of all three kinds in one stream: what entry_tables() splits.
ENTRIES = "kind string, timestamp double, name string, num_tasks bigint, num_failures bigint, ave_time double, p90_time double, p99_time double, elapsed double, num_items bigint, ave_put_time double, ave_get_time double, p90_put_time double, p99_put_time double, p90_get_time double, p99_get_time double, occupancy_rate double"


def entry_tables() -> dict[str, Callable[[DataFrame], DataFrame]]:
    """The three tables of a log of entries (ENTRIES) whose kind is 'task', 'queue' or 'event'; other kinds fail the batch. id is left to the reader, by
    timestamp and name."""
    names = lambda schema: [c.split()[0] for c in schema.split(", ") if c.split()[0] not in ("id", "event_name")]
    known = F.when(~F.coalesce(F.col("kind").isin("task", "queue", "event"), F.lit(False)), F.raise_error(F.concat(F.lit("unknown kind of entry: "), F.coalesce("kind", F.lit("null")))).cast("boolean")).otherwise(True)
    return {
        "task_stats": lambda df: df.where(known).where("kind = 'task'").select(*names(TASK_STATS)),
        "queue_stats": lambda df: df.where(known).where("kind = 'queue'").select(*names(QUEUE_STATS)),
        "event_stats": lambda df: df.where(known).where("kind = 'event'").select("timestamp", F.col("name").alias("event_name")),
    }
