"""Quality classifier: ordinal regression with cumulative links on graded ratings.

A text becomes hashed features: its words, the shapes of its tokens (letters, capitals, digits and punctuation, runs
collapsed), and coarse figures such as how many of its words are distinct. One weight vector is shared by
all grades; ordered thresholds cut its score: P(grade > k) = logistic(w.x - t_k). From these come the expected grade and
the tail probability by which documents are selected.

The model is fitted on a bounded sample of labelled rows (SAMPLE per grade at most), on the driver; features are made,
and documents scored, on the executors.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from millrace.llm.labelled import sample
from millrace.llm.words import Words, as_rows, buffers, byte_classes, find_words, mix, slices

FOLDS = 5  # documents of fold 0 are kept out of training
SAMPLE = 3_000  # labelled documents for each grade
GRADES = 32  # more distinct ratings than that are grouped into this many of about equal size, each with its mean as grade
BUCKETS = 1 << 15
STEPS = 150
RIDGE = 3e-3
KEEP = 0.5  # least probability of a grade above the lowest

_SHAPE = np.arange(256, dtype=np.uint8)
_SHAPE[ord("a") : ord("z") + 1] = ord("a")
_SHAPE[ord("A") : ord("Z") + 1] = ord("A")
_SHAPE[ord("0") : ord("9") + 1] = ord("0")
_SHAPE[0x80:] = ord("a")


@dataclass(frozen=True)
class Model:
    grades: tuple[float, ...]
    thresholds: np.ndarray
    weights: np.ndarray


def _shapes(column: pa.Array) -> Words:
    """Tokens with their characters replaced by kinds, and runs of one kind by one character."""
    data, offsets = buffers(column)
    kind = _SHAPE[data]
    keep = np.ones(len(kind), bool)
    keep[1:] = kind[1:] != kind[:-1]
    inner = offsets[1:-1]
    keep[inner[inner < len(kind)]] = True
    at = np.concatenate([[0], np.cumsum(keep)])[offsets]
    low = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(column), [None, pa.py_buffer(at.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(kind[keep]))])
    # Shapes tell capitals from small letters, which words don't; '~' stands for a capital.
    return find_words(_capitals(low), byte_classes("nonspace"))


def _capitals(column: pa.Array) -> pa.Array:
    offsets = column.buffers()[1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8).copy()
    data[data == ord("A")] = 0x7E
    return pa.LargeStringArray.from_buffers(len(column), offsets, pa.py_buffer(data))


def features(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row starts, buckets, values) of the texts: for each kind of feature, log(1 + count) scaled to unit length."""
    words, shapes = find_words(column, byte_classes("nonspace")), _shapes(column)
    rows = words.rows
    parts = []
    distinct = np.zeros(rows)
    for kind, w in enumerate((words, shapes)):
        bucket = (mix(w.hash + np.uint64(kind * 7919 + 1)) % np.uint64(BUCKETS - 64)).astype(np.int64)
        key, n = np.unique(w.row * BUCKETS + bucket, return_counts=True)
        row = key // BUCKETS
        value = np.log1p(n)
        norm = np.sqrt(np.bincount(row, weights=value * value, minlength=rows))
        parts.append((row, key % BUCKETS, (0.5 if kind == 0 else 2.0) * value / norm[row]))
        if kind == 0:
            distinct = np.bincount(row, minlength=rows)
    n = np.maximum(words.counts(), 1)
    data, offsets = buffers(column)
    size = np.maximum(np.diff(offsets), 1)

    def share(mask: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(mask)])
        return (total[offsets[1:]] - total[offsets[:-1]]) / size

    letters = byte_classes("alnum")[data]
    space = ~byte_classes("nonspace")[data]
    capital = (data >= ord("A")) & (data <= ord("Z"))
    digit = (data >= ord("0")) & (data <= ord("9"))
    # Steps of the logarithm or of the share, each with a bucket of its own.
    figures = [
        np.clip(np.log2(n), 0, 15).astype(int),
        np.clip(8 * distinct / n, 0, 7).astype(int) + 16,
        np.clip(30 * share(~letters & ~space), 0, 11).astype(int) + 24,
        np.clip(20 * share(capital), 0, 11).astype(int) + 36,
        np.clip(20 * share(digit), 0, 7).astype(int) + 48,
        np.clip(size / n / 3, 0, 7).astype(int) + 56,
    ]
    for f in figures:
        parts.append((np.arange(rows), BUCKETS - 64 + f, np.ones(rows)))
    row, bucket, value = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.argsort(row, kind="stable")
    return np.searchsorted(row[order], np.arange(rows + 1)), bucket[order], value[order]


def _featurise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch, column in slices(batches, "text"):
        starts, bucket, value = features(column)
        offsets = pa.array(starts.astype(np.int32))
        yield pa.RecordBatch.from_arrays(
            [
                batch.column(batch.schema.get_field_index("label")),
                pa.ListArray.from_arrays(offsets, pa.array(bucket.astype(np.int32))),
                pa.ListArray.from_arrays(offsets, pa.array(value.astype(np.float32))),
            ],
            names=["label", "bucket", "value"],
        )


def _logistic(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def fit(starts: np.ndarray, bucket: np.ndarray, value: np.ndarray, grade: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(thresholds, weights) of the cumulative-link model for grades 0 .. k - 1, by Adam on the penalised likelihood.

    The thresholds are a first one and positive steps, so they stay in order.
    """
    n = len(grade)
    row = np.repeat(np.arange(n), np.diff(starts))
    share = np.clip(np.array([(grade > j).mean() for j in range(k - 1)]), 1e-3, 1 - 1e-3)
    cut = -np.log(share / (1 - share))
    theta = np.concatenate([cut[:1], np.log(np.maximum(np.diff(cut), 1e-2)), np.zeros(BUCKETS)])
    mean, square = np.zeros_like(theta), np.zeros_like(theta)
    balance = 1.0 / np.bincount(grade, minlength=k)[grade]
    balance *= n / balance.sum()
    for step in range(1, STEPS + 1):
        steps = np.exp(theta[1 : k - 1])
        cuts = theta[0] + np.concatenate([[0], np.cumsum(steps)])
        w = theta[k - 1 :]
        s = np.bincount(row, weights=value * w[bucket], minlength=n)
        above = _logistic(s[:, None] - cuts[None, :])  # P(grade > j)
        upper = np.concatenate([np.ones((n, 1)), above], 1)[np.arange(n), grade]
        lower = np.concatenate([above, np.zeros((n, 1))], 1)[np.arange(n), grade]
        p = np.maximum(upper - lower, 1e-9)
        up, low = upper * (1 - upper) / p * balance, lower * (1 - lower) / p * balance
        by_score = -(up - low)
        by_cut = np.zeros(k - 1)
        for j in range(k - 1):
            by_cut[j] = up[grade == j + 1].sum() - low[grade == j].sum()
        tail = np.cumsum(by_cut[::-1])[::-1]
        g = np.concatenate([[tail[0]], tail[1:] * steps, np.bincount(bucket, weights=value * by_score[row], minlength=BUCKETS)]) / n
        g[k - 1 :] += RIDGE * w
        mean, square = 0.9 * mean + 0.1 * g, 0.99 * square + 0.01 * g * g
        theta = theta - 0.15 / (1 + step / 60) * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.99**step)) + 1e-8)
    return theta[0] + np.concatenate([[0], np.cumsum(np.exp(theta[1 : k - 1]))]), theta[k - 1 :].astype(np.float64)


def _grouped(labels: DataFrame, label: str) -> DataFrame:
    """labels with at most GRADES distinct ratings, as doubles: where there are more, groups between quantiles get their means."""
    labels = labels.withColumn(label, F.col(label).cast("double")).where(F.col(label).isNotNull() & ~F.isnan(label))
    if labels.select(label).distinct().limit(GRADES + 1).count() <= GRADES:
        return labels
    edges = sorted(set(labels.approxQuantile(label, [k / GRADES for k in range(1, GRADES)], 1e-3)))
    group = sum((F.when(F.col(label) > e, 1).otherwise(0) for e in edges), F.lit(0))
    placed = labels.withColumn("_group", group)
    means = placed.groupBy("_group").agg(F.avg(label).alias("_mean"))
    return placed.join(F.broadcast(means), "_group").withColumn(label, F.col("_mean")).drop("_group", "_mean")


def train(docs: DataFrame, labels: DataFrame, *, label: str = "quality", per_grade: int = SAMPLE) -> Model:
    """A model from at most per_grade labelled documents of each grade outside the held-out fold.

    Ratings are doubles; every rating counts, beyond GRADES distinct ones in groups. Of ratings given twice to one
    document, the largest holds; null and NaN ratings are none. With fewer than two grades there is nothing to order:
    every document then gets the one grade seen, or 0. Empty tables of documents or labels are such a case.
    """
    labels = _grouped(labels.select("doc_id", label), label)
    seen = [r[0] for r in labels.groupBy(label).count().orderBy(label).select(label).collect()]  # GRADES rows at most
    found = sample(docs, labels, label, FOLDS, {g: per_grade for g in seen}) if seen else None
    rows = found.select("text", "label").mapInArrow(_featurise, "label double, bucket array<int>, value array<float>").toArrow() if seen else None
    grades = sorted(set(rows["label"].to_pylist())) if seen else []
    if len(grades) < 2:
        return Model(tuple(grades or [0.0]), np.empty(0), np.zeros(BUCKETS))
    rows = rows.combine_chunks()
    lists = rows["bucket"].combine_chunks()
    lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
    values = rows["value"].combine_chunks()
    values = values.chunk(0) if isinstance(values, pa.ChunkedArray) else values
    grade = np.searchsorted(grades, rows["label"].to_numpy())
    thresholds, weights = fit(lists.offsets.to_numpy(), lists.flatten().to_numpy(), values.flatten().to_numpy().astype(np.float64), grade, len(grades))
    return Model(tuple(grades), thresholds, weights)


def _scorer(shared, text: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        grades = np.array(model.grades, np.float64)
        for batch, column in slices(batches, text):
            starts, bucket, value = features(column)
            row = np.repeat(np.arange(len(column)), np.diff(starts))
            s = np.bincount(row, weights=value * model.weights[bucket], minlength=len(column))
            above = _logistic(s[:, None] - model.thresholds[None, :])
            expected = grades[0] + above @ np.diff(grades)
            tail = above[:, 0] if above.shape[1] else np.ones(len(column))
            yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index("row")), pa.array(expected), pa.array(tail)], names=["row", "expected_grade", "tail"])

    return run


def graded(docs: DataFrame, model: Model, *, text: str = "text") -> DataFrame:
    """Every row of docs as `row`, with expected_grade and tail, the probability of a grade above the lowest.

    Whole texts are read. Null and empty texts have only the features of an empty text. Other columns pass, whatever
    their names; repeated rows are scored alike.
    """
    rows = as_rows(docs)
    schema = T.StructType([rows.schema["row"], T.StructField("expected_grade", T.DoubleType()), T.StructField("tail", T.DoubleType())])
    return rows.mapInArrow(_scorer(docs.sparkSession.sparkContext.broadcast(model), text), schema)


def good(docs: DataFrame, model: Model, least: float = KEEP) -> DataFrame:
    """The rows of docs whose tail probability is at least `least` (a row just at it stays), unchanged."""
    return graded(docs, model).where(F.col("tail") >= least).select("row.*")


def op4_quality(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return graded(docs, model).select("row.doc_id", "expected_grade", F.col("tail").alias("tail_probability"), (F.col("tail") >= KEEP).alias("kept"))
