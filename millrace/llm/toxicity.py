"""Toxicity by compression distance: two zstandard dictionaries, one of toxic and one of ordinary text.

1. A window is a word of a text, A-Z lower-cased, between blanks; longer words are cut into windows of WINDOW bytes. Its distance is its length
   compressed with the ordinary dictionary less its length compressed with the toxic one, or 0 if that is less, or if it has no MATCH bytes
   in common with the toxic one. All windows of a text are looked at.
2. Dictionaries are trained on windows of labelled texts: what a dictionary holds is chosen by the number of texts that share a window. The toxic one
   takes those that LEAST toxic texts or more have, RATIO times as often as ordinary ones; the ordinary one those that most ordinary
   texts have. Frequent windows stand last, where they are cheapest to refer to. Texts count alike, whatever their language or length, so what
   marks toxic texts of a rare language isn't crowded out by that of a frequent one, and copies of a text count once.
3. Every window is compressed behind an anchor that both dictionaries hold. So both results have a section of references, whose fixed
   cost would otherwise hide a match of a short word: with the anchor, it costs three bytes, without it seven.
4. A document's figures (its largest distances, also as shares of their windows, and how many reach several thresholds) go into a logistic curve. It is
   calibrated on figures of each of FOLDS_OF_TRAINING parts of the training documents from dictionaries of the others, and shifted so
   that 0.5 is the threshold which FALSE_ALARMS of these ordinary documents reach.

Dictionaries are raw content, so that short windows are stored with plain literals and each match counts in full.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, functions as F

from millrace.llm.labelled import held_out, sample
from millrace.llm.store import cut, drop
from millrace.llm.words import _LOWER, buffers, slices

FOLDS = 5
TOXIC_SAMPLE = 3_000
ORDINARY_SAMPLE = 6_000
FOLDS_OF_TRAINING = 4
WINDOW = 24
LEAST, RATIO = 3, 16
TOXIC_BYTES, ORDINARY_BYTES = 1 << 14, 1 << 15
FALSE_ALARMS = 0.02
LEVEL, MATCH = 6, 5
ANCHOR = bytes(range(128, 152))
PAD = bytes(range(1, 13))  # after a window, as zstandard finds no match in the last bytes of its input
DISTANCES, SHARES = (2, 3, 4, 5, 6), (0.2, 0.3, 0.4, 0.5, 0.6)
INPUTS = 1 + 2 + 3 + len(DISTANCES) + len(SHARES) + 2
CACHED = 1 << 18  # windows whose distance a task remembers

_WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


@dataclass(frozen=True)
class Model:
    toxic: bytes
    ordinary: bytes
    weights: tuple[float, ...]


def _compressor(dictionary: bytes):
    content = ANCHOR + b"\0" + dictionary  # no window goes on behind the anchor as the dictionary does
    parameters = zstandard.ZstdCompressionParameters.from_level(
        LEVEL, source_size=64, dict_size=len(content), min_match=MATCH, write_checksum=0, write_content_size=0, write_dict_id=0
    )
    data = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    data.precompute_compress(compression_params=parameters)
    return zstandard.ZstdCompressor(dict_data=data, compression_params=parameters).compress


def _pieces(word: bytes) -> list[bytes]:
    whole = b" " + word + b" "
    return [whole[k : k + WINDOW] for k in range(0, len(whole), WINDOW)]


def windows(text: bytes) -> list[bytes]:
    """The words of a text between blanks, longer ones cut; together they hold every byte of every word."""
    out = []
    for w in _WORD.findall(text):
        if len(w) <= WINDOW - 2:
            out.append(b" " + w + b" ")
        else:
            out += _pieces(w)
    return out


class Distances(dict):
    """Distances of windows, 0 at least. What it remembers is bounded."""

    def __init__(self, toxic: bytes, ordinary: bytes):
        super().__init__()
        self.toxic, self.ordinary = _compressor(toxic), _compressor(ordinary)
        self.parts = {toxic[k : k + MATCH] for k in range(len(toxic) - MATCH + 1)}

    def __missing__(self, window: bytes) -> int:
        parts = self.parts
        # Without MATCH bytes in common the toxic dictionary makes no window shorter, and a byte of difference would be the ordinary one's chance.
        if any(window[k : k + MATCH] in parts for k in range(len(window) - MATCH + 1)):
            data = ANCHOR + window + PAD
            out = max(0, len(self.ordinary(data)) - len(self.toxic(data)))
        else:
            out = 0
        if len(self) >= CACHED:
            self.clear()
        self[window] = out
        return out


def _top(x: np.ndarray, n: int) -> list[float]:
    return [*np.sort(x)[::-1][:n].tolist(), *[0.0] * n][:n]


def figures(d: np.ndarray, sizes: np.ndarray) -> list[float]:
    """The inputs of the curve, from the distances and sizes of a document's windows; all 0 but the first where there are none."""
    if not len(d):
        return [1.0] + [0.0] * (INPUTS - 1)
    r = d / sizes
    beyond = [math.log1p(int((d >= t).sum())) for t in DISTANCES] + [math.log1p(int((r >= t).sum())) for t in SHARES]
    return [1.0, *_top(d, 2), *_top(r, 3), *beyond, float((d * d).sum() / len(d)), float((r * r).sum() / len(d))]


def _figures_of(text: bytes, distances: Distances) -> list[float]:
    pieces = windows(text)
    return figures(np.fromiter(map(distances.__getitem__, pieces), np.float64, len(pieces)), np.fromiter(map(len, pieces), np.float64, len(pieces)))


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Batches with their texts as bytes, A-Z lower-cased; null texts are empty."""
    for batch, column in slices(batches, "text"):
        data, offsets = buffers(column)
        whole, at = _LOWER[data].tobytes(), offsets.tolist()
        yield batch, [whole[at[i] : at[i + 1]] for i in range(len(at) - 1)]


def _windows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(window, part, label): each window of a text once."""
    for batch, texts in _texts(batches):
        column = lambda name: batch.column(batch.schema.get_field_index(name))  # noqa: E731, B023
        mine = [list(dict.fromkeys(windows(t))) for t in texts]
        rows = pa.array(np.repeat(np.arange(len(mine)), [len(m) for m in mine]))
        yield pa.RecordBatch.from_arrays([pa.array([w for m in mine for w in m], pa.binary()), column("part").take(rows), column("label").take(rows)], names=["window", "part", "label"])


def _figured(models: list[tuple[bytes, bytes]]):
    """(label, x) of labelled texts, each by the dictionaries of its part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        distances = [Distances(*m) for m in models]
        for batch, texts in _texts(batches):
            column = lambda name: batch.column(batch.schema.get_field_index(name))  # noqa: E731, B023
            x = [_figures_of(t, distances[p]) for t, p in zip(texts, column("part").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([column("label"), pa.array(x, pa.list_(pa.float64()))], names=["label", "x"])

    return run


#: The last model of a worker process and its distances, which the next task goes on with.
_LAST: dict[str, object] = {}


def _scored(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from millrace.llm import toxicity

        if toxicity._LAST.get("model") != model:
            toxicity._LAST.update(model=model, distances=Distances(model.toxic, model.ordinary))
        distances, weights = toxicity._LAST["distances"], np.array(model.weights)
        for batch, texts in _texts(batches):
            z = np.clip(np.array([_figures_of(t, distances) for t in texts]) @ weights, -30, 30)
            yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index("doc_id")), pa.array(1 / (1 + np.exp(-z)))], names=["doc_id", "score"])

    return run


def _fit(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Logistic regression by Newton steps, on columns scaled to unit deviation; weights for the columns as they are."""
    mean, scale = x.mean(0), x.std(0)
    mean[0], scale = 0.0, np.where(scale > 0, scale, 1.0)
    x = (x - mean) / scale
    w = np.zeros(x.shape[1])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p) + 1e-9)[:, None]).T @ x + ridge * np.eye(len(w)), x.T @ (y - p) - ridge * w)
        step *= min(1.0, 5 / max(1e-12, np.abs(step).max()))
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    w = w / scale
    w[0] -= mean[1:] @ w[1:]
    return w


def _threshold(z: np.ndarray, y: np.ndarray) -> float:
    """The lowest threshold that no more than FALSE_ALARMS of the ordinary documents reach, halfway to the next value above."""
    ordinary = np.sort(z[y == 0])
    last = ordinary[math.ceil((1 - FALSE_ALARMS) * len(ordinary)) - 1]
    above = z[z > last + 1e-9]
    return float((last + above.min()) / 2 if len(above) else last + 1)


def _content(rows: DataFrame, by: str, size: int) -> bytes:
    """The windows of rows that most texts (column `by`) share, `size` bytes of them at most, the most frequent one last. No more rows than
    fit come to the driver: a window has three bytes or more."""
    out, n = [], 0
    for r in rows.orderBy(F.desc(by), "window").limit(size // 3).select("window").collect():
        if n + len(r.window) > size:
            break
        out.append(bytes(r.window))
        n += len(r.window)
    return b"".join(reversed(out))


def dictionaries(counts: DataFrame, texts: dict[tuple[int, int], int], without: int | None = None) -> tuple[bytes, bytes]:
    """(toxic, ordinary) dictionaries of windows counted by part (columns toxic_0, ordinary_0, ..), of all parts or all but one. texts: the
    number of texts by (part, label)."""
    parts = [p for p in range(FOLDS_OF_TRAINING) if p != without]
    total = lambda kind: sum((F.col(f"{kind}_{p}") for p in parts[1:]), F.col(f"{kind}_{parts[0]}"))
    n = [sum(texts.get((p, y), 0) for p in parts) for y in (0, 1)]
    rows = counts.select("window", total("toxic").alias("a"), total("ordinary").alias("b"))
    marked = rows.where((F.col("a") >= LEAST) & (F.col("a") * n[0] >= RATIO * (F.col("b") + 0.5) * n[1]))
    return _content(marked, "a", TOXIC_BYTES), _content(rows.where("b >= 2"), "b", ORDINARY_BYTES)


def train(docs: DataFrame, labels: DataFrame) -> Model:
    """A model from at most TOXIC_SAMPLE + ORDINARY_SAMPLE labelled documents outside the held-out fold.

    Equal texts count once, and are toxic if one of them is. Without toxic or without ordinary documents in one of the parts, the model scores
    every document alike: the share of toxic ones seen.
    """
    # The corpus is read once for the sample, whose size is bounded; every later pass reads that table.
    some = sample(docs, labels, "toxic", FOLDS, {0: ORDINARY_SAMPLE, 1: TOXIC_SAMPLE})
    part = F.pmod(F.xxhash64("text", F.lit(7)), F.lit(FOLDS_OF_TRAINING)).cast("int")
    found = cut(some.groupBy("text").agg(F.max("label").cast("int").alias("label")).withColumn("part", part), "toxic-sample")
    n = {(r.part, r.label): r["count"] for r in found.groupBy("part", "label").count().collect()}
    if any(not n.get((p, y)) for p in range(FOLDS_OF_TRAINING) for y in (0, 1)):
        share = min(max(sum(c for (_, y), c in n.items() if y) / max(1, sum(n.values())), 1e-3), 1 - 1e-3)
        return Model(b" " * 8, b" " * 8, (math.log(share / (1 - share)), *[0.0] * (INPUTS - 1)))
    of = lambda p, y: F.count_if((F.col("part") == p) & (F.col("label") == y))
    kinds = [of(p, y).alias(f"{kind}_{p}") for y, kind in enumerate(("ordinary", "toxic")) for p in range(FOLDS_OF_TRAINING)]
    counts = cut(found.mapInArrow(_windows_of, "window binary, part int, label int").groupBy("window").agg(*kinds), "toxic-windows")
    parts = [dictionaries(counts, n, without=p) for p in range(FOLDS_OF_TRAINING)]
    rows = found.mapInArrow(_figured(parts), "label int, x array<double>").toArrow()
    x, y = np.array(rows["x"].to_pylist()), np.array(rows["label"].to_pylist(), float)
    weights = _fit(x, y)
    weights[0] -= _threshold(x @ weights, y)
    model = Model(*dictionaries(counts, n), tuple(map(float, weights)))
    drop(counts, found)
    return model


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score) for each row of docs (doc_id, text): 0.5 is the calibrated threshold, higher means the toxic label is likelier.

    Null and empty texts have no windows and get the curve's value at no distance. Whole texts are read, whatever their
    length. Repeated rows are scored each, alike; ties need no order. An empty table gives an empty one. Other columns are
    left out, so their names can't clash.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(_scored(model), f"doc_id {kind}, score double")


def op8_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    scored = score(docs, train(docs, labels))
    return scored.select("doc_id", held_out("doc_id", FOLDS).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
