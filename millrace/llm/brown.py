"""Language-model scoring with Brown classes: a class bigram with word emissions.

1. All training words are counted (a shuffle by word hash, so it grows with the corpus and no table of words is
   ever whole in one place).
2. The UNITS most frequent words are units of their own; every other word belongs at first to the unit of its last two
   bytes. Bigrams of units, counted over the whole training text, are a table of bounded size.
3. Exchange clustering moves units between classes, one by one, while the likelihood of the class bigram grows. Then, in ROUNDS rounds,
   all other ones of the FREQUENT most frequent words are exchanged at once on the executors: each goes to the class in which
   its own bigrams are most likely, the classes of all other words being those of the round before. Only words beyond them
   keep the class of their ending. The class bigram is counted anew after each round.
4. log P(text) = sum of log P(class | class before) + log P(word | class), an end token in a class of its own.
   Transitions are smoothed by Witten-Bell; emissions as (c + A) / (N_C + A (V_C + 1)), one slot for unknown words.

For scoring, counts of the FREQUENT most frequent words go to every task (a broadcast of bounded size); all other
words of a document meet their counts in a join by word hash.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from millrace.llm.labelled import held_out
from millrace.llm.store import cut, drop
from millrace.llm.words import Words, byte_classes, find_words, mix, slices

FOLDS = 10
UNITS = 1500
ENDINGS = 256
FREQUENT = 200_000
PARTS = 1 << 16  # parts of a step of counts that is too wide to be taken whole
CLASSES = 64
PASSES = 8
ROUNDS = 2
ALPHA = 0.1
AT_ONCE = 1 << 20  # words counted at once

# Units: 0 is the end of a text, then come endings, then frequent words.


def _endings(words: Words) -> np.ndarray:
    last = words.data[words.end - 1].astype(np.uint64)
    before = words.data[np.maximum(words.end - 2, words.start)].astype(np.uint64)
    return (mix(last * np.uint64(257) + before + np.uint64(3)) % np.uint64(ENDINGS)).astype(np.int64)


def _find(table: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places in the sorted table, whether they are there)."""
    if not len(table):
        return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
    at = np.minimum(np.searchsorted(table, keys), len(table) - 1)
    return at, table[at] == keys


def _units(words: Words, frequent: np.ndarray) -> np.ndarray:
    """The unit of each word; frequent: sorted hashes of the words that are units."""
    at, own = _find(frequent, words.hash)
    return np.where(own, 1 + ENDINGS + at, 1 + _endings(words))


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    classes = byte_classes("nonspace")
    for _, column in slices(batches, "text"):
        words = find_words(column, classes)
        unique, first, n = np.unique(words.hash, return_index=True, return_counts=True)
        yield pa.RecordBatch.from_arrays(
            [pa.array(unique.astype(np.int64)), pa.array(_endings(words)[first].astype(np.int32)), pa.array(n)], names=["word", "ending", "c"]
        )


def _number_words(frequent: np.ndarray):
    """(line): the words of each text as 32-bit units, frequent ones with units of their own, and an end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes = byte_classes("nonspace")
        for _, column in slices(batches, "text"):
            words = find_words(column, classes)
            line = np.zeros(len(words.hash) + words.rows, np.int32)
            line[np.arange(len(words.hash)) + words.row] = _units(words, frequent)
            offsets = np.concatenate([[0], words.first[1:] + np.arange(1, words.rows + 1)]) * line.itemsize
            buffers = [None, pa.py_buffer(offsets.astype(np.int32).tobytes()), pa.py_buffer(line.tobytes())]
            yield pa.RecordBatch.from_arrays([pa.Array.from_buffers(pa.binary(), words.rows, buffers)], names=["line"])

    return run


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(units, those behind them) of all lines, an end before the first one of a batch, some at a time."""
    for batch in batches:
        column = batch.column(0)
        if not len(column):
            continue
        offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
        units = np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]].view(np.int32)
        line = np.concatenate([np.zeros(1, np.int32), units])
        for at in range(0, len(line) - 1, AT_ONCE):
            part = line[at : at + AT_ONCE + 1]
            yield part[:-1], part[1:]


def _count_bigrams(of: np.ndarray, n: int):
    """(pair, c) of the n classes (or coarser units) `of` of all units."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for before, after in _neighbours(batches):
            pair, c = np.unique(of[before] * n + of[after], return_counts=True)
            both, back = np.unique(np.concatenate([total[0], pair]), return_inverse=True)
            total = both, np.bincount(back, weights=np.concatenate([total[1], c]), minlength=len(both)).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(total[0]), pa.array(total[1])], names=["pair", "c"])

    return run


def _count_sides(moving: np.ndarray, of: np.ndarray, classes: int):
    """(word, place, c): how often a word has class `place` before it or, from `classes` on, after it. moving: the word's number for each unit, or -1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for before, after in _neighbours(batches):
            word, other = moving[after], moving[before]
            first, second = word >= 0, other >= 0
            key = np.concatenate([word[first] * 2 * classes + of[before[first]], (other[second] * 2 + 1) * classes + of[after[second]]])
            key, n = np.unique(key, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(key // (2 * classes)), pa.array((key % (2 * classes)).astype(np.int32)), pa.array(n)], names=["word", "place", "c"])

    return run


def _likeliest(weights: np.ndarray):
    """(word, class): the class with the largest sum of counts times weights (place, class)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sides = batch.column(1)
            row = np.repeat(np.arange(batch.num_rows), np.diff(sides.offsets.to_numpy()))
            flat = sides.flatten()
            table = np.zeros((batch.num_rows, len(weights)))
            table[row, flat.field(0).to_numpy()] = flat.field(1).to_numpy()
            best = 1 + np.argmax((table @ weights)[:, 1:], 1) if batch.num_rows else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(best.astype(np.int32))], names=["word", "class"])

    return run


def exchanged(lines: DataFrame, of: np.ndarray, moving: np.ndarray, q: np.ndarray) -> np.ndarray:
    """The class of each unit of moving in which its bigrams with the classes `of` before and after it are most likely.

    q: counts of the class bigram. One word's counts are at most 2 * classes rows, whatever its frequency.
    """
    classes = len(q)
    out = np.ones(len(moving), np.int64)
    smooth = q + 1 / classes
    weights = np.log(np.concatenate([smooth, smooth.T])) - np.log(np.concatenate([np.broadcast_to(smooth.sum(0), q.shape), np.broadcast_to(smooth.sum(1), q.shape)]))
    number = np.full(len(of), -1)
    number[moving] = np.arange(len(moving))
    sides = lines.mapInArrow(_count_sides(number, of, classes), "word long, place int, c long").groupBy("word", "place").agg(F.sum("c").alias("c"))
    sides = sides.groupBy("word").agg(F.collect_list(F.struct("place", "c")).alias("sides"))
    best = sides.mapInArrow(_likeliest(weights), "word long, class int").toArrow()
    out[best["word"].to_numpy()] = best["class"].to_numpy()
    return out


def _bigrams(lines: DataFrame, of: np.ndarray, n: int) -> np.ndarray:
    """The n x n counts of bigrams of the classes `of`."""
    pairs = lines.mapInArrow(_count_bigrams(of, n), "pair long, c long").groupBy("pair").agg(F.sum("c").alias("c")).toArrow()
    out = np.zeros(n * n)
    out[pairs["pair"].to_numpy()] = pairs["c"].to_numpy()
    return out.reshape(n, n)


def _xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1e-300))


def exchange(bigrams: np.ndarray, classes: int, passes: int = PASSES) -> np.ndarray:
    """The class of each unit: unit 0 alone in class 0, the others moved one by one to the class in which the
    likelihood of the class bigram is largest, until a pass moves none."""
    units = len(bigrams)
    counts = bigrams.sum(0) + bigrams.sum(1)
    of = np.zeros(units, np.int64)
    ranked = np.argsort(-counts[1:], kind="stable") + 1
    of[ranked] = 1 + np.arange(units - 1) % (classes - 1)
    member = np.zeros((units, classes))
    member[np.arange(units), of] = 1
    after, before = bigrams @ member, bigrams.T @ member  # (unit, class) sums
    q = member.T @ after
    for _ in range(passes):
        moved = 0
        for u in ranked.tolist():
            if not counts[u]:
                continue
            a, own = of[u], bigrams[u, u]
            row, col = after[u].copy(), before[u].copy()
            row[a] -= own
            col[a] -= own
            q[a] -= row
            q[:, a] -= col
            q[a, a] -= own
            # What leads to u, and what u leads to, counts in the other side's sums wherever u goes.
            left, right = q.sum(1) + col, q.sum(0) + row
            gain = (_xlogx(q + row) - _xlogx(q)).sum(1) + (_xlogx(q + col[:, None]) - _xlogx(q)).sum(0)
            diagonal = np.diagonal(q)
            gain += _xlogx(diagonal + row + col + own) - _xlogx(diagonal + row) - _xlogx(diagonal + col) + _xlogx(diagonal)
            gain -= _xlogx(left + row.sum() + own) - _xlogx(left) + _xlogx(right + col.sum() + own) - _xlogx(right)
            gain[0] = -np.inf
            b = int(np.argmax(gain))
            if gain[b] <= gain[a] + 1e-9:
                b = a
            q[b] += row
            q[:, b] += col
            q[b, b] += own
            if b != a:
                of[u] = b
                moved += 1
                after[:, a] -= bigrams[:, u]
                after[:, b] += bigrams[:, u]
                before[:, a] -= bigrams[u]
                before[:, b] += bigrams[u]
        if not moved:
            break
    return of


@dataclass(frozen=True)
class Model:
    units: np.ndarray  # sorted hashes of the frequent words, whose classes are of their own
    of: np.ndarray  # class of the end, of each ending and of each frequent word
    transition: np.ndarray  # log10 P(class | class before)
    spread: np.ndarray  # log10 of each class's emission denominator
    frequent: np.ndarray  # sorted hashes of the frequent words
    counts: np.ndarray  # their counts
    tokens: int  # N
    types: int  # V
    ends: int


def _most_frequent(counts: DataFrame, most: int) -> DataFrame:
    """At most `most` of the most frequent words, without a sort: counts fall into steps of about 1 %, at most 4,096 of them,
    and as many of the upper steps are taken as fit. Of the next one, whose counts are alike, words are taken by their hash."""
    step = F.floor(F.log2(F.col("c").cast("double")) * 64)
    sizes = dict(counts.groupBy(step.alias("step")).count().collect())
    taken, least = 0, max(sizes, default=0) + 1
    for k in sorted(sizes, reverse=True):
        if taken + sizes[k] > most:
            break
        taken, least = taken + sizes[k], k
    rest = [k for k in sizes if k < least]
    chosen = step >= least
    if rest and taken < most:
        part = F.pmod(F.xxhash64("word"), F.lit(PARTS))
        parts = dict(counts.where(step == max(rest)).groupBy(part.alias("part")).count().collect())
        upto = 0
        while upto < PARTS and taken + parts.get(upto, 0) <= most:
            taken, upto = taken + parts.get(upto, 0), upto + 1
        chosen |= (step == max(rest)) & (part < upto)
    return counts.where(chosen).select("word", "ending", "c")


def train(docs: DataFrame, *, most_units: int = UNITS, most_frequent: int = FREQUENT, classes: int = CLASSES) -> tuple[Model, DataFrame]:
    """The model of docs (doc_id, text; only those outside the held-out fold), and the table (word hash, c) of all counts.

    most_units bounds the table of bigrams and the clustering on the driver, most_frequent the table that is broadcast; neither
    leaves a word out, as words beyond most_frequent have classes by their endings, and counts by the join.
    """
    n_units = 1 + ENDINGS + most_units
    docs = docs.where(~held_out("doc_id", FOLDS)).select("text")
    counts = cut(
        docs.mapInArrow(_count_words, "word long, ending int, c long").groupBy("word").agg(F.min("ending").alias("ending"), F.sum("c").alias("c")), "lm-counts"
    )
    ends = docs.count()
    of_ending = counts.groupBy("ending").agg(F.count(F.lit(1)).alias("v"), F.sum("c").alias("n")).toArrow().to_pydict()
    top = _most_frequent(counts, most_frequent).toArrow()
    hashes, endings, c = top["word"].to_numpy().astype(np.uint64), top["ending"].to_numpy(), top["c"].to_numpy()
    ranked = np.lexsort([hashes, -c])
    hashes, endings, c = hashes[ranked], endings[ranked], c[ranked]
    own = np.argsort(hashes[:most_units])
    units = hashes[:most_units][own]
    order = np.argsort(hashes)
    frequent = hashes[order]
    # Texts are split into words and these looked up once; all later counts are made from their numbers.
    lines = cut(docs.mapInArrow(_number_words(frequent), "line binary"), "lm-lines")
    at, own_unit = _find(units, frequent)
    unit_of = np.concatenate([np.arange(1 + ENDINGS), np.where(own_unit, 1 + ENDINGS + at, 1 + endings[order])]).astype(np.int64)
    bigrams = _bigrams(lines, unit_of, n_units)
    of = exchange(bigrams, classes)
    member = np.zeros((n_units, classes))
    member[np.arange(n_units), of] = 1
    # Words that aren't units are in the unit of their ending, so the class bigram follows without another pass.
    q = member.T @ bigrams @ member
    of = of[unit_of]
    moving = 1 + ENDINGS + np.flatnonzero(~own_unit)
    for _ in range(ROUNDS if len(moving) else 0):
        of[moving] = exchanged(lines, of, moving, q)
        q = _bigrams(lines, of, classes)
    drop(lines)
    # Words and tokens of each unit: of each ending, those that aren't frequent words.
    types, tokens = np.zeros(len(of)), np.zeros(len(of))
    types[1 + np.array(of_ending["ending"], np.int64)] = of_ending["v"]
    tokens[1 + np.array(of_ending["ending"], np.int64)] = of_ending["n"]
    np.add.at(types, 1 + endings, -1)
    np.add.at(tokens, 1 + endings, -c)
    types[1 + ENDINGS :] = 1
    tokens[1 + ENDINGS :] = c[order]
    n_class = np.bincount(of, weights=tokens, minlength=classes)
    v_class = np.bincount(of, weights=types, minlength=classes)
    seen, kinds = q.sum(1, keepdims=True), (q > 0).sum(1, keepdims=True)
    plain = (q.sum(0) + 1) / (q.sum() + classes)
    transition = np.where(seen > 0, (q + kinds * plain) / np.maximum(seen + kinds, 1), plain)
    words = int(sum(of_ending["n"]))
    model = Model(
        frequent, of, np.log10(transition), np.log10(n_class + ALPHA * (v_class + 1)), frequent, c[order], words + ends, int(sum(of_ending["v"])) + (ends > 0), ends
    )
    return model, counts.select("word", "c")


def _scorer(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, classes = shared.value, byte_classes("nonspace")
        for batch, column in slices(batches, "text"):
            words = find_words(column, classes)
            rows = words.rows
            cls = m.of[_units(words, m.units)]
            line = np.zeros(len(cls) + rows + 1, np.int64)
            place = np.arange(len(cls)) + words.row + 1
            line[place] = cls
            step = m.transition[line[:-1], line[1:]]
            ends = words.first[1:] + np.arange(1, rows + 1)  # place of each text's end
            total = np.concatenate([[0], np.cumsum(step)])
            moves = total[ends] - total[np.concatenate([[0], ends[:-1]])]
            spread = np.bincount(words.row, weights=m.spread[cls], minlength=rows)
            at, known = _find(m.frequent, words.hash)
            value = np.log10(np.where(known, m.counts[at] if len(m.counts) else 0, 0) + ALPHA)
            near = np.bincount(words.row[known], weights=value[known], minlength=rows)
            n_known = np.bincount(words.row[known], minlength=rows)
            far = np.flatnonzero(~known)
            order = far[np.lexsort([words.hash[far], words.row[far]])]
            h, r = words.hash[order], words.row[order]
            new = np.concatenate([[True], (h[1:] != h[:-1]) | (r[1:] != r[:-1])]) if len(h) else np.zeros(0, bool)
            start = np.flatnonzero(new)
            n = np.diff(np.concatenate([start, [len(h)]]))
            offsets = pa.array(np.searchsorted(r[start], np.arange(rows + 1)).astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    batch.column(1),
                    pa.array(words.counts() + 1),
                    pa.array(n_known),
                    pa.array(near, pa.float64()),
                    pa.array(moves - spread, pa.float64()),
                    pa.ListArray.from_arrays(offsets, pa.array(h[start].astype(np.int64))),
                    pa.ListArray.from_arrays(offsets, pa.array(n.astype(np.int32))),
                ],
                names=["doc_id", "row_id", "n_tokens", "n_known", "near", "shape", "rare", "rare_n"],
            )

    return run


def scores(docs: DataFrame, model: Model, counts: DataFrame) -> DataFrame:
    """(doc_id, n_tokens, n_known, train_tokens, base_score, score) for each row of docs (doc_id, text).

    base_score is the smoothed unigram's log10 probability of the text, score the model's. Null and empty texts are one
    end token; texts of any length are read whole. Repeated rows are scored each, alike: rows are told apart by doc_id and a
    hash of doc_id and text. Where words tie at the bound of the frequent ones, a hash decides, which changes classes but no
    count. Other columns are left out, so their names can't clash. With no training text every token has probability 1 in the
    unigram, and the model knows only how many classes there are. An empty table gives an empty one.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select("doc_id", F.xxhash64("doc_id", "text").alias("row_id"), "text")
    parts = cut(
        rows.mapInArrow(
            _scorer(shared), f"doc_id {kind}, row_id long, n_tokens long, n_known long, near double, shape double, rare array<long>, rare_n array<int>"
        ),
        "lm-parts",
    )
    rare = parts.dropDuplicates(["doc_id", "row_id"]).select("doc_id", "row_id", F.explode(F.arrays_zip("rare", "rare_n")).alias("x"))
    met = rare.select("doc_id", "row_id", F.col("x.rare").alias("word"), F.col("x.rare_n").alias("n")).join(counts, "word", "left").groupBy("doc_id", "row_id").agg(
        F.sum(F.col("n") * F.log10(F.coalesce("c", F.lit(0)) + ALPHA)).alias("far"), F.sum(F.when(F.col("c") > 0, F.col("n")).otherwise(0)).alias("far_known")
    )
    end = float(np.log10(model.ends + ALPHA))
    one = float(np.log10(model.tokens + ALPHA * (model.types + 1)))
    numerator = F.col("near") + F.coalesce("far", F.lit(0.0))
    met = met.withColumnRenamed("doc_id", "_id").withColumnRenamed("row_id", "_row")
    joined = parts.drop("rare", "rare_n").join(met, (F.col("row_id") == F.col("_row")) & F.col("doc_id").eqNullSafe(F.col("_id")), "left")
    return joined.select(
        "doc_id",
        "n_tokens",
        (F.col("n_known") + F.coalesce("far_known", F.lit(0)) + int(model.ends > 0)).cast("long").alias("n_known"),
        F.lit(model.tokens).cast("long").alias("train_tokens"),
        (numerator + F.lit(end) - F.col("n_tokens") * F.lit(one)).alias("base_score"),
        (numerator + F.col("shape")).alias("score"),
    )


def op6_brown_lm(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model, counts = train(docs)
    out = scores(docs, model, counts)
    perplexity = F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens"))
    return out.select("doc_id", held_out("doc_id", FOLDS).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", perplexity.alias("perplexity"))
