"""Benchmark decontamination by suffix arrays over the training text.

Every slice of documents (a few MB) is a shard. Its suffix array orders the word positions from which a match
of a whole window can start: positions whose next words all occur somewhere in the benchmark. Every suffix of
every benchmark item is looked up in each shard by binary search; the neighbours of the place found give its
longest verbatim match, and the range of suffixes that begin with a window gives all locations of that window.

Nothing is shuffled: a document lies in one shard, and the benchmark goes to the shards in blocks of at most
BLOCK_CHARS characters, each a broadcast of bounded size; a larger benchmark takes more blocks, in one job.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from millrace.llm.store import cut
from millrace.llm.words import as_rows, byte_classes, find_words, slices

WINDOW = 10
BLOCK_CHARS = 8_000_000
WAVE = 8  # blocks in memory at a time


class Block:
    """Benchmark items as word numbers: 1 and up by hash, 0 for what isn't a word of the block."""

    def __init__(self, ids: list[str], texts: list[str], window: int):
        w = find_words(pa.array(texts, pa.large_string()), byte_classes("alnum"))
        self.vocabulary = np.unique(w.hash)
        self.ids = ids
        numbers = np.searchsorted(self.vocabulary, w.hash) + 1
        n = w.counts()
        # Items one after the other, each ended by a 0; self.left: words from a place to its item's end.
        self.tokens = np.zeros(len(numbers) + len(n) + 1, np.int64)
        places = np.arange(len(numbers)) + w.row
        self.tokens[places] = numbers
        left = w.first[w.row + 1] - np.arange(len(numbers))
        lengths = np.minimum(n[w.row], window)
        ok = left >= lengths
        self.groups = []  # (window length, places of the test suffixes, items of each suffix)
        for length in np.unique(lengths):
            at = places[ok & (lengths == length)]
            item = w.row[ok & (lengths == length)]
            rows = self.tokens[at[:, None] + np.arange(length)]
            _, first, same = np.unique(rows, axis=0, return_index=True, return_inverse=True)
            pairs = np.unique(np.stack([same.ravel(), item], 1), axis=0)
            starts = np.searchsorted(pairs[:, 0], np.arange(len(first) + 1))
            self.groups.append((int(length), at[first], at, same.ravel(), starts, pairs[:, 1]))
        self.left = np.zeros(len(self.tokens), np.int64)
        self.left[places] = left


class Shard:
    """Word numbers of some texts, a 0 after each, and binary search in their suffixes."""

    def __init__(self, words, vocabulary: np.ndarray):
        if len(vocabulary):
            k = np.minimum(np.searchsorted(vocabulary, words.hash), len(vocabulary) - 1)
            number = np.where(vocabulary[k] == words.hash, k + 1, 0)
        else:
            number = np.zeros(len(words.hash), np.int64)
        self.tokens = np.zeros(len(number) + words.rows + 1, np.int64)
        self.place = np.arange(len(number)) + words.row
        self.tokens[self.place] = number
        zeros = np.flatnonzero(self.tokens == 0)
        self.run = zeros[np.searchsorted(zeros, np.arange(len(self.tokens)))] - np.arange(len(self.tokens))
        bits = max(1, int(len(vocabulary)).bit_length())
        self.bits, self.per = bits, 62 // bits

    def keys(self, tokens: np.ndarray, left: np.ndarray, at: np.ndarray, depth: int, most: int | None = None) -> np.ndarray:
        """Tokens depth .. depth + per of the suffixes at these places, packed; past a suffix's end come zeros."""
        out = np.zeros(len(at), np.int64)
        end = left[at] if most is None else np.minimum(left[at], most)
        for k in range(depth, depth + self.per):
            have = k < end
            out <<= self.bits
            out[have] |= tokens[at[have] + k]
        return out

    def suffix_array(self, least: int, deepest: int) -> np.ndarray:
        """Places that `least` known words follow, in order of their first `deepest` words."""
        at = np.flatnonzero(self.run >= least)
        key = self.keys(self.tokens, self.run, at, 0)
        order = np.argsort(key, kind="stable")
        at, key = at[order], key[order]
        group = np.cumsum(np.concatenate([[0], key[1:] != key[:-1]])) if len(at) else key
        depth = self.per
        while depth < deepest and len(at):
            alone = np.bincount(group) == 1
            tied = np.flatnonzero(~alone[group] & (self.run[at] > depth))
            if not len(tied):
                break
            tied = np.flatnonzero(~alone[group])
            key = self.keys(self.tokens, self.run, at[tied], depth)
            order = np.lexsort([key, group[tied]])
            at[tied] = at[tied][order]
            full = np.zeros(len(at), np.int64)
            full[tied] = key[order]
            group = np.cumsum(np.concatenate([[0], (group[1:] != group[:-1]) | (full[1:] != full[:-1])]))
            depth += self.per
        return at

    def search(self, sa: np.ndarray, block: Block, at: np.ndarray, after: bool, most: int | None) -> np.ndarray:
        """For each test suffix, the first place in the suffix array that is not before it (after: that is behind
        it), comparing `most` words at most."""
        low, high = np.zeros(len(at), np.int64), np.full(len(at), len(sa), np.int64)
        deepest = most or int(block.left[at].max(initial=0))
        while (open_ := np.flatnonzero(low < high)).size:
            middle = (low[open_] + high[open_]) // 2
            sign = np.zeros(len(open_), np.int64)
            tied, depth = np.arange(len(open_)), 0
            while tied.size and depth < deepest:
                mine = self.keys(block.tokens, block.left, at[open_[tied]], depth, most)
                there = self.keys(self.tokens, self.run, sa[middle[tied]], depth, most)
                sign[tied] = np.sign(there - mine)
                tied, depth = tied[there == mine], depth + self.per
            below = (sign < 0) | ((sign == 0) & after)
            low[open_[below]] = middle[below] + 1
            high[open_[~below]] = middle[~below]
        return low

    def common(self, block: Block, at: np.ndarray, sa: np.ndarray, near: np.ndarray) -> np.ndarray:
        """Words that the test suffixes and their neighbours in the suffix array begin with alike."""
        out = np.zeros(len(at), np.int64)
        tied = np.flatnonzero((near >= 0) & (near < len(sa)))
        while tied.size:
            there = sa[near[tied]]
            same = (out[tied] < block.left[at[tied]]) & (out[tied] < self.run[there])
            tied, there = tied[same], there[same]
            tied = tied[block.tokens[at[tied] + out[tied]] == self.tokens[there + out[tied]]]
            out[tied] += 1
        return out


def scan_words(words, block: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hit words (mask), (row, item) pairs with occurring windows, and each row's longest verbatim match."""
    shard = Shard(words, block.vocabulary)
    marks = np.zeros(len(shard.tokens) + 1, np.int64)
    row_of = np.zeros(len(shard.tokens), np.int64)
    row_of[shard.place] = words.row
    longest = np.zeros(words.rows, np.int64)
    pairs = [np.empty((0, 2), np.int64)]
    for length, windows, suffixes, window_of, starts, items in block.groups:
        sa = shard.suffix_array(length, int(block.left[suffixes].max(initial=0)))
        if not len(sa):
            continue
        near = shard.search(sa, block, suffixes, after=False, most=None)
        match = np.maximum(
            shard.common(block, suffixes, sa, near), shard.common(block, suffixes, sa, near - 1)
        )
        best = np.zeros(len(windows), np.int64)
        np.maximum.at(best, window_of, match)
        found = np.flatnonzero(best >= length)
        if not len(found):
            continue
        low = shard.search(sa, block, windows[found], after=False, most=length)
        high = shard.search(sa, block, windows[found], after=True, most=length)
        n = high - low
        which = np.repeat(found, n)
        at = sa[np.repeat(low, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]
        np.add.at(marks, at, 1)
        np.add.at(marks, at + length, -1)
        np.maximum.at(longest, row_of[at], best[which])
        seen = np.unique(np.stack([row_of[at], which], 1), axis=0)
        k = starts[seen[:, 1] + 1] - starts[seen[:, 1]]
        item = items[np.repeat(starts[seen[:, 1]], k) + np.arange(k.sum()) - np.repeat(np.cumsum(k) - k, k)]
        pairs.append(np.stack([np.repeat(seen[:, 0], k), item], 1))
    hit = np.cumsum(marks)[shard.place] > 0
    return hit, np.unique(np.concatenate(pairs), axis=0), longest, shard.place


def _scanner(shared, text: str, state: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, classes = shared.value, byte_classes("alnum")
        for batch, column in slices(batches, text):
            words = find_words(column, classes)
            hit, pairs, longest, _ = scan_words(words, block)
            items = [set() for _ in range(words.rows)]
            for row, item in pairs.tolist():
                items[row].add(block.ids[item])
            rows = np.flatnonzero(np.bincount(words.row, weights=hit, minlength=words.rows))
            masks: list[bytes | None] = [None] * words.rows
            n_hit = np.zeros(words.rows, np.int64)
            for row in rows:
                mask = hit[words.first[row] : words.first[row + 1]]
                n_hit[row] = mask.sum()
                masks[row] = np.packbits(mask).tobytes() if mask.any() else None
            if state:
                old = {name: batch.column(batch.schema.get_field_index(name)).to_pylist() for name in ("hits", "items", "longest")}
                for row in range(words.rows):
                    items[row].update(old["items"][row])
                    longest[row] = max(longest[row], old["longest"][row])
                    if before := old["hits"][row]:
                        both = np.frombuffer(before, np.uint8)
                        if masks[row]:
                            both = both | np.frombuffer(masks[row], np.uint8)
                        masks[row] = both.tobytes()
                        n_hit[row] = np.bitwise_count(both).sum()
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(batch.schema.get_field_index("row")),
                    pa.array(words.counts(), pa.int64()),
                    pa.array(n_hit, pa.int64()),
                    pa.array(masks, pa.binary()),
                    pa.array([sorted(x) for x in items], pa.list_(pa.string())),
                    pa.array(longest, pa.int64()),
                ],
                names=["row", "n_words", "n_hit", "hits", "items", "longest"],
            )

    return run


def benchmark_blocks(benchmark: DataFrame, window: int, chars: int) -> Iterator[Block]:
    rows = benchmark.select(
        F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("i"), F.coalesce("text", F.lit("")).alias("t")
    ).toLocalIterator()
    ids, texts, size = [], [], 0
    for i, t in rows:
        if texts and size + len(t) > chars:
            yield Block(ids, texts, window)
            ids, texts, size = [], [], 0
        ids.append(i)
        texts.append(t)
        size += len(t)
    yield Block(ids, texts, window)


def contamination(
    docs: DataFrame, benchmark: DataFrame, *, text: str = "text", window: int = WINDOW, block_chars: int = BLOCK_CHARS
) -> DataFrame:
    """Every row of docs as `row`, with n_words, n_hit, hits (packed bits of the words hit), items (ids of the
    benchmark items with an occurring window, sorted as strings) and longest (longest verbatim match in words of
    an item from a window that occurs; 0 without one).

    Words are `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` after lower-casing A-Z. A window is `window` consecutive
    words of an item; an item of fewer words, but not none, is one window. Null and empty texts have no words
    and are clean; an empty benchmark, or one without words, leaves everything clean; repeated items count once
    by id; repeated documents are each scanned; texts of any length are read whole, in pieces. Words are compared by 64-bit
    hashes. Blocks of the benchmark (of about block_chars characters) are broadcast WAVE at a time at most.
    """
    out, state = as_rows(docs), False
    schema = T.StructType(
        [out.schema["row"]]
        + [T.StructField(n, T.LongType()) for n in ("n_words", "n_hit")]
        + [T.StructField("hits", T.BinaryType()), T.StructField("items", T.ArrayType(T.StringType()))]
        + [T.StructField("longest", T.LongType())]
    )
    waiting = []
    for block in benchmark_blocks(benchmark, window, block_chars):
        if len(waiting) == WAVE:  # the state so far becomes a table, and the blocks it came from go
            out = cut(out, "decontaminate-wave")
            for shared in waiting:
                shared.unpersist()
            waiting = []
        waiting.append(docs.sparkSession.sparkContext.broadcast(block))
        out = out.mapInArrow(_scanner(waiting[-1], text, state), schema)
        state = True
    return out


def decontaminate(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The rows of docs without any word inside an occurrence of a benchmark window, unchanged."""
    return contamination(docs, benchmark, **options).where("n_hit = 0").select("row.*")


def op5_decontamination(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select(
        F.col("row.doc_id").alias("doc_id"),
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


WORDS_SQL = (
    r"regexp_extract_all(translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
    r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
)

ORACLE = f"""
WITH d AS (SELECT doc_id, {WORDS_SQL.format("coalesce(text, '')")} AS w FROM documents),
b AS (SELECT item_id::VARCHAR AS item, {WORDS_SQL.format("coalesce(text, '')")} AS w FROM benchmark),
bw AS (
  SELECT item, least(len(w), 10) AS n, array_to_string(list_slice(w, p, p + least(len(w), 10) - 1), ' ') AS win
  FROM (SELECT item, w, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS p FROM b WHERE len(w) > 0)
),
lens AS (SELECT DISTINCT n FROM bw),
dw AS (
  SELECT doc_id, n, p, array_to_string(list_slice(w, p, p + n - 1), ' ') AS win
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM d, lens WHERE len(w) >= n)
),
hit AS (SELECT DISTINCT doc_id, item, p, dw.n FROM dw JOIN bw ON dw.win = bw.win AND dw.n = bw.n),
words_hit AS (SELECT doc_id, count(DISTINCT q)::BIGINT AS n_hit FROM (SELECT doc_id, unnest(range(p, p + n)) AS q FROM hit) GROUP BY doc_id),
items AS (SELECT doc_id, count(*)::BIGINT AS n_items, sha256(string_agg(item, ',' ORDER BY item)) AS h FROM (SELECT DISTINCT doc_id, item FROM hit) GROUP BY doc_id)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  coalesce(h, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words_hit USING (doc_id) LEFT JOIN items USING (doc_id)
"""
