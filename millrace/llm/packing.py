"""Best-two-fit packing of tokenised documents into sequences of a fixed number of tokens.

1. Texts are tokenised on the executors; longer documents are cut into pieces of a full sequence.
2. Pieces are counted by length: that table has as many rows as a sequence has tokens at most, whatever the input.
3. The plan is made of these counts. A sequence is filled greedily, each time with the longest piece that fits. Is there a gap left, its smallest
   piece gives way to two unpacked pieces that fit the widened gap more tightly. As long as pieces of all lengths that it takes are left,
   the next sequence comes out the same, so it is taken at once as often as they last. After each round less of some length is left than a
   sequence took, so there are at most size // length rounds for each length, whatever the input: 16,000 in all for 2,048 tokens, some 1,600 in
   use. The plan is that of a run over all pieces, one after the other.
4. Pieces are numbered within their length (millrace.llm.ranks), and their number is looked up in the plan: no pieces but their
   counts meet in one place.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from millrace.llm.ranks import numbered
from millrace.llm.store import cut
from millrace.llm.words import slices

SIZE = 2048
END = 0
CACHED = 1 << 20  # words whose ids a worker remembers, in all its tasks
LONGEST = 64  # characters of such a word
MARKS = ".,;:!?"
LATIN = "\u0130"  # the first letter whose lower case is not one letter


class _Ids(dict):
    """Ids of words, four bytes each. Neither normalisation nor any token of the tokenizer reaches beyond a blank, so the ids of a text are
    those of its words, one after the other, and a frequent word is tokenised once. What it remembers is bounded.

    A mark behind a letter or digit is a token of its own. Words without the tokenizer's special strings go through its normaliser, its splitter and
    its model one by one, which gives the same ids as the whole of it for a fraction of the time. Latin letters below LATIN, lower-cased,
    are their own normal form, and are never split: they go to the model as the splitter writes them.
    """

    def __init__(self, tokenizer):
        super().__init__({"": b""})
        self.encode, self.model = tokenizer.encode, tokenizer.model.tokenize
        self.normal, self.split = tokenizer.normalizer.normalize_str, tokenizer.pre_tokenizer.pre_tokenize_str
        self.special = [t.content for t in tokenizer.get_added_tokens_decoder().values()]
        self.written = {k: self.split(chr(k))[0][0] for k in range(0x80, ord(LATIN)) if chr(k).isalpha()}

    def __missing__(self, word: str) -> bytes:
        if word.isalpha() and (word.isascii() or max(word) < LATIN):
            low = word.lower()
            ids = self[low] if low != word else _packed([t.id for t in self.model(low if low.isascii() else low.translate(self.written))])
        elif (head := word.rstrip(MARKS)) and head != word and head[-1].isalnum():
            known = head in self
            ids = self[head] + self[word[len(head) :]]
            if not known:  # the first time, the word alone is remembered
                return ids
        elif any(s in word for s in self.special):
            ids = _packed(self.encode(word, add_special_tokens=False).ids)
        else:
            ids = _packed([t.id for part, _ in self.split(self.normal(word)) for t in self.model(part)])
        if len(word) <= LONGEST:
            if len(self) > CACHED:
                self.clear()
                self[""] = b""
            self[word] = ids
        return ids


#: By tokenizer's file; a worker process runs many tasks.
_KNOWN: dict[str, _Ids] = {}


def _packed(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


def text_ids(text: str, ids: _Ids) -> bytes:
    # The blanks of ASCII; others stay inside words, and are the tokenizer's to find.
    return b"".join(map(ids.__getitem__, text.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ")))


def _tokenise(path: str, size: int, end: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        from millrace.llm import packing

        if path not in packing._KNOWN:
            packing._KNOWN[path] = _Ids(Tokenizer.from_file(path))
        known, last, width = packing._KNOWN[path], _packed([end]), 4 * size
        for batch, column in slices(batches, "text"):
            rows, start, pieces = [], [], []
            for i, text in enumerate(column.to_pylist()):
                whole = text_ids(text or "", known) + last
                at = range(0, len(whole), width)
                rows += [i] * len(at)
                start += at
                pieces += [whole[k : k + width] for k in at]
            places = np.array(start, np.int64) // 4
            ids = batch.column(batch.schema.get_field_index("doc_id")).take(pa.array(rows, pa.int64()))
            lengths = pa.array(np.array([len(p) // 4 for p in pieces], np.int64))
            columns = [ids, pa.array((places // size).astype(np.int32)), pa.array(places), lengths, pa.array(pieces, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "piece", "start", "length", "ids"])

    return run


def pieces(docs: DataFrame, tokenizer: str, size: int = SIZE, end: int = END) -> DataFrame:
    """(piece_id, doc_id, piece, start, length, ids, ids_crc32) of the pieces of docs (doc_id, text): ids are unsigned 32-bit, little-endian. A table
    that is written once; piece_id is unique in it. tokenizer: a file of the tokenizers library that all executors have."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    found = docs.select("doc_id", "text").mapInArrow(_tokenise(tokenizer, size, end), f"doc_id {kind}, piece int, start long, length long, ids binary")
    return cut(found.select(F.monotonically_increasing_id().alias("piece_id"), "*", F.crc32("ids").alias("ids_crc32")), "packing-pieces")


@dataclass(frozen=True)
class Round:
    """Sequences that are alike: `times` of them from number `first` on, each with `lengths` (longest first), `taken` of each being used before."""

    first: int
    times: int
    lengths: tuple[int, ...]


def _fit(counts: np.ndarray, size: int) -> list[int]:
    """The lengths of the next sequence, by counts (index: length) of unpacked pieces."""
    left, filled, out = counts.copy(), 0, []
    while True:
        fitting = np.flatnonzero(left[: size - filled + 1])
        if not len(fitting):
            break
        longest = int(fitting[-1])
        take = min(int(left[longest]), (size - filled) // longest)
        out += [longest] * take
        left[longest] -= take
        filled += take * longest
    if filled == size or len(out) == 0:
        return out
    # The smallest piece against the two unpacked ones whose sum is largest within the widened gap.
    smallest = out[-1]
    room = size - filled + smallest
    there = np.flatnonzero(left[: room + 1])
    if not len(there):
        return out
    # For each of them the longest partner, itself only where there is a second one.
    last = np.maximum.accumulate(np.where(left[: room + 1] > 0, np.arange(room + 1), 0))
    partner = last[np.minimum(room - there, there)]
    same = (partner == there) & (left[there] < 2)
    partner[same] = last[there[same] - 1]
    total = np.where(partner > 0, there + partner, 0)
    best = int(np.argmax(total))
    if total[best] > smallest:
        out[-1:] = [int(there[best]), int(partner[best])]
    return out


def plan(counts: dict[int, int], size: int) -> list[Round]:
    """Rounds that pack `counts[length]` pieces of each length. Rounds of one kind follow from the counts alone."""
    left = np.zeros(size + 1, np.int64)
    for length, n in counts.items():
        left[length] = n
    out, first = [], 0
    while left.any():
        lengths = _fit(left, size)
        kinds, each = np.unique(lengths, return_counts=True)
        times = int((left[kinds] // each).min())
        out.append(Round(first, times, tuple(lengths)))
        left[kinds] -= times * each
        first += times
    return out


def _table(rounds: list[Round]) -> list[tuple[int, int, int, int, int, int]]:
    """(length, from, each, times, first, offset): pieces of a length, from the from-th on, go `each` to a sequence into `times` sequences from
    number `first` on, beginning at `offset`. A row for each length in a round."""
    used, rows = {}, []
    for r in rounds:
        at = 0
        for length in sorted(set(r.lengths), reverse=True):
            each = r.lengths.count(length)
            rows.append((length, used.get(length, 0), each, r.times, r.first, at))
            used[length] = used.get(length, 0) + each * r.times
            at += each * length
    return rows


def packed(pieces: DataFrame, size: int = SIZE) -> DataFrame:
    """pieces without ids, with sequence_id and offset: each piece's sequence and its place there. Sequences are gapless from 0 on.

    What the driver sees is the number of pieces of each length, `size` rows at most; the plan, which all tasks get, is bounded by it: size // length
    rounds for each length at most, each with distinct lengths whose sum is within a sequence (63 of them for 2,048 tokens).
    """
    spark = pieces.sparkSession
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    rows = _table(plan(counts, size))
    schema = "length long, from long, each long, times long, first long, at long"
    by_length = spark.createDataFrame(rows, schema).groupBy("length").agg(F.array_sort(F.collect_list(F.struct("from", "each", "times", "first", "at"))).alias("entries"))
    narrow = pieces.select("piece_id", "doc_id", "piece", "start", "length", "ids_crc32")
    ranked = numbered(narrow, ["length"], ["doc_id", "piece", "piece_id"], "packing-ranked", name="_k", size="_n")
    entry = F.element_at(F.filter("entries", lambda e: e["from"] <= F.col("_k")), -1)
    joined = ranked.join(F.broadcast(by_length), "length").withColumn("_e", entry)
    k = F.col("_k") - F.col("_e.from")
    sequence = F.col("_e.first") + F.floor(k / F.col("_e.each"))
    offset = F.col("_e.at") + (k % F.col("_e.each")) * F.col("length")
    return joined.select(*narrow.columns, sequence.alias("sequence_id"), offset.alias("offset"))


def sequences(pieces: DataFrame, packing: DataFrame) -> DataFrame:
    """(sequence_id, length, ids, pieces): the token ids of each sequence, and struct<doc_id, piece, offset, length> of what is in it, in order."""
    rows = packing.select("piece_id", "sequence_id", "offset", "doc_id", "piece", "length").join(pieces.select("piece_id", "ids"), "piece_id")
    parts = rows.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "doc_id", "piece", "length", "ids"))).alias("parts"))
    joined = F.aggregate("parts", F.lit(b""), lambda a, p: F.concat(a, p["ids"]))
    length = F.aggregate("parts", F.lit(0).cast("long"), lambda a, p: a + p["length"])
    listed = F.transform("parts", lambda p: F.struct(p["doc_id"], p["piece"], p["offset"], p["length"]))
    return parts.select("sequence_id", length.alias("length"), joined.alias("ids"), listed.alias("pieces"))


def pack(docs: DataFrame, tokenizer: str, size: int = SIZE, end: int = END) -> tuple[DataFrame, DataFrame]:
    """(pieces, packing) of docs (doc_id, text), see pieces() and packed(); sequences() makes the packed sequences of the two.

    Null and empty texts are an end token alone. A document of more than `size` tokens, its end counted, is cut into full pieces and
    a rest; others are never cut. Repeated rows, and rows that share an id or have none, are packed each. Pieces of equal length are
    interchangeable, and take their places in order of doc_id, piece and row. An empty table gives empty results. Texts of any length
    are tokenised whole. Other columns are left out, so their names can't clash.
    """
    found = pieces(docs, tokenizer, size, end)
    return found, packed(found, size)


def op13_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    _, packing = pack(docs, public_tokenizers.path("word_bpe_49k.json"))
    return packing.drop("piece_id")
