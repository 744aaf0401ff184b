"""Fill-in-the-middle transformation by rank and select over code points.

A batch of texts is one buffer of UTF-8 bytes. The bytes that begin a code point are set in a bit vector of 64-bit words, with a directory
of the number of bits before each block of words. The number of code points of a text is the popcount between its ends (rank), and
a cut after k code points is the byte of the k-th bit from its begin on (select). No text is decoded, and no list of its code points is made.

Output of a document: plain, the text; psm, <P>prefix<S>suffix<M>middle; spm, <S>suffix<P>prefix<M>middle.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from millrace.llm.words import buffers, slices

RATE = 90  # of 100 documents that may be cut
SUFFIX_FIRST = 20  # of 100 documents that are cut
MARKS = (b"<P>", b"<S>", b"<M>")
WORDS_A_BLOCK = 8


class BitVector:
    """A packed bit vector with a directory of popcounts by block, for rank and select of arrays of places."""

    def __init__(self, bits: np.ndarray):
        block = 64 * WORDS_A_BLOCK
        packed = np.packbits(bits, bitorder="little")
        self.words = np.zeros((len(bits) // block + 1) * WORDS_A_BLOCK, "<u8")
        self.words.view(np.uint8)[: len(packed)] = packed
        self.counts = np.bitwise_count(self.words).astype(np.int64).reshape(-1, WORDS_A_BLOCK)
        self.before = np.concatenate([[0], np.cumsum(self.counts.sum(1))])  # set bits before each block, and in all

    def rank(self, at: np.ndarray) -> np.ndarray:
        """How many bits are set before each of these places."""
        word, bit = at >> 6, (at & 63).astype(np.uint64)
        block, k = word // WORDS_A_BLOCK, word % WORDS_A_BLOCK
        inside = np.where(np.arange(WORDS_A_BLOCK) < k[:, None], self.counts[block], 0).sum(1)
        low = self.words[word] & ((np.uint64(1) << bit) - np.uint64(1))
        return self.before[block] + inside + np.bitwise_count(low)

    def select(self, k: np.ndarray) -> np.ndarray:
        """The places of the k-th set bits, from 0 on; each k is below the number of set bits."""
        block = np.searchsorted(self.before, k, "right") - 1
        left = k - self.before[block]
        total = np.cumsum(self.counts[block], 1)
        word = (total <= left[:, None]).sum(1)
        left = left - np.where(word > 0, np.take_along_axis(total, np.maximum(word - 1, 0)[:, None], 1)[:, 0], 0)
        at = block * WORDS_A_BLOCK + word
        bits = np.unpackbits(self.words[at].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        return (at << 6) + np.argmax(np.cumsum(bits, 1) > left[:, None], 1)


def boundaries(data: np.ndarray) -> BitVector:
    """The bytes of UTF-8 text that begin a code point."""
    return BitVector((data & 0xC0) != 0x80)


def draws(doc_id, seed: int) -> tuple[int, int, int, int]:
    """Four numbers below 2^32 for a document; a null id counts as an empty text."""
    h = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).digest()
    return tuple(int.from_bytes(h[k : k + 4], "big") for k in range(0, 16, 4))


def joined(form: str, prefix: bytes, middle: bytes, suffix: bytes) -> bytes:
    p, s, m = MARKS
    return p + prefix + s + suffix + m + middle if form == "psm" else s + suffix + p + prefix + m + middle


_FIELDS = {"n": pa.int64(), "form": pa.string(), "prefix_chars": pa.int64(), "middle_chars": pa.int64(), "output": pa.large_string()}


def _transform(seed: int, rate: int, suffix_first: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, column in slices(batches, "text"):
            data, offsets = buffers(column)
            vector = boundaries(data)
            first = vector.rank(offsets)
            n = np.diff(first)
            ids = batch.column(batch.schema.get_field_index("doc_id"))
            h = np.array([draws(i, seed) for i in ids.to_pylist()], np.int64).reshape(-1, 4)
            cuts = np.sort(h[:, :2] % (n + 1)[:, None], 1)
            # A cut behind the last code point is the text's end; the others are found by select.
            at = np.repeat(offsets[1:, None], 2, 1)
            inner = cuts < n[:, None]
            at[inner] = vector.select((first[:-1, None] + cuts)[inner])
            whole, begin, end = data.tobytes(), offsets[:-1].tolist(), offsets[1:].tolist()
            forms, outputs = [], []
            for i, (a, b) in enumerate(at.tolist()):
                text = whole[begin[i] : end[i]]
                if not text or h[i, 2] % 100 >= rate or any(m in text for m in MARKS):
                    forms.append("plain")
                    outputs.append(text)
                else:
                    forms.append("spm" if h[i, 3] % 100 < suffix_first else "psm")
                    a, b = a - begin[i], b - begin[i]
                    outputs.append(joined(forms[-1], text[:a], text[a:b], text[b:]))
            plain = np.array([f == "plain" for f in forms], bool)
            lengths = np.cumsum([0, *map(len, outputs)])
            output = pa.LargeStringArray.from_buffers(len(outputs), pa.py_buffer(lengths.astype(np.int64).tobytes()), pa.py_buffer(b"".join(outputs)))
            columns = [ids, pa.array(n), pa.array(forms), pa.array(cuts[:, 0], mask=plain), pa.array(cuts[:, 1] - cuts[:, 0], mask=plain), output]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", *_FIELDS])

    return run


def fill_in_middle(docs: DataFrame, seed: int = 1, rate: int = RATE, suffix_first: int = SUFFIX_FIRST) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output) for each row of docs (doc_id, text).

    n is the number of code points; the two lengths, in code points, are null where the form is plain: where the text is empty, holds one
    of the marks, or is drawn to stay (rate). Draws come from the seed and doc_id alone, so reruns, repeated rows and rows with equal ids
    are cut alike (as far as their lengths are equal); a null doc_id draws as an empty one. A null text counts as empty. Whole texts are
    read, of any length: a long one is a batch of its own. An empty table gives an empty one. Other columns are left out, so their
    names can't clash.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n long, form string, prefix_chars long, middle_chars long, output string"
    return docs.select("doc_id", "text").mapInArrow(_transform(seed, rate, suffix_first), schema)


def restored(output: Column, form: Column) -> Column:
    """The text that an output was made of. A cut text has no mark of its own, and no mark can begin inside another, so the first ones found
    are those that were put there."""
    body = F.substring(output, 4, 2**31 - 1)
    two = lambda text, mark: F.split(text, mark, 2)
    at = lambda parts, k: F.get(parts, F.lit(k))
    psm, spm = two(body, "<S>"), two(body, "<P>")
    after_psm, after_spm = two(at(psm, 1), "<M>"), two(at(spm, 1), "<M>")
    return (
        F.when(form == "psm", F.concat(at(psm, 0), at(after_psm, 1), at(after_psm, 0)))
        .when(form == "spm", F.concat(at(after_spm, 0), at(after_spm, 1), at(spm, 0)))
        .otherwise(output)
    )


def op11_fill_in_middle(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = fill_in_middle(docs)
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    return out.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", digest(F.col("output")).alias("output_sha256"), digest(restored(F.col("output"), F.col("form"))).alias("restored_sha256")
    )


ORACLE = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
e AS (SELECT *, length(t)::BIGINT AS n, ('0x' || h[1:8])::BIGINT AS h1, ('0x' || h[9:16])::BIGINT AS h2, ('0x' || h[17:24])::BIGINT AS h3, ('0x' || h[25:32])::BIGINT AS h4 FROM d),
f AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
  CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM e),
g AS (SELECT *, substring(t, 1, a) AS p, substring(t, a + 1, b - a) AS m, substring(t, b + 1) AS s FROM f)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
  sha256(t) AS restored_sha256
FROM g
"""
