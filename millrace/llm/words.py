"""Words of UTF-8 text as arrays: boundaries and 64-bit hashes, computed for a whole column at once.

A column of strings is one byte buffer with offsets. A prefix sum of byte * P^position (mod 2^64) gives the
polynomial hash of every word without a Python loop over words. Memory stays in proportion to a piece of a
few MB, as long buffers are taken in pieces that end between words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

PIECE = 1 << 20  # bytes hashed at once
BATCH = 4 << 20  # bytes of text in one group of rows

_P = 0x9E3779B97F4A7C15 | 1
_INV = pow(_P, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.empty(n, np.uint64)
    out[0] = 1
    done = 1
    while done < n:
        step = np.uint64(pow(base, done, 1 << 64))
        take = min(done, n - done)
        out[done : done + take] = out[:take] * step
        done += take
    return out


_TABLES: dict[str, np.ndarray] = {}


def _table(name: str) -> np.ndarray:
    if name not in _TABLES:
        with np.errstate(over="ignore"):
            _TABLES[name] = _powers(_P if name == "pow" else _INV, PIECE + 1)
    return _TABLES[name]


def byte_classes(word: str) -> np.ndarray:
    """For each byte: is it part of a word. 'alnum': letters, digits and all beyond ASCII, after lower-casing
    A-Z; 'nonspace': all but the six white-space characters of ASCII."""
    out = np.ones(256, bool)
    if word == "nonspace":
        out[[0x20, *range(0x09, 0x0E)]] = False
    elif word == "alnum":
        out[:0x80] = False
        out[ord("0") : ord("9") + 1] = True
        out[ord("a") : ord("z") + 1] = True
        out[ord("A") : ord("Z") + 1] = True
    else:
        raise ValueError(f"unknown kind of word: {word}")
    return out


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32


def mix(h: np.ndarray) -> np.ndarray:
    """A finaliser: spreads every bit of a 64-bit value over all bits."""
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(29))


class Words:
    """The words of some texts: start and end byte in `data`, hash, and the row each belongs to."""

    __slots__ = ("data", "first", "start", "end", "hash", "row", "rows")

    def __init__(self, data, start, end, hashes, row, rows):
        self.data, self.start, self.end, self.hash, self.row, self.rows = data, start, end, hashes, row, rows
        self.first = np.searchsorted(row, np.arange(rows + 1))  # words of row r: first[r]:first[r + 1]

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def text(self, i: int) -> str:
        return self.data[self.start[i] : self.end[i]].tobytes().decode("utf-8", "replace")


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column, nulls as empty texts."""
    if column.null_count:
        column = column.fill_null("")
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def find_words(column: pa.Array, classes: np.ndarray) -> Words:
    """The words of a string column, A-Z lower-cased; a word never spans two rows."""
    data, offsets = buffers(column)
    rows, n = len(offsets) - 1, len(data)
    low = _LOWER[data]
    inside = classes[low]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:]
    edge = offsets[1:-1]
    edge = edge[(edge > 0) & (edge < n)]
    begins[edge] = inside[edge]
    ends[edge - 1] = inside[edge - 1]
    start = np.flatnonzero(begins)
    end = np.flatnonzero(ends) + 1
    hashes = np.empty(len(start), np.uint64)
    with np.errstate(over="ignore"):
        i = 0
        while i < len(start):
            base = start[i]
            j = int(np.searchsorted(end, base + PIECE, "right"))
            if j == i:  # one word longer than a piece
                hashes[i] = _long_word(low[base : end[i]])
                i += 1
                continue
            stop = end[j - 1]
            part = low[base:stop].astype(np.uint64)
            part += np.uint64(1)
            part *= _table("pow")[: len(part)]
            total = np.zeros(len(part) + 1, np.uint64)
            np.cumsum(part, out=total[1:])
            s, e = start[i:j] - base, end[i:j] - base
            hashes[i:j] = mix((total[e] - total[s]) * _table("inv")[s] + (e - s).astype(np.uint64))
            i = j
    row = np.searchsorted(offsets, start, "right") - 1
    return Words(low, start, end, hashes, row, rows)


def _long_word(low: np.ndarray) -> np.uint64:
    total, at = 0, 0
    for k in range(0, len(low), PIECE):
        part = (low[k : k + PIECE].astype(np.uint64) + np.uint64(1)) * _table("pow")[: min(PIECE, len(low) - k)]
        total = (total + int(part.sum(dtype=np.uint64)) * pow(_P, at, 1 << 64)) % (1 << 64)
        at += PIECE
    return mix(np.array([(total + len(low)) % (1 << 64)], np.uint64))[0]


def hash_word(word: str) -> int:
    """The hash that find_words gives to this word."""
    return int(find_words(pa.array([word]), np.ones(256, bool)).hash[0])


def slices(batches: Iterator[pa.RecordBatch], text: str = "text") -> Iterator[tuple[pa.RecordBatch, pa.Array]]:
    """The same rows, with their texts, in batches of about BATCH bytes of text, or of one row where a text is
    longer. The text is a column, or a field of the struct column `row` where there is one."""
    for batch in batches:
        if not batch.num_rows:
            continue
        names = batch.schema.names
        if text in names:
            column = batch.column(names.index(text))
        else:
            row = batch.column(names.index("row"))
            column = row.field(row.type.get_field_index(text))
        _, offsets = buffers(column)
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + BATCH, "right")) - 1)
            yield batch.slice(at, to - at), column.slice(at, to - at)
            at = to


def as_rows(df: DataFrame) -> DataFrame:
    """All columns of df in one struct column `row`, so that no name of theirs can clash with a new column."""
    return df.select(F.struct(*[df[f"`{c}`"] for c in df.columns]).alias("row"))


def windows(words: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of n words within a row, and their rows. A row of fewer words, but not none, is one run."""
    h, row = words.hash, words.row
    with np.errstate(over="ignore"):
        if len(h) >= n:
            m = len(h) - n + 1
            run = np.zeros(m, np.uint64)
            for k in range(n):
                run = run * np.uint64(0xC2B2AE3D27D4EB4F) + h[k : k + m]
            whole = row[:m] == row[n - 1 :]
            run, run_row = mix(run[whole]), row[:m][whole]
        else:
            run, run_row = np.empty(0, np.uint64), np.empty(0, row.dtype)
        short = np.flatnonzero((words.counts() > 0) & (words.counts() < n))
        if len(short):
            extra = np.array([int(sequence_hash(h[words.first[r] : words.first[r + 1]])) for r in short], np.uint64)
            run, run_row = np.concatenate([run, extra]), np.concatenate([run_row, short])
            order = np.argsort(run_row, kind="stable")
            run, run_row = run[order], run_row[order]
    return run, run_row


def sequence_hash(h: np.ndarray) -> np.uint64:
    out = 0x51ED270B
    for x in h.tolist():
        out = (out * 0xC2B2AE3D27D4EB4F + x) % (1 << 64)
    return mix(np.array([out ^ len(h)], np.uint64))[0]


def row_hashes(words: Words, multiplier: int) -> np.ndarray:
    """One 64-bit hash of the sequence of words of each row."""
    with np.errstate(over="ignore"):
        local = np.arange(len(words.hash)) - words.first[words.row]
        longest = int(words.counts().max(initial=0))
        weighted = mix(words.hash ^ np.uint64(multiplier)) * _powers(multiplier | 1, longest + 1)[local]
        total = np.zeros(len(weighted) + 1, np.uint64)
        np.cumsum(weighted, out=total[1:])
        return mix(total[words.first[1:]] - total[words.first[:-1]] + words.counts().astype(np.uint64))
