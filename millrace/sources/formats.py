"""Parsers of NPY, NPZ, TAR and WAV bytes, and their Arrow functions over tables of files (path, content).

A tensor is struct<dtype, shape, data>: NumPy's name of the type without byte order, the shape, and the bytes in C order,
little-endian. Malformed input raises in the parser; the table functions return it as a row's error instead, as a
failing item is dropped and counted (millrace.operators.failure).
"""

from __future__ import annotations

import io
import struct
import zipfile
from collections.abc import Callable, Iterator
from typing import BinaryIO

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from millrace.operators.pieces import pieces, sent

TENSOR = "struct<dtype:string,shape:array<int>,data:binary>"


def load_npy(data: bytes) -> np.ndarray:
    """The array of an NPY file; object arrays are refused."""
    f = io.BytesIO(data)
    try:
        out = np.lib.format.read_array(f, allow_pickle=False)
    except (ValueError, EOFError, SyntaxError) as e:
        raise ValueError(f"not a readable NPY file: {e}") from e
    return out


class Npz:
    """The arrays of an NPZ file by name, with or without .npy; stored and deflated members only."""

    def __init__(self, data: bytes):
        try:
            self._zip = zipfile.ZipFile(io.BytesIO(data))
        except zipfile.BadZipFile as e:
            raise ValueError(f"not a readable NPZ file: {e}") from e
        self._members = {i.filename: i for i in self._zip.infolist()}

    def keys(self) -> list[str]:
        return [n.removesuffix(".npy") for n in self._members]

    def __getitem__(self, name: str) -> np.ndarray:
        member = self._members.get(name) or self._members.get(f"{name}.npy")
        if member is None:
            raise KeyError(name)
        if member.compress_type not in (zipfile.ZIP_STORED, zipfile.ZIP_DEFLATED):
            raise ValueError(f"{name} is compressed by method {member.compress_type}")
        return load_npy(self._zip.read(member))


_BLOCK = 512


def _tar_checksum(head: bytes) -> bool:
    try:
        want = int(head[148:156].split(b"\0")[0].strip() or b"-1", 8)
    except ValueError:
        return False
    return sum(head) - sum(head[148:156]) + 8 * 32 == want


def _tar_size(field: bytes) -> int:
    if field[0] & 0x80:  # base 256
        return int.from_bytes(bytes([field[0] & 0x7F]) + field[1:], "big")
    return int(field.split(b"\0")[0].strip() or b"0", 8)


def _pax_path(body: bytes) -> str | None:
    """The path record of an extended header: '<length> path=<value>\\n'."""
    at, out = 0, None
    while at < len(body):
        space = body.find(b" ", at)
        if space < 0 or not body[at:space].isdigit():
            return out
        record = body[space + 1 : at + int(body[at:space]) - 1]
        key, _, value = record.partition(b"=")
        if key == b"path":
            out = value.decode("utf-8", "replace")
        at += int(body[at:space])
    return out


def iter_tar(data: bytes) -> Iterator[tuple[str, bytes]]:
    """(path, content) of the regular files of a tar archive. Long names of GNU and PAX archives are understood, other
    kinds of entries skipped. A block that is no header is passed over; a truncated entry ends the archive."""
    at, longer = 0, None
    view = memoryview(data)
    while at + _BLOCK <= len(data):
        head = bytes(view[at : at + _BLOCK])
        at += _BLOCK
        if head[257:262] != b"ustar" or not _tar_checksum(head):
            continue
        size = _tar_size(head[124:136])
        if at + size > len(data):
            return
        kind, body = head[156:157], view[at : at + size]
        at += -(-size // _BLOCK) * _BLOCK
        if kind == b"L":
            longer = bytes(body).split(b"\0")[0].decode("utf-8", "replace")
            continue
        if kind == b"x":
            longer = _pax_path(bytes(body)) or longer
            continue
        if kind in (b"0", b"\0"):
            name = head[:100].split(b"\0")[0].decode("utf-8", "replace")
            prefix = head[345:500].split(b"\0")[0].decode("utf-8", "replace") if head[257:263] == b"ustar\0" else ""
            yield longer or (f"{prefix}/{name}" if prefix else name), bytes(body)
        longer = None


def walk_tar(source: BinaryIO) -> Iterator[tuple[str, bytes]]:
    """(path, content) of the regular files of a tar archive that is read from front to back, an entry at a time, so that an archive may
    be larger than memory. Headers are taken as they are, without their checksum; an archive that ends inside an entry raises."""
    longer = None

    def exactly(n: int) -> bytes:
        data = source.read(n)
        if len(data) < n:
            raise ValueError("the archive ends inside an entry")
        return data

    while head := source.read(_BLOCK):
        if len(head) < _BLOCK:
            raise ValueError("the archive ends inside a header")
        if not head.strip(b"\0"):
            return
        size, kind = _tar_size(head[124:136]), head[156:157]
        body = exactly(size)
        exactly(-size % _BLOCK)
        if kind == b"L":
            longer = body.split(b"\0")[0].decode("utf-8", "replace")
        elif kind == b"x":
            longer = _pax_path(body) or longer
        else:
            if kind in (b"0", b"\0"):
                prefix = head[345:500].split(b"\0")[0] if head[257:263] == b"ustar\0" else b""
                name = head[:100].split(b"\0")[0]
                yield longer or (prefix + b"/" + name if prefix else name).decode("utf-8", "replace"), body
            longer = None


#: Sample types by (bits, is float); fixed by the format.
_SAMPLES = {(8, False): "u1", (16, False): "<i2", (32, False): "<i4", (32, True): "<f4", (64, True): "<f8"}
WAV_FIELDS = ("audio_format", "num_channels", "sample_rate", "byte_rate", "block_align", "bits_per_sample", "data_size")


def _wav(data: bytes) -> tuple[dict[str, int], int]:
    """The header and the place of the samples."""
    if len(data) < 12 or data[:4] != b"RIFF" or data[8:12] != b"WAVE":
        raise ValueError("not a WAV file")
    at, head = 12, None
    while at + 8 <= len(data):
        name, size = data[at : at + 4], int.from_bytes(data[at + 4 : at + 8], "little")
        at += 8
        if name == b"fmt ":
            if size < 16 or at + 16 > len(data):
                raise ValueError("the format chunk is too short")
            head = dict(zip(WAV_FIELDS, struct.unpack_from("<HHIIHH", data, at), strict=False))
        elif name == b"data":
            if head is None:
                raise ValueError("samples before their format")
            return head | {"data_size": min(size, len(data) - at)}, at
        at += size + size % 2
    raise ValueError("no samples")


def parse_wav(data: bytes) -> dict[str, int]:
    return _wav(data)[0]


def load_wav(data: bytes, offset: float | None = None, duration: float | None = None) -> np.ndarray:
    """Samples [num_samples, num_channels] of a time window in seconds; its end is cut at the end of the data."""
    head, at = _wav(data)
    if (offset or 0) < 0 or (duration or 0) < 0:
        raise ValueError("the window's start and length must not be negative")
    bits, kind = head["bits_per_sample"], head["audio_format"]
    dtype = _SAMPLES.get((bits, kind == 3 or bits == 64))
    if dtype is None:
        raise ValueError(f"{bits}-bit samples aren't supported")
    total = head["data_size"] // head["block_align"]
    start = int((offset or 0) * head["sample_rate"])
    if start and start >= total:
        raise ValueError("the window starts behind the data")
    stop = total if duration is None else min(total, start + int(duration * head["sample_rate"]))
    a, b = at + start * head["block_align"], at + stop * head["block_align"]
    return np.frombuffer(data[a:b], dtype).reshape(-1, head["num_channels"])


# -- tables ------------------------------------------------------------------------------------------------


def tensor(a: np.ndarray) -> dict:
    a = np.ascontiguousarray(a)
    if a.dtype.byteorder == ">" or (a.dtype.byteorder == "=" and np.little_endian is False):
        a = a.astype(a.dtype.newbyteorder("<"))
    return {"dtype": a.dtype.name, "shape": list(a.shape), "data": a.tobytes()}


def from_tensor(t) -> np.ndarray:
    return np.frombuffer(t["data"], np.dtype(t["dtype"])).reshape(t["shape"])


_TENSOR = pa.struct([("dtype", pa.string()), ("shape", pa.list_(pa.int32())), ("data", pa.binary())])


def _table(df: DataFrame, parse: Callable[[bytes], Iterator[dict]], fields: dict[str, tuple[str, pa.DataType]]) -> DataFrame:
    """(path, *fields, error) for each result of parse; one row with an error where it raises."""
    schema = pa.schema([("path", pa.string()), *((k, t[1]) for k, t in fields.items()), ("error", pa.string())])

    def rows(batches):
        for some in pieces(batches):
            for file in some:
                try:
                    found = [{"path": file["path"], **r} for r in parse(file["content"] or b"")]
                except (ValueError, KeyError, struct.error) as e:
                    found = [{"path": file["path"], "error": str(e)}]
                yield from found

    def run(batches):
        return sent(rows(batches), schema)

    ddl = ", ".join(["path string", *(f"{k} {t[0]}" for k, t in fields.items()), "error string"])
    return df.select("path", "content").mapInArrow(run, ddl)


def npy_table(df: DataFrame) -> DataFrame:
    return _table(df, lambda c: iter([{"tensor": tensor(load_npy(c))}]), {"tensor": (TENSOR, _TENSOR)})


def npz_table(df: DataFrame) -> DataFrame:
    def parse(content):
        z = Npz(content)
        return ({"key": k, "tensor": tensor(z[k])} for k in z.keys())

    return _table(df, parse, {"key": ("string", pa.string()), "tensor": (TENSOR, _TENSOR)})


def tar_table(df: DataFrame) -> DataFrame:
    return _table(df, lambda c: ({"member": p, "content": b} for p, b in iter_tar(c)), {"member": ("string", pa.string()), "content": ("binary", pa.binary())})


def tar_files(paths: DataFrame) -> DataFrame:
    """(path, member, content, error) of archives named by paths (path), which executors read from front to back: for archives that are
    too large for a cell. Paths are URIs or names on a file system that all executors reach. What comes before an error stays."""
    schema = pa.schema([("path", pa.string()), ("member", pa.string()), ("content", pa.binary()), ("error", pa.string())])

    def run(batches):
        from pyarrow import fs

        for batch in batches:
            for path in batch.column(0).to_pylist():
                system, name = fs.FileSystem.from_uri(path if "://" in path else f"file://{path}" if path.startswith("/") else path)
                row = {"path": path}
                try:
                    with system.open_input_stream(name, compression=None) as f:
                        for member, content in walk_tar(f):
                            yield pa.RecordBatch.from_pylist([row | {"member": member, "content": content}], schema=schema)
                except (ValueError, OSError) as e:
                    yield pa.RecordBatch.from_pylist([row | {"error": str(e)}], schema=schema)

    return paths.select("path").mapInArrow(run, "path string, member string, content binary, error string")


def wav_header_table(df: DataFrame) -> DataFrame:
    return _table(df, lambda c: iter([parse_wav(c)]), {k: ("long", pa.int64()) for k in WAV_FIELDS})


def wav_table(df: DataFrame, offset: float | None = None, duration: float | None = None) -> DataFrame:
    return _table(df, lambda c: iter([{"tensor": tensor(load_wav(c, offset, duration))}]), {"tensor": (TENSOR, _TENSOR)})
