"""Files read by ranges on the executors: members of archives, and chunks of WAV audio, without a task that holds a file.

Each works in two steps. An index of the file (its members, or its header) is read with seeks and small reads, and is a table like any other.
Its rows are then dealt out by place, so that one large file is read by many tasks, each from front to back. Paths are URIs, or names on
a file system that all executors reach.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from millrace.operators.pieces import sent
from millrace.sources.formats import _BLOCK, _SAMPLES, _TENSOR, TENSOR, _pax_path, _tar_size, tensor

RANGE = 64 << 20  # bytes of a file that one task reads in a row
PART = 16 << 20  # bytes of a member in one row
LISTED = 4096  # members in one batch of an index


def opened(path: str):
    """A file that can be read at any place."""
    from pyarrow import fs

    uri = re.sub(r"^file:/(?!/)", "file:///", path) if "://" in path or path.startswith("file:") else f"file://{path}"
    system, name = fs.FileSystem.from_uri(uri)
    return system.open_input_file(name)


def _exactly(f, at: int, n: int) -> bytes:
    f.seek(at)
    data = f.read(n)
    if len(data) < n:
        raise ValueError("the file ends inside an entry")
    return data


# -- archives --------------------------------------------------------------------------------------------------

INDEX = "path string, member string, at long, stored long, size long, method int, crc long, error string"
_INDEX = pa.schema([("path", pa.string()), ("member", pa.string()), ("at", pa.int64()), ("stored", pa.int64()), ("size", pa.int64()), ("method", pa.int32()), ("crc", pa.int64()), ("error", pa.string())])

#: Fixed values of the ZIP format: the marks of its records, the numbers that stand for 64-bit fields, the methods that are read.
_END, _END64_AT, _END64, _CENTRAL, _LOCAL = b"PK\x05\x06", b"PK\x06\x07", b"PK\x06\x06", b"PK\x01\x02", b"PK\x03\x04"
_WIDE, _WIDE16, _STORED, _DEFLATED = 0xFFFFFFFF, 0xFFFF, 0, 8


def _directory(f, length: int) -> tuple[int, int, int]:
    """(place, bytes, entries) of the central directory."""
    tail = min(length, 22 + 0xFFFF)
    end = _exactly(f, length - tail, tail)
    k = end.rfind(_END)
    if k < 0 or k + 22 > len(end):
        raise ValueError("not a ZIP archive")
    entries, size, at = struct.unpack_from("<HII", end, k + 10)
    if entries == _WIDE16 or size == _WIDE or at == _WIDE:
        where = length - tail + k - 20
        if where < 0 or (locator := _exactly(f, where, 20))[:4] != _END64_AT:
            raise ValueError("the archive's 64-bit directory is missing")
        record = _exactly(f, struct.unpack_from("<Q", locator, 8)[0], 56)
        if record[:4] != _END64:
            raise ValueError("the archive's 64-bit directory is damaged")
        entries, size, at = struct.unpack_from("<QQQ", record, 32)
    if at + size > length:
        raise ValueError("the central directory lies outside the archive")
    return at, size, entries


def _wide(extra: bytes, values: list[int]) -> list[int]:
    """Sizes and place, those that are too large for 32 bits taken from the 64-bit field, where they stand in this order."""
    at = 0
    while at + 4 <= len(extra):
        kind, n = struct.unpack_from("<HH", extra, at)
        if kind == 1:
            numbers = iter(struct.unpack_from(f"<{n // 8}Q", extra, at + 4))
            try:
                return [next(numbers) if v == _WIDE else v for v in values]
            except StopIteration:
                break
        at += 4 + n
    if _WIDE in values:
        raise ValueError("a member's 64-bit sizes are missing")
    return values


def zip_entries(f) -> Iterator[dict]:
    """Members of a ZIP archive from its central directory, read a piece at a time; folders are left out."""
    at, size, entries = _directory(f, f.size())
    stop, buffer, begin = at + size, b"", at
    for _ in range(entries):
        def need(n: int) -> None:
            nonlocal buffer, begin
            if len(buffer) < n:
                got = _exactly(f, begin + len(buffer), min(max(1 << 20, n - len(buffer)), stop - begin - len(buffer)))
                buffer += got
            if len(buffer) < n:
                raise ValueError("the central directory is truncated")

        need(46)
        if buffer[:4] != _CENTRAL:
            raise ValueError("the central directory is damaged")
        flags, method, _, crc, stored, full, name, extra, comment = struct.unpack_from("<HHIIIIHHH", buffer, 8)
        place = struct.unpack_from("<I", buffer, 42)[0]
        need(46 + name + extra + comment)
        full, stored, place = _wide(buffer[46 + name : 46 + name + extra], [full, stored, place])
        member = buffer[46 : 46 + name].decode("utf-8" if flags & 0x800 else "cp437")
        if not member.endswith("/"):
            yield {"member": member, "at": place, "stored": stored, "size": full, "method": method, "crc": crc}
        done = 46 + name + extra + comment
        buffer, begin = buffer[done:], begin + done


def tar_entries(f) -> Iterator[dict]:
    """Regular files of a tar archive by its headers; what lies between them is passed over, not read."""
    at, length, longer = 0, f.size(), None
    while at < length:
        head = _exactly(f, at, _BLOCK)
        if not head.strip(b"\0"):
            return
        size, kind = _tar_size(head[124:136]), head[156:157]
        at += _BLOCK
        if at + size > length:
            raise ValueError("the archive ends inside an entry")
        if kind == b"L":
            longer = _exactly(f, at, size).split(b"\0")[0].decode("utf-8", "replace")
        elif kind == b"x":
            longer = _pax_path(_exactly(f, at, size)) or longer
        else:
            if kind in (b"0", b"\0"):
                prefix = head[345:500].split(b"\0")[0] if head[257:263] == b"ustar\0" else b""
                name = head[:100].split(b"\0")[0]
                yield {"member": longer or (prefix + b"/" + name if prefix else name).decode("utf-8", "replace"), "at": at, "stored": size, "size": size}
            longer = None
        at += -(-size // _BLOCK) * _BLOCK


def archive_index(paths: DataFrame, kind: str) -> DataFrame:
    """(path, member, at, stored, size, method, crc, error): the members of archives (path) of a kind, 'zip' or 'tar'. An archive that can't be read,
    or not to its end, gives a row with an error after the members before it."""
    if kind not in ("zip", "tar"):
        raise ValueError(f"kind must be 'zip' or 'tar': {kind!r}")
    entries = zip_entries if kind == "zip" else tar_entries

    def run(batches):
        for batch in batches:
            for path in batch.column(0).to_pylist():
                rows = []
                try:
                    with opened(path) as f:
                        for e in entries(f):
                            rows.append({"path": path, **e})
                            if len(rows) == LISTED:
                                yield pa.RecordBatch.from_pylist(rows, schema=_INDEX)
                                rows = []
                except (ValueError, OSError, struct.error) as e:
                    rows.append({"path": path, "error": str(e)})
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=_INDEX)

    return paths.select("path").mapInArrow(run, INDEX)


def _member(f, row: dict, part: int) -> Iterator[bytes]:
    """A member's content in parts of at most `part` bytes, at least one."""
    at, left, method = row["at"], row["stored"], row["method"]
    if method is None:  # tar
        for k in range(0, max(left, 1), part):
            yield _exactly(f, at + k, min(part, left - k))
        return
    if method not in (_STORED, _DEFLATED):
        raise ValueError(f"a member is compressed by method {method}")
    head = _exactly(f, at, 30)
    if head[:4] != _LOCAL:
        raise ValueError("a member's header is damaged")
    at += 30 + sum(struct.unpack_from("<HH", head, 26))
    held, crc, total, sent = bytearray(), 0, 0, False
    for piece in _inflated(f, at, left) if method == _DEFLATED else (_exactly(f, at + k, min(1 << 20, left - k)) for k in range(0, left, 1 << 20)):
        crc, total = zlib.crc32(piece, crc), total + len(piece)
        held += piece
        while len(held) >= part:
            yield bytes(held[:part])
            sent = True
            del held[:part]
    if held or not sent:
        yield bytes(held)
    if total != row["size"] or crc != row["crc"]:
        raise ValueError("a member's content differs from its checksum")


def _inflated(f, at: int, left: int, most: int = 1 << 20) -> Iterator[bytes]:
    """Deflated data, read and inflated at most so many bytes at a time."""
    inflate, tail = zlib.decompressobj(-15), b""
    while left or tail:
        if not tail:
            tail = _exactly(f, at, min(left, most))
            at, left = at + len(tail), left - len(tail)
        yield inflate.decompress(tail, most)
        tail = inflate.unconsumed_tail
    while piece := inflate.decompress(b"", most):
        yield piece
    if not inflate.eof:
        raise ValueError("a member's data end too early")


_CONTENT = pa.schema([("path", pa.string()), ("member", pa.string()), ("part", pa.int64()), ("content", pa.binary()), ("error", pa.string())])


def archive_members(index: DataFrame, *, range_bytes: int = RANGE, part_bytes: int = PART) -> DataFrame:
    """(path, member, part, content, error) of the members of an index. A member of more than part_bytes is several rows, part being their number from 0 on.

    Members are dealt out by ranges of their archive, so an archive of any size is read by many tasks. What can't be read gives a row with
    an error, after the parts before it; rows of the index that are errors stay.
    """
    tasks = int(index.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = index.withColumn("_range", F.floor(F.coalesce("at", F.lit(0)) / range_bytes))
    dealt = dealt.repartition(tasks, "path", "_range").sortWithinPartitions("path", "at").drop("_range")

    def run(batches):
        path, f = None, None
        for batch in batches:
            for row in batch.to_pylist():
                if row["error"] is not None:
                    yield pa.RecordBatch.from_pylist([{"path": row["path"], "error": row["error"]}], schema=_CONTENT)
                    continue
                named = {"path": row["path"], "member": row["member"]}
                try:
                    if row["path"] != path:
                        if f is not None:
                            f.close()
                        path, f = None, None
                        f = opened(row["path"])
                        path = row["path"]
                    for k, content in enumerate(_member(f, row, part_bytes)):
                        yield pa.RecordBatch.from_pylist([named | {"part": k, "content": content}], schema=_CONTENT)
                except (ValueError, OSError, struct.error, zlib.error) as e:
                    yield pa.RecordBatch.from_pylist([named | {"error": str(e)}], schema=_CONTENT)
        if f is not None:
            f.close()

    return dealt.mapInArrow(run, "path string, member string, part long, content binary, error string")


# -- WAV -------------------------------------------------------------------------------------------------------

PACKET = 1024  # samples of each channel in a packet of WAV audio
_HEAD = pa.schema([("path", pa.string()), ("at", pa.int64()), ("total", pa.int64()), ("rate", pa.int64()), ("channels", pa.int64()), ("align", pa.int64()), ("dtype", pa.string()), ("error", pa.string())])


def _wav_head(f) -> dict:
    """Place, number and type of a WAV file's samples; its chunks are passed over, not read."""
    length = f.size()
    if length < 12 or (riff := _exactly(f, 0, 12))[:4] != b"RIFF" or riff[8:] != b"WAVE":
        raise ValueError("not a WAV file")
    at, form = 12, None
    while at + 8 <= length:
        name, size = struct.unpack("<4sI", _exactly(f, at, 8))
        at += 8
        if name == b"fmt ":
            if size < 16:
                raise ValueError("the format chunk is too short")
            form = struct.unpack("<HHIIHH", _exactly(f, at, 16))
        elif name == b"data":
            if form is None:
                raise ValueError("samples before their format")
            kind, channels, rate, _, align, bits = form
            dtype = _SAMPLES.get((bits, kind == 3 or bits == 64))
            if dtype is None or not align or not channels:
                raise ValueError(f"{bits}-bit samples aren't supported")
            return {"at": at, "total": min(size, length - at) // align, "rate": rate, "channels": channels, "align": align, "dtype": dtype}
        at += size + size % 2
    raise ValueError("no samples")


def wav_chunks(paths: DataFrame, *, num_packets: int | None = None, duration: float | None = None) -> DataFrame:
    """(path, chunk, start, tensor, error): the audio of WAV files (path) in chunks, of so many packets of PACKET samples, or of so many seconds,
    exactly one of which must be given. start is the chunk's first sample; tensors are [samples, channels]; the last chunk may be shorter.

    No file is held whole, and its chunks are read by as many tasks as there are. A file that isn't readable gives one row with an error.
    """
    if (num_packets is None) == (duration is None):
        raise ValueError("either num_packets or duration must be given, and not both")
    if (num_packets if duration is None else duration) <= 0:
        raise ValueError("a chunk must not be empty")

    def heads(batches):
        for batch in batches:
            rows = []
            for path in batch.column(0).to_pylist():
                try:
                    with opened(path) as f:
                        rows.append({"path": path, **_wav_head(f)})
                except (ValueError, OSError, struct.error) as e:
                    rows.append({"path": path, "error": str(e)})
            yield pa.RecordBatch.from_pylist(rows, schema=_HEAD)

    head = paths.select("path").mapInArrow(heads, "path string, at long, total long, rate long, channels long, align long, dtype string, error string")
    step = F.lit(num_packets * PACKET).cast("long") if duration is None else F.greatest(F.lit(1), F.floor(F.col("rate") * duration)).cast("long")
    sized = head.withColumn("step", step)
    chunks = F.when(F.col("error").isNull() & (F.col("total") > 0), F.sequence(F.lit(0).cast("long"), F.floor((F.col("total") - 1) / F.col("step"))))
    tasks = int(paths.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # An empty file has no chunk; an unreadable one has a row without.
    dealt = sized.where("error is not null or total > 0").select("*", F.explode_outer(chunks).alias("chunk"))
    dealt = dealt.repartition(tasks, "path", "chunk").sortWithinPartitions("path", "chunk")
    schema = pa.schema([("path", pa.string()), ("chunk", pa.int64()), ("start", pa.int64()), ("tensor", _TENSOR), ("error", pa.string())])

    def rows(batches):
        path, f = None, None
        for batch in batches:
            for r in batch.to_pylist():
                row = {"path": r["path"], "chunk": r["chunk"], "error": r["error"]}
                if r["error"] is None:
                    try:
                        if r["path"] != path:
                            path, f = None, opened(r["path"])
                            path = r["path"]
                        start = r["chunk"] * r["step"]
                        n = min(r["step"], r["total"] - start)
                        data = _exactly(f, r["at"] + start * r["align"], n * r["align"])
                        row |= {"start": start, "tensor": tensor(np.frombuffer(data, r["dtype"]).reshape(n, r["channels"]))}
                    except (ValueError, OSError) as e:
                        row["error"] = str(e)
                yield row

    def run(batches):
        return sent(rows(batches), schema)

    return dealt.mapInArrow(run, f"path string, chunk long, start long, tensor {TENSOR}, error string")
