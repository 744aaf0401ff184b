"""Media behind an interface of backends. Built in: PPM/PGM images and WAV audio, in NumPy; others are registered by their users.

Decoding runs inside Arrow functions over (path, content). Frames are tensors (millrace.sources.formats): images [H, W, C],
batches [N, H, W, C], audio [samples, channels].
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from millrace.operators.batch import batch_ids
from millrace.sources.formats import TENSOR, _TENSOR, load_wav, tensor


class BackendNotInstalled(RuntimeError):
    """No backend decodes this kind of media."""


def decode_pnm(data: bytes) -> np.ndarray:
    """A binary PGM or PPM image as [H, W, C] of 8 bits."""
    fields, at = [], 0
    while len(fields) < 4:
        while at < len(data) and (data[at : at + 1].isspace() or data[at : at + 1] == b"#"):
            at = data.find(b"\n", at) + 1 if data[at : at + 1] == b"#" else at + 1
            if at == 0:
                raise ValueError("a comment without an end")
        end = at
        while end < len(data) and not data[end : end + 1].isspace():
            end += 1
        if end == at:
            raise ValueError("the header is too short")
        fields.append(data[at:end])
        at = end
    if fields[0] not in (b"P5", b"P6"):
        raise ValueError("neither PGM nor PPM")
    width, height, top = (int(x) for x in fields[1:])
    channels = 3 if fields[0] == b"P6" else 1
    if top != 255 or width < 1 or height < 1:
        raise ValueError("only 8-bit images are supported")
    body = data[at + 1 : at + 1 + width * height * channels]
    if len(body) != width * height * channels:
        raise ValueError("the image is truncated")
    return np.frombuffer(body, np.uint8).reshape(height, width, channels)


def encode_pnm(image: np.ndarray) -> bytes:
    if image.ndim == 2:
        image = image[..., None]
    if image.dtype != np.uint8 or image.shape[2] not in (1, 3):
        raise ValueError("an image is [H, W, 1 or 3] of 8 bits")
    kind = "P6" if image.shape[2] == 3 else "P5"
    return f"{kind}\n{image.shape[1]} {image.shape[0]}\n255\n".encode() + np.ascontiguousarray(image).tobytes()


def encode_wav(samples: np.ndarray, sample_rate: int) -> bytes:
    """Samples [n, channels] of u1, i2, i4, f4 or f8."""
    kinds = {"u1": 1, "i2": 1, "i4": 1, "f4": 3, "f8": 3}
    code = samples.dtype.str[1:]
    if samples.ndim != 2 or code not in kinds:
        raise ValueError("samples are [n, channels] of u1, i2, i4, f4 or f8")
    body = np.ascontiguousarray(samples).tobytes()
    channels, width = samples.shape[1], samples.dtype.itemsize
    head = b"WAVEfmt " + (16).to_bytes(4, "little") + kinds[code].to_bytes(2, "little") + channels.to_bytes(2, "little") + sample_rate.to_bytes(4, "little")
    head += (sample_rate * channels * width).to_bytes(4, "little") + (channels * width).to_bytes(2, "little") + (8 * width).to_bytes(2, "little") + b"data" + len(body).to_bytes(4, "little")
    return b"RIFF" + (len(head) + len(body)).to_bytes(4, "little") + head + body


_BACKENDS: dict[str, Callable[[bytes], np.ndarray]] = {"image": decode_pnm, "audio": load_wav}


def register(kind: str, decode: Callable[[bytes], np.ndarray]) -> None:
    """Decodes this kind ('image', 'audio', 'video') with a library of the user's from now on."""
    _BACKENDS[kind] = decode


def backend(kind: str) -> Callable[[bytes], np.ndarray]:
    if kind not in _BACKENDS:
        raise BackendNotInstalled(f"no backend decodes {kind}; register one")
    return _BACKENDS[kind]


def resize(image: np.ndarray, width: int, height: int) -> np.ndarray:
    """Nearest pixels."""
    h, w = image.shape[:2]
    return image[(np.arange(height) * h // height)[:, None], np.arange(width) * w // width]


def decoded(df: DataFrame, kind: str, after: Callable[[np.ndarray], np.ndarray] | None = None) -> DataFrame:
    """(path, tensor, error) of files (path, content): exactly one of tensor and error is null."""
    decode = backend(kind)
    schema = pa.schema([("path", pa.string()), ("tensor", _TENSOR), ("error", pa.string())])

    def run(batches):
        for b in batches:
            rows = []
            for path, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                try:
                    a = decode(content or b"")
                    rows.append({"path": path, "tensor": tensor(after(a) if after else a)})
                except ValueError as e:
                    rows.append({"path": path, "error": str(e)})
            yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return df.select("path", "content").mapInArrow(run, f"path string, tensor {TENSOR}, error string")


def image_batch(df: DataFrame, width: int, height: int, *, strict: bool = True) -> np.ndarray:
    """All images of a (small) table as [N, H, W, C], in order of path. strict: any image that fails raises; else those are left out.
    An empty table, and one of which nothing decodes, always raise."""
    rows = decoded(df, "image", lambda a: resize(np.repeat(a, 3, 2) if a.shape[2] == 1 else a, width, height)).orderBy("path").collect()
    if not rows:
        raise ValueError("there are no images")
    bad = [r.path for r in rows if r.error is not None]
    if len(bad) == len(rows) or (strict and bad):
        raise RuntimeError(f"{len(bad)} of {len(rows)} images failed")
    return np.stack([np.frombuffer(r.tensor.data, np.uint8).reshape(r.tensor.shape) for r in rows if r.error is None])


def image_batches(df: DataFrame, n: int, width: int, height: int) -> DataFrame:
    """(batch_id, paths, tensor, failed): images of files (path, content) in order of path, n to a batch, as tensors [m, H, W, 3]. Images
    that fail are left out and named in failed. Batches are made, and stay, on the executors."""
    images = decoded(df, "image", lambda a: resize(np.repeat(a, 3, 2) if a.shape[2] == 1 else a, width, height))
    rows = batch_ids(images, n, ["path"]).groupBy("batch_id").agg(F.array_sort(F.collect_list(F.struct("pos", "path", "tensor", "error"))).alias("rows"))
    good, bad = F.filter("rows", lambda r: r["error"].isNull()), F.filter("rows", lambda r: r["error"].isNotNull())
    rows = rows.select("batch_id", F.transform(good, lambda r: r["path"]).alias("paths"), F.transform(good, lambda r: r["tensor"]["data"]).alias("planes"), F.transform(bad, lambda r: r["path"]).alias("failed"))
    schema = pa.schema([("batch_id", pa.int64()), ("paths", pa.list_(pa.string())), ("tensor", _TENSOR), ("failed", pa.list_(pa.string()))])

    def run(batches):
        for b in batches:
            out = []
            for r in b.to_pylist():
                planes = r.pop("planes")
                shape = [len(planes), height, width, 3]
                out.append(r | {"tensor": {"dtype": "uint8", "shape": shape, "data": b"".join(planes)}})
            yield pa.RecordBatch.from_pylist(out, schema=schema)

    return rows.mapInArrow(run, f"batch_id long, paths array<string>, tensor {TENSOR}, failed array<string>")


def pick_frames(frames: Column, indices: Sequence[int], count: Column) -> Column:
    """The frames (an array) at these indices; they must be in order, distinct and in range."""
    indices = list(indices)
    if not indices or indices != sorted(set(indices)) or indices[0] < 0:
        raise ValueError("indices must be given, in order, distinct, and not negative")
    picked = F.transform(F.array(*[F.lit(i) for i in indices]), lambda i: F.get(frames, i))
    return F.when(count <= indices[-1], F.raise_error(F.lit("an index is out of range"))).otherwise(picked)


def decode_groups(packets: DataFrame, stream: str, order: str, pts: str, is_key: str) -> DataFrame:
    """packets with group (the number of key packets so far) and key_pts, the time of the key packet a decoder starts from.

    A packet that comes after a key packet but is shown before it belongs to the group before.
    """
    w = Window.partitionBy(stream).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    key_pts = F.max(F.when(F.col(is_key), F.col(pts))).over(w)
    before = F.max("_key").over(Window.partitionBy(stream).orderBy(order).rangeBetween(Window.unboundedPreceding, Window.currentRow))
    keyed = packets.withColumn("_key", key_pts).withColumn("_key", before)
    earlier = packets.where(F.col(is_key)).select(F.col(stream).alias("_s"), F.col(pts).alias("_k"))
    shown = keyed.join(earlier, (F.col(stream) == F.col("_s")) & (F.col("_k") <= F.col(pts)) & (F.col("_k") <= F.col("_key")), "left")
    columns = [F.col(c) for c in packets.columns]
    return shown.groupBy(*columns).agg(F.max("_k").alias("key_pts"), F.count("_k").alias("group"))


def write_files(df: DataFrame, folder: str, encode: Callable[[np.ndarray], bytes], suffix: str) -> DataFrame:
    """Writes each (name, tensor) to folder/name+suffix on a file system that all executors reach; (path, bytes) of what was written.

    A file is written under a name of its own and then moved, so a task that is run again replaces what it wrote.
    """
    schema = pa.schema([("path", pa.string()), ("bytes", pa.int64())])

    def run(batches):
        import uuid

        from pyarrow import fs

        system, root = fs.FileSystem.from_uri(folder if "://" in folder else f"file://{folder}")
        system.create_dir(root, recursive=True)
        for b in batches:
            rows = []
            for name, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                data = encode(np.frombuffer(t["data"], np.dtype(t["dtype"])).reshape(t["shape"]))
                part = f"{root}/.{uuid.uuid4().hex}"
                with system.open_output_stream(part, compression=None) as out:
                    out.write(data)
                system.move(part, f"{root}/{name}{suffix}")
                rows.append({"path": f"{folder}/{name}{suffix}", "bytes": len(data)})
            yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return df.select("name", "tensor").mapInArrow(run, "path string, bytes long")
