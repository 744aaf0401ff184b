"""Demuxing, decoding and encoding as table functions, through codecs by kind of media: 'audio', 'video' or 'image'.

A codec splits a file into packets (sources.packets.PACKETS), makes frames of packets, and files of frames. WAV audio is built in; what else there is
depends on the libraries that users register codecs of. Packets are rows' values, so they can be stored as records, split at key frames, and
decoded elsewhere than they were read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from millrace.operators.pieces import pieces, sent
from millrace.sources.formats import _SAMPLES, TENSOR, _wav, from_tensor, tensor
from millrace.sources.media import BackendNotInstalled, encode_wav
from millrace.sources.packets import PACKETS, _arrow_type

Window = tuple[str | int | Fraction, str | int | Fraction] | None


class Codec:
    """What a kind of media needs; a codec leaves out what it can't do. Codecs must pickle."""

    def demux(self, data: bytes, src: str) -> dict:
        """All packets of the default stream, with its time base and codec."""
        raise BackendNotInstalled("this codec doesn't demux")

    def decode(self, packets: dict, filter_desc: str | None) -> np.ndarray:
        """The frames of the packets: [samples, channels], [N, H, W, C] or [H, W, C]. Frames outside packets["window"] are left out."""
        raise BackendNotInstalled("this codec doesn't decode")

    def encode(self, frames: np.ndarray, **options) -> bytes:
        raise BackendNotInstalled("this codec doesn't encode")


class Wav(Codec):
    """PCM audio. A packet is PACKET samples of each channel; packets are decoded alone, so all of them are keys."""

    PACKET = 1024

    def demux(self, data: bytes, src: str) -> dict:
        head, at = _wav(data)
        dtype = _SAMPLES.get((head["bits_per_sample"], head["audio_format"] == 3 or head["bits_per_sample"] == 64))
        if dtype is None:
            raise ValueError(f"{head['bits_per_sample']}-bit samples aren't supported")
        align, rate, total = head["block_align"], head["sample_rate"], head["data_size"] // head["block_align"]
        cuts = [(k, min(self.PACKET, total - k)) for k in range(0, total, self.PACKET)]
        packets = [{"pts": k, "dts": k, "duration": n, "flags": 1, "data": data[at + k * align : at + (k + n) * align]} for k, n in cuts]
        extra = f"{np.dtype(dtype).str} {head['num_channels']}".encode()
        return {
            "media": "audio", "src": src, "stream_index": 0, "time_base": {"num": 1, "den": rate}, "window": None,
            "codec": {"name": "pcm", "frame_rate": {"num": rate, "den": 1}, "extra": extra}, "packets": packets,
        }

    def decode(self, packets: dict, filter_desc: str | None) -> np.ndarray:
        if filter_desc:
            raise ValueError("PCM audio is decoded without filters")
        dtype, channels = packets["codec"]["extra"].decode().split()
        first = packets["packets"][0]["pts"] if packets["packets"] else 0
        frames = np.frombuffer(b"".join(p["data"] for p in packets["packets"]), np.dtype(dtype)).reshape(-1, int(channels))
        if packets["window"] is None:
            return frames
        base = Fraction(packets["time_base"]["num"], packets["time_base"]["den"])
        ends = [-(-Fraction(packets["window"][e]["num"], packets["window"][e]["den"]) // base) for e in ("start", "end")]  # first samples not before
        return frames[max(0, ends[0] - first) : max(0, ends[1] - first)]

    def encode(self, frames: np.ndarray, *, sample_rate: int) -> bytes:
        return encode_wav(frames, sample_rate)


_CODECS: dict[str, Codec] = {"audio": Wav()}


def register(kind: str, codec: Codec) -> None:
    """Demuxes, decodes and encodes this kind with a library of the user's from now on."""
    if kind not in ("audio", "video", "image"):
        raise ValueError(f"unknown kind of media: {kind!r}")
    _CODECS[kind] = codec


def codec(kind: str) -> Codec:
    if kind not in _CODECS:
        raise BackendNotInstalled(f"no codec for {kind}; register one")
    return _CODECS[kind]


def _rational(x: Fraction) -> dict:
    return {"num": x.numerator, "den": x.denominator}


def _ends(window: Window) -> tuple[Fraction, Fraction] | None:
    if window is None:
        return None
    start, end = Fraction(window[0]), Fraction(window[1])
    if end <= start:
        raise ValueError("a window must end after its start")
    return start, end


def _within(p: dict, window: tuple[Fraction, Fraction]) -> dict:
    """Packets that a window needs: from the last key at or before its start to the last packet shown before its end."""
    base = Fraction(p["time_base"]["num"], p["time_base"]["den"])
    start, end = window
    at = lambda x: (x["pts"] or 0) * base
    shown = [i for i, x in enumerate(p["packets"]) if at(x) < end and at(x) + (x["duration"] or 0) * base > start or start <= at(x) < end]
    if not shown:
        kept = []
    else:
        keys = [i for i, x in enumerate(p["packets"][: shown[0] + 1]) if x["flags"] & 1]
        kept = p["packets"][(keys[-1] if keys else 0) : shown[-1] + 1]
    return p | {"window": {"start": _rational(start), "end": _rational(end)}, "packets": kept}


def _mapped(df: DataFrame, columns: tuple[str, str], out: str, kind: str, work: Callable[[str, object], Iterator[dict]]) -> DataFrame:
    """(path, *out, error) for each result of work(path, value); one row with an error where it raises, after those before it."""
    fields = [pa.field("path", pa.string()), pa.field("chunk", pa.int64()), pa.field(out, _arrow_type(kind)), pa.field("error", pa.string())]
    schema = pa.schema(fields)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for some in pieces(batches):
            for path, value in ((r[columns[0]], r[columns[1]]) for r in some):
                try:
                    for k, r in enumerate(work(path, value)):
                        yield {"path": path, "chunk": k, out: r}
                except (ValueError, KeyError, BackendNotInstalled) as e:
                    yield {"path": path, "error": str(e)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return sent(rows(batches), schema)

    return df.select(*columns).mapInArrow(run, f"path string, chunk long, {out} {kind}, error string")


def demuxed(df: DataFrame, kind: str, window: Window = None) -> DataFrame:
    """(path, packets, error) of files (path, content). window: only the packets that are needed for this time, in seconds as numbers or fractions."""
    c, ends = codec(kind), _ends(window)

    def work(path, content):
        p = c.demux(content or b"", path)
        yield p if ends is None else _within(p, ends)

    return _mapped(df, ("path", "content"), "packets", PACKETS, work).drop("chunk")


def streaming_demuxed(df: DataFrame, kind: str, *, num_packets: int = -1, duration: float = -1) -> DataFrame:
    """(path, chunk, packets, error): a file's packets in chunks of so many, or of so many seconds by their times, exactly one of which must be
    given. A chunk of a duration ends with the packet by which it is reached."""
    if (num_packets <= 0) == (duration <= 0):
        raise ValueError("either num_packets or duration must be given, and not both")
    c = codec(kind)

    def work(path, content):
        p = c.demux(content or b"", path)
        base, chunk, seconds = p["time_base"]["num"] / p["time_base"]["den"], [], 0.0
        for x in p["packets"]:
            chunk.append(x)
            seconds += (x["duration"] or 0) * base
            if len(chunk) == num_packets or 0 < duration <= seconds:
                yield p | {"packets": chunk}
                chunk, seconds = [], 0.0
        if chunk:
            yield p | {"packets": chunk}

    return _mapped(df, ("path", "content"), "packets", PACKETS, work)


def decoded_packets(df: DataFrame, kind: str, filter_desc: str | None = None) -> DataFrame:
    """(path, tensor, error): the frames of packets (path, packets), whole streams or chunks of them."""
    c = codec(kind)
    return _mapped(df, ("path", "packets"), "tensor", TENSOR, lambda _, p: iter([tensor(c.decode(p, filter_desc))])).drop("chunk")


def loaded(df: DataFrame, kind: str, window: Window = None, filter_desc: str | None = None) -> DataFrame:
    """(path, tensor, error): the frames of files (path, content), of a window of time or of all of it: demuxed and decoded in one step."""
    c, ends = codec(kind), _ends(window)

    def work(path, content):
        p = c.demux(content or b"", path)
        yield tensor(c.decode(p if ends is None else _within(p, ends), filter_desc))

    return _mapped(df, ("path", "content"), "tensor", TENSOR, work).drop("chunk")


def encoded(df: DataFrame, kind: str, **options) -> DataFrame:
    """(path, content, error): files of frames (path, tensor)."""
    c = codec(kind)
    return _mapped(df, ("path", "tensor"), "content", "binary", lambda _, t: iter([c.encode(from_tensor(t), **options)])).drop("chunk")


