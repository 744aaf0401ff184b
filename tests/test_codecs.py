"""Demuxing, decoding and encoding of WAV audio, and of a codec that is registered."""

from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.sources import codecs, formats, media, packets

AUDIO = {"a": np.arange(10_000, dtype=np.int16).reshape(-1, 2), "b": np.zeros((3, 1), np.float32), "none": np.zeros((0, 1), np.int16)}


@pytest.fixture(scope="module")
def files(spark):
    rows = [(k, bytearray(media.encode_wav(x, 1000))) for k, x in AUDIO.items()]
    return spark.createDataFrame([*rows, ("bad", bytearray(b"RIFF")), ("null", None)], "path string, content binary")


def frames(rows):
    return {r.path: formats.from_tensor(r.tensor) for r in rows if r.error is None}


def test_demux_decode_encode(files):
    demuxed = codecs.demuxed(files, "audio")
    rows = {r.path: r for r in demuxed.collect()}
    assert rows["bad"].error and rows["null"].error and [p.pts for p in rows["a"].packets.packets] == [0, 1024, 2048, 3072, 4096]
    got = frames(codecs.decoded_packets(demuxed.where("error is null"), "audio").collect())
    assert {k: (v == AUDIO[k]).all() and v.dtype == AUDIO[k].dtype for k, v in got.items()} == dict.fromkeys(AUDIO, True)
    again = codecs.encoded(codecs.loaded(files, "audio").where("error is null"), "audio", sample_rate=1000)
    assert {r.path: bytes(r.content) for r in again.collect()} == {k: media.encode_wav(x, 1000) for k, x in AUDIO.items()}


@pytest.mark.parametrize("window", [(0, 1), ("1/3", "2.5"), (Fraction(1, 1000), 10), (4, 100), (50, 60)])
def test_windows(files, window):
    start, end = (Fraction(w) for w in window)
    got = frames(codecs.loaded(files, "audio", window).collect())
    for k, x in AUDIO.items():
        want = [i for i in range(len(x)) if start <= Fraction(i, 1000) < end]
        assert (got[k] == x[want]).all() and len(got[k]) == len(want)
    p = {r.path: r.packets for r in codecs.demuxed(files, "audio", window).where("error is null").collect()}
    assert all(x.pts < end * 1000 and x.pts + x.duration > start * 1000 for x in p["a"].packets)


@pytest.mark.parametrize("how,sizes", [({"num_packets": 2}, [2, 2, 1]), ({"duration": 1.5}, [2, 2, 1]), ({"num_packets": 99}, [5])])
def test_streaming(files, how, sizes):
    chunks = codecs.streaming_demuxed(files, "audio", **how)
    rows = sorted((r for r in chunks.collect() if r.path == "a"), key=lambda r: r.chunk)
    assert [len(r.packets.packets) for r in rows] == sizes
    whole = chunks.where("path = 'a'").select(F.concat("path", F.lit("#"), "chunk").alias("path"), "packets")
    got = frames(codecs.decoded_packets(whole, "audio").collect())
    assert (np.concatenate([got[f"a#{k}"] for k in range(len(sizes))]) == AUDIO["a"]).all()


def test_packets_pass_through_records(files):
    stored = codecs.demuxed(files, "audio").where("error is null").select("path", packets.serialised(F.col("packets")).alias("record"))
    back = stored.select("path", packets.deserialised(F.col("record"), "audio")["packets"].alias("packets"))
    assert (frames(codecs.decoded_packets(back, "audio").collect())["a"] == AUDIO["a"]).all()


class Counts(codecs.Codec):
    """A made-up kind of video: each byte of a file is a frame of one pixel, every third one a key."""

    def demux(self, data, src):
        rows = [{"pts": i, "dts": i, "duration": 1, "flags": int(i % 3 == 0), "data": data[i : i + 1]} for i in range(len(data))]
        return {"media": "video", "src": src, "stream_index": 0, "time_base": {"num": 1, "den": 2}, "window": None, "codec": None, "packets": rows}

    def decode(self, p, filter_desc):
        assert not p["packets"] or p["packets"][0]["flags"] & 1  # a decoder begins at a key
        out = np.array([[[list(x["data"])]] for x in p["packets"]], np.uint8).reshape(-1, 1, 1, 1)
        if p["window"]:
            s, e = (Fraction(p["window"][k]["num"], p["window"][k]["den"]) for k in ("start", "end"))
            out = out[[i for i, x in enumerate(p["packets"]) if s <= Fraction(x["pts"], 2) < e]]
        return 255 - out if filter_desc == "negate" else out


def test_a_codec_of_ones_own(spark):
    df = spark.createDataFrame([("v", bytearray(range(20)))], "path string, content binary")
    with pytest.raises(media.BackendNotInstalled):
        codecs.loaded(df, "video")
    codecs.register("video", Counts())
    try:
        assert frames(codecs.loaded(df, "video", ("5/2", 4)).collect())["v"].ravel().tolist() == [5, 6, 7]
        assert frames(codecs.loaded(df, "video", (0, 1), "negate").collect())["v"].ravel().tolist() == [255, 254]
        assert "doesn't encode" in codecs.encoded(codecs.loaded(df, "video"), "video").first().error
    finally:
        codecs._CODECS.pop("video")


def test_bad_options(files):
    for bad in ({}, {"num_packets": 1, "duration": 1.0}):
        with pytest.raises(ValueError):
            codecs.streaming_demuxed(files, "audio", **bad)
    with pytest.raises(ValueError):
        codecs.loaded(files, "audio", (2, 1))
    with pytest.raises(ValueError):
        codecs.register("smell", codecs.Wav())
    assert all(r.error for r in codecs.loaded(files, "audio", None, "anull").collect())
