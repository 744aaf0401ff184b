"""Packet splits against a plain walk, and packets as records."""

import random

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from millrace.sources import packets as P


def plain_splits(pts, keys):
    """(start, end, invalid) for each key, by looking at every packet behind it."""
    starts = [i for i in range(len(pts)) if keys[i] or i == 0]
    out = []
    for k, start in enumerate(starts):
        if k + 1 < len(starts):
            nxt = starts[k + 1]
            late = [i for i in range(nxt + 1, len(pts)) if pts[i] < pts[nxt]]
            end = late[-1] + 1 if late else nxt
        else:
            end = len(pts)
        out.append((start, end, sum(pts[i] < pts[start] for i in range(start, end))))
    return out


def plain_frames(pts, keys, wanted):
    left, out = sorted(wanted), []
    for k, (start, end, invalid) in enumerate(plain_splits(pts, keys)):
        mine = [i for i in left if start <= i < end]
        left = [i for i in left if i not in mine]
        if mine:
            out.append((k, start, end, [i - start - invalid for i in mine]))
    return out


def table(spark, streams):
    rows = [(s, i, p, k) for s, (pts, keys) in streams.items() for i, (p, k) in enumerate(zip(pts, keys, strict=True))]
    return spark.createDataFrame(rows, "stream string, index long, pts long, is_key boolean").repartition(3)


def some_streams(n=30):
    rng, out = random.Random(3), {"documented": ([1, 3, 4, 5, 2, 6, 8, 7], [True, False, False, True] + [False] * 4)}
    for s in range(n):
        size = rng.randrange(1, 60)
        keys = [rng.random() < 0.2 for _ in range(size)]
        if s % 3 == 0:  # in order but for neighbours, as in real files
            pts = [10 * i + rng.choice([0, 0, 0, -15, 25]) for i in range(size)]
        elif s % 3 == 1:
            pts = [rng.randrange(40) for _ in range(size)]
        else:  # time begins again in the middle
            pts = [i % 17 for i in range(size)]
        out[f"s{s}"] = (pts, keys)
    return out


@pytest.mark.parametrize("block", [P.BLOCK, 5])
def test_splits(spark, block):
    streams = some_streams()
    got = {}
    for r in P.keyframe_splits(table(spark, streams), block=block).orderBy("stream", "split").collect():
        got.setdefault(r.stream, []).append((r.start, r.end, r.num_invalid))
    assert got == {s: plain_splits(*x) for s, x in streams.items()}
    assert got["documented"] == [(0, 5, 0), (3, 8, 1)]


def test_frames(spark):
    streams = some_streams()
    rng = random.Random(4)
    wanted = {s: sorted(rng.sample(range(len(x[0])), min(len(x[0]), 4))) for s, x in streams.items()}
    rows = spark.createDataFrame([(s, i) for s, w in wanted.items() for i in w], "stream string, index long")
    packets = table(spark, streams)
    found = P.frames_wanted(packets, rows, block=7)
    got = {}
    for r in found.orderBy("stream", "split").collect():
        got.setdefault(r.stream, []).append((r.split, r.start, r.end, r.frames))
    assert got == {s: plain_frames(*streams[s], w) for s, w in wanted.items()}
    # A decoder that shows the split's packets in time, without those before its key, has the frame at the place given.
    given_ = {}
    for r in P.packets_of(packets, found, block=7).collect():
        given_.setdefault((r.stream, r.split), []).append(r["index"])
    for s, splits in got.items():
        for k, start, end, _ in splits:
            assert sorted(given_[s, k]) == list(range(start, end))


@pytest.mark.parametrize("wanted", [[99], [-1], [1, 1], [None]])
def test_bad_frames(spark, wanted):
    packets = table(spark, {"a": ([1, 2, 3], [True, False, False])})
    with pytest.raises(Exception, match="out of range|given twice"):
        P.frames_wanted(packets, spark.createDataFrame([("a", i) for i in wanted], "stream string, index long")).collect()


def test_no_range_join(spark):
    packets = table(spark, {"a": ([1, 2, 3], [True, False, True])})
    plan = P.keyframe_splits(packets)._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


RECORD = {
    "media": "video", "src": "ä.mp4", "stream_index": 1, "time_base": {"num": 1, "den": 90000}, "window": {"start": {"num": 1, "den": 2}, "end": {"num": 3, "den": 1}},
    "codec": {"name": "h264", "frame_rate": {"num": 25, "den": 1}, "extra": b"\x00\x01"},
    "packets": [{"pts": 1, "dts": None, "duration": 3, "flags": 1, "data": b"abc"}, {"pts": -5, "dts": 2, "duration": 0, "flags": 0, "data": b""}],
}
BARE = RECORD | {"media": "audio", "window": None, "codec": None, "packets": []}


def test_records():
    for r in (RECORD, BARE):
        assert P.decode_record(P.encode_record(r)) == r
    with pytest.raises(P.RecordError, match="media"):
        P.encode_record(RECORD | {"media": "smell"})


@given(st.data())
@settings(max_examples=200, deadline=None)
def test_damaged_records(data):
    good = P.encode_record(RECORD)
    at = data.draw(st.integers(0, len(good) - 1))
    bad = data.draw(st.sampled_from([good[:at], good[:at] + bytes([good[at] ^ (1 << data.draw(st.integers(0, 7)))]) + good[at + 1 :], good + b"x", b""]))
    with pytest.raises(P.RecordError):
        P.decode_record(bad)


def test_another_version():
    import struct
    import zlib

    body = bytearray(P.encode_record(BARE)[:-4])
    body[4] = P.VERSION + 1
    with pytest.raises(P.RecordError, match="version 2"):
        P.decode_record(bytes(body) + struct.pack("<I", zlib.crc32(body)))


def test_record_columns(spark):
    df = spark.createDataFrame([(1, RECORD), (2, BARE), (3, None)], f"id int, p {P.PACKETS}")
    back = df.select("id", "p", P.serialised(F.col("p")).alias("bytes")).withColumn("back", P.deserialised(F.col("bytes")))
    rows = back.orderBy("id").collect()
    assert [r.back.packets for r in rows] == [r.p for r in rows] and all(r.back.error is None for r in rows) and rows[2].bytes is None
    bad = back.select("id", P.deserialised(F.concat(F.col("bytes"), F.lit(b"?"))).alias("b"), P.deserialised(F.col("bytes"), "video").alias("v")).orderBy("id").collect()
    assert bad[0].b.error and bad[0].b.packets is None and bad[0].v.error is None and "expected video" in bad[1].v.error and bad[2].b.error is None
