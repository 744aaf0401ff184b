"""Tables of packets: splits that a decoder can start from, the frames asked for in them, and packets as versioned records.

A packet is (stream, index, pts, is_key): its stream, its place in it from 0 on, the time at which it is shown, and whether a decoder can
start from it. The first packet of a stream counts as such a key. A packet that comes behind a key but is shown before it is a stray one: a
decoder that starts from that key would discard it, so the split before reaches up to it.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

BLOCK = 1 << 16  # packets of a stream that are numbered by one task


def _keyed(packets: DataFrame, block: int) -> DataFrame:
    """(stream, index, pts, key, split): split is the number of keys up to the packet, less one.

    Keys are counted in blocks of a stream and the blocks shifted by the counts before them, so a stream of any length is many tasks' work.
    """
    rows = packets.withColumn("key", F.col("is_key") | (F.col("index") == 0)).withColumn("_block", F.floor(F.col("index") / block))
    sums = rows.groupBy("stream", "_block").agg(F.count_if("key").alias("_keys"))
    before = Window.partitionBy("stream").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("stream", "_block", F.coalesce(F.sum("_keys").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("stream", "_block").orderBy("index").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    counted = rows.withColumn("_k", F.count_if("key").over(inside)).join(sums, ["stream", "_block"])
    return counted.withColumn("split", F.col("_k") + F.col("_before") - 1).drop("_block", "_k", "_before")


def keyframe_splits(packets: DataFrame, *, block: int = BLOCK) -> DataFrame:
    """(stream, split, start, end, num_invalid, reach) for each key of packets (stream, index, pts, is_key).

    A split holds the packets [start, end): from its key up to the next one, and on to the last packet that is shown before that next key. Its first
    num_invalid frames in time are shown before its own key: they belong to the split before, and a decoder drops them. reach is the split
    that packet end - 1 begins or follows in.

    A stray packet makes a row for each key it is shown before, one in common streams; no key is compared with packets that are in
    order. Keys and stray packets of a stream, a small share of it, are sorted by time in one task.
    """
    rows = _keyed(packets.select("stream", "index", "pts", "is_key"), block)
    keys = rows.where("key").select("stream", "split", F.col("index").alias("start"), F.col("pts").alias("key_pts"))
    so_far = Window.partitionBy("stream").orderBy("split")
    keys = keys.withColumn("top", F.max("key_pts").over(so_far.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    # The latest key time so far tells which packets are stray at all.
    tops = keys.select("stream", "split", "top")
    stray = rows.join(tops, ["stream", "split"]).where("pts < top").select("stream", "index", "pts", F.col("split").alias("own"))
    # For each of them, the first key whose top is later: the number of tops that aren't, found in one pass by time.
    timeline = keys.select("stream", F.col("top").alias("at"), F.lit(0).alias("kind"), "split", F.lit(None).cast("long").alias("index"), F.lit(None).cast("long").alias("own"))
    timeline = timeline.unionByName(stray.select("stream", F.col("pts").alias("at"), F.lit(1).alias("kind"), F.lit(None).cast("long").alias("split"), "index", "own"))
    by_time = Window.partitionBy("stream").orderBy("at", "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    first = timeline.withColumn("first", F.coalesce(F.max("split").over(by_time) + 1, F.lit(0))).where("kind = 1")
    shown = first.select("stream", "index", F.col("at").alias("pts"), "own", F.explode(F.sequence("first", "own")).alias("split"))
    before = shown.join(keys.select("stream", "split", "key_pts"), ["stream", "split"]).where("pts < key_pts")
    # Split k - 1 reaches up to the last packet shown before key k.
    ends = before.groupBy("stream", "split").agg(F.max(F.struct("index", "own")).alias("last"))
    ahead = Window.partitionBy("stream").orderBy("split")
    counts = rows.groupBy("stream").agg(F.max("index").alias("_last"))
    splits = keys.join(ends, ["stream", "split"], "left").join(counts, "stream")
    end = F.coalesce(F.lead("last.index").over(ahead) + 1, F.lead("start").over(ahead), F.col("_last") + 1)
    splits = splits.select("stream", "split", "start", end.alias("end"), F.coalesce(F.lead("last.own").over(ahead), F.col("split")).alias("reach"))
    invalid = before.join(splits.select("stream", "split", "end"), ["stream", "split"]).where("index < end").groupBy("stream", "split").agg(F.count(F.lit(1)).alias("num_invalid"))
    return splits.join(invalid, ["stream", "split"], "left").select("stream", "split", "start", "end", F.coalesce("num_invalid", F.lit(0)).alias("num_invalid"), "reach")


def frames_wanted(packets: DataFrame, wanted: DataFrame, *, block: int = BLOCK) -> DataFrame:
    """(stream, split, start, end, reach, frames) of the splits in which frames are wanted, of wanted (stream, index): frames are the wanted frames'
    places among those that a decoder gives for the split. A frame that two splits hold is taken from the earlier one.

    An index outside the stream, and one that is wanted twice, fail the query, as does a null.
    """
    splits = keyframe_splits(packets, block=block)
    asked = wanted.select("stream", F.coalesce("index", F.lit(-1)).cast("long").alias("index")).groupBy("stream", "index").agg(F.count(F.lit(1)).alias("_n"))
    found = asked.join(_keyed(packets.select("stream", "index", "pts", "is_key"), block).select("stream", "index", "split"), ["stream", "index"], "left")
    problem = F.when(F.col("split").isNull(), "a frame's index is out of range").when(F.col("_n") > 1, "a frame's index is given twice")
    # Of a split and those before that reach into it, the earliest that holds the packet has it.
    reached = splits.select("stream", "start", "end", "num_invalid", "reach", F.col("split").alias("_split"), F.explode(F.sequence("split", "reach")).alias("split"))
    found = found.withColumn("split", F.when(problem.isNull(), F.col("split")).otherwise(F.raise_error(problem)))
    held = found.join(reached, ["stream", "split"]).where("index < end")
    first = held.groupBy("stream", "index").agg(F.min(F.struct("_split", "start", "end", "num_invalid", "reach")).alias("s"))
    place = F.col("index") - F.col("s.start") - F.col("s.num_invalid")
    return first.groupBy("stream", F.col("s._split").alias("split"), F.col("s.start").alias("start"), F.col("s.end").alias("end"), F.col("s.reach").alias("reach")).agg(
        F.array_sort(F.collect_list(place)).alias("frames")
    )


def packets_of(packets: DataFrame, splits: DataFrame, *, block: int = BLOCK) -> DataFrame:
    """The packets of each of these splits, in columns split and of packets: what a decoder is given, one group of pictures with its strays. A packet that two
    splits hold is there twice."""
    keyed = packets.join(_keyed(packets.select("stream", "index", "pts", "is_key"), block).select("stream", "index", F.col("split").alias("_own")), ["stream", "index"])
    reached = splits.select("stream", "split", "end", F.explode(F.sequence("split", "reach")).alias("_own"))
    return keyed.join(reached, ["stream", "_own"]).where("index < end").select("split", *packets.columns)


# -- records ---------------------------------------------------------------------------------------------------

#: The format's fixed values: a mark, the version, and the kinds of media by number.
MARK, VERSION = b"MRPK", 1
MEDIA = ("audio", "video", "image")
RATIONAL = "struct<num:int,den:int>"
PACKET = "struct<pts:bigint,dts:bigint,duration:bigint,flags:int,data:binary>"
PACKETS = (
    f"struct<media:string,src:string,stream_index:int,time_base:{RATIONAL},window:struct<start:{RATIONAL},end:{RATIONAL}>,"
    f"codec:struct<name:string,frame_rate:{RATIONAL},extra:binary>,packets:array<{PACKET}>>"
)
_NO_TIME = -(1 << 63)


class RecordError(ValueError):
    """The bytes are no record of packets that this version reads."""


def _text(value: str | bytes | None) -> bytes:
    data = (value or b"").encode() if isinstance(value, str) else bytes(value or b"")
    return struct.pack("<I", len(data)) + data


def _rational(r: dict | None) -> bytes:
    return struct.pack("<ii", r["num"], r["den"]) if r else struct.pack("<ii", 0, 1)


def encode_record(p: dict) -> bytes:
    """Packets (a dict of PACKETS' fields) as bytes: mark, version, media, source, time base, window and codec if there are any, packets with
    their lengths, and a CRC-32 of all of it. A missing time is the smallest number."""
    if p["media"] not in MEDIA:
        raise RecordError(f"unknown media: {p['media']}")
    parts = [MARK, struct.pack("<BB", VERSION, MEDIA.index(p["media"])), _text(p["src"]), struct.pack("<i", p["stream_index"] or 0), _rational(p["time_base"])]
    window, codec = p["window"], p["codec"]
    parts.append(struct.pack("<B", 0) if window is None else struct.pack("<B", 1) + _rational(window["start"]) + _rational(window["end"]))
    parts.append(struct.pack("<B", 0) if codec is None else struct.pack("<B", 1) + _text(codec["name"]) + _rational(codec["frame_rate"]) + _text(codec["extra"]))
    packets = p["packets"] or []
    parts.append(struct.pack("<I", len(packets)))
    time = lambda t: _NO_TIME if t is None else t
    for x in packets:
        parts += [struct.pack("<qqqi", time(x["pts"]), time(x["dts"]), x["duration"] or 0, x["flags"] or 0), _text(x["data"])]
    body = b"".join(parts)
    return body + struct.pack("<I", zlib.crc32(body))


class _Reader:
    def __init__(self, data: bytes):
        self.data, self.at = memoryview(data), 0

    def take(self, n: int) -> memoryview:
        if self.at + n > len(self.data):
            raise RecordError("the record is truncated")
        self.at += n
        return self.data[self.at - n : self.at]

    def numbers(self, form: str) -> tuple:
        return struct.unpack(form, self.take(struct.calcsize(form)))

    def text(self) -> bytes:
        return bytes(self.take(self.numbers("<I")[0]))

    def rational(self) -> dict:
        num, den = self.numbers("<ii")
        return {"num": num, "den": den}

    def flag(self) -> bool:
        (x,) = self.numbers("<B")
        if x > 1:
            raise RecordError("a flag is neither 0 nor 1")
        return bool(x)


def decode_record(data: bytes) -> dict:
    """The packets of a record. Another mark, version or kind of media, a wrong checksum, lengths beyond the end and bytes left over raise."""
    r = _Reader(data)
    if bytes(r.take(4)) != MARK:
        raise RecordError("not a record of packets")
    version, media = r.numbers("<BB")
    if version != VERSION:
        raise RecordError(f"version {version} isn't supported")
    if len(data) < 4 or zlib.crc32(memoryview(data)[:-4]) != int.from_bytes(data[-4:], "little"):
        raise RecordError("the record is damaged")
    if media >= len(MEDIA):
        raise RecordError(f"unknown media: {media}")
    out = {"media": MEDIA[media], "src": r.text().decode("utf-8", "replace"), "stream_index": r.numbers("<i")[0], "time_base": r.rational()}
    out["window"] = {"start": r.rational(), "end": r.rational()} if r.flag() else None
    out["codec"] = {"name": r.text().decode("utf-8", "replace"), "frame_rate": r.rational(), "extra": r.text()} if r.flag() else None
    out["packets"] = []
    time = lambda t: None if t == _NO_TIME else t
    for _ in range(r.numbers("<I")[0]):
        pts, dts, duration, flags = r.numbers("<qqqi")
        out["packets"].append({"pts": time(pts), "dts": time(dts), "duration": duration, "flags": flags, "data": r.text()})
    if r.at != len(data) - 4:
        raise RecordError("the record is longer than its packets")
    return out


def _arrow_type(ddl: str) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type
    from pyspark.sql.types import DataType

    return to_arrow_type(DataType.fromDDL(ddl))


def serialised(packets: Column) -> Column:
    """Packets (PACKETS) as records; null where they are null."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for a in batches:
            yield pa.array([None if p is None else encode_record(p) for p in a.to_pylist()], pa.binary())

    return F.arrow_udf(run, "binary")(packets)


def deserialised(record: Column, media: str | None = None) -> Column:
    """struct<packets, error> of records: exactly one of them is null, or both for a null record. media: the kind that is expected."""
    out = f"struct<packets:{PACKETS},error:string>"
    kind = _arrow_type(out)

    def one(data: bytes | None) -> dict:
        if data is None:
            return {"packets": None, "error": None}
        try:
            p = decode_record(data)
            if media is not None and p["media"] != media:
                raise RecordError(f"expected {media}, found {p['media']}")
        except RecordError as e:
            return {"packets": None, "error": str(e)}
        return {"packets": p, "error": None}

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for a in batches:
            yield pa.array([one(x) for x in a.to_pylist()], kind)

    return F.arrow_udf(run, out)(record)
