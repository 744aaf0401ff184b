"""Archives and WAV audio read by ranges."""

import io
import random
import tarfile
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.sources import formats, media, ranges


@pytest.fixture(scope="module")
def contents():
    rng = random.Random(1)
    out = {f"d/{i:03}.bin": rng.randbytes(rng.choice([0, 1, 700, 40_000])) for i in range(60)}
    return out | {"text.txt": b"abc " * 100_000, "ä" * 120 + ".txt": b"long name"}


def paths(spark, *names):
    return spark.createDataFrame([(str(n),) for n in names], "path string")


def whole(df):
    parts, errors = {}, []
    for r in df.collect():
        if r.error is not None:
            errors.append(r.error)
        else:
            parts.setdefault(r.member, {})[r.part] = bytes(r.content)
    for p in parts.values():
        assert sorted(p) == list(range(len(p)))
    return {m: b"".join(p[k] for k in sorted(p)) for m, p in parts.items()}, errors


@pytest.mark.parametrize("method", [zipfile.ZIP_STORED, zipfile.ZIP_DEFLATED])
@pytest.mark.parametrize("part", [ranges.PART, 1000])
def test_zip(spark, tmp_path, contents, method, part):
    with zipfile.ZipFile(tmp_path / "a.zip", "w", method) as z:
        z.mkdir("d")
        for name, data in contents.items():
            z.writestr(name, data)
    index = ranges.archive_index(paths(spark, tmp_path / "a.zip"), "zip")
    members = ranges.archive_members(index, range_bytes=20_000, part_bytes=part)
    got, errors = whole(members)
    assert got == contents and not errors
    tasks = members.where("error is null").withColumn("task", F.spark_partition_id()).agg(F.count_distinct("task")).first()[0]
    assert tasks > 1  # one archive, several partitions


@pytest.mark.parametrize("form", [tarfile.GNU_FORMAT, tarfile.PAX_FORMAT])
def test_tar(spark, tmp_path, contents, form):
    with tarfile.open(tmp_path / "a.tar", "w", format=form) as t:
        for name, data in contents.items():
            info = tarfile.TarInfo(name)
            info.size = len(data)
            t.addfile(info, io.BytesIO(data))
    index = ranges.archive_index(paths(spark, tmp_path / "a.tar"), "tar")
    got, errors = whole(ranges.archive_members(index, range_bytes=20_000, part_bytes=5000))
    assert got == contents and not errors


def test_zip_with_wide_fields(spark, tmp_path):
    """Members written as streams of unknown size have 64-bit fields."""
    with zipfile.ZipFile(tmp_path / "w.zip", "w", zipfile.ZIP_DEFLATED) as z:
        with z.open("wide.bin", "w", force_zip64=True) as f:
            f.write(b"x" * 100_000)
    data = bytearray((tmp_path / "w.zip").read_bytes())
    # The same directory with its sizes in the 64-bit field, and a 64-bit end.
    at = data.index(b"PK\x01\x02")
    stored, full, place = (int.from_bytes(data[at + k : at + k + 4], "little") for k in (20, 24, 42))
    name = b"wide.bin"
    extra = (1).to_bytes(2, "little") + (24).to_bytes(2, "little") + b"".join(x.to_bytes(8, "little") for x in (full, stored, place))
    entry = data[at : at + 20] + b"\xff" * 8 + len(name).to_bytes(2, "little") + len(extra).to_bytes(2, "little") + data[at + 32 : at + 42] + b"\xff" * 4 + name + extra
    end64 = b"PK\x06\x06" + (44).to_bytes(8, "little") + b"\0" * 12 + b"".join(x.to_bytes(8, "little") for x in (1, 1, len(entry), at))
    locator = b"PK\x06\x07" + b"\0" * 4 + (at + len(entry)).to_bytes(8, "little") + (1).to_bytes(4, "little")
    end = b"PK\x05\x06" + b"\0" * 4 + b"\xff" * 2 + b"\xff" * 2 + b"\xff" * 8 + b"\0\0"
    (tmp_path / "w64.zip").write_bytes(data[:at] + entry + end64 + locator + end)
    got, errors = whole(ranges.archive_members(ranges.archive_index(paths(spark, tmp_path / "w64.zip"), "zip")))
    assert got == {"wide.bin": b"x" * 100_000} and not errors


def test_damaged_archives(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("one", b"a" * 100)
        z.writestr("two", b"b" * 100)
    data = (tmp_path / "a.zip").read_bytes()
    (tmp_path / "bad.zip").write_bytes(data.replace(b"b" * 100, b"b" * 99 + b"?"))
    (tmp_path / "no.zip").write_bytes(b"nothing")
    (tmp_path / "empty.zip").write_bytes(b"")
    index = ranges.archive_index(paths(spark, *(tmp_path / n for n in ("bad.zip", "no.zip", "empty.zip", "gone.zip"))), "zip")
    got, errors = whole(ranges.archive_members(index))
    assert got["one"] == b"a" * 100 and len(errors) == 4 and any("checksum" in e for e in errors)
    with tarfile.open(tmp_path / "a.tar", "w") as t:
        for name in ("one", "two"):
            info = tarfile.TarInfo(name)
            info.size = 600
            t.addfile(info, io.BytesIO(b"c" * 600))
    (tmp_path / "cut.tar").write_bytes((tmp_path / "a.tar").read_bytes()[: 512 + 1024 + 512 + 100])
    got, errors = whole(ranges.archive_members(ranges.archive_index(paths(spark, tmp_path / "cut.tar"), "tar")))
    assert got == {"one": b"c" * 600} and len(errors) == 1


@pytest.mark.parametrize("how", [{"num_packets": 3}, {"duration": 0.25}])
def test_wav_chunks(spark, tmp_path, how):
    rng = np.random.default_rng(2)
    audio = {"a": rng.integers(-999, 999, (50_000, 2)).astype(np.int16), "b": rng.random((5, 1)).astype(np.float32), "c": np.zeros((0, 1), np.int16)}
    for k, x in audio.items():
        (tmp_path / f"{k}.wav").write_bytes(media.encode_wav(x, 8000))
    (tmp_path / "bad.wav").write_bytes(b"RIFFxxxxWAVE")
    out = ranges.wav_chunks(paths(spark, *(tmp_path / f"{k}.wav" for k in ("a", "b", "c", "bad"))), **how)
    step = 3 * ranges.PACKET if "num_packets" in how else 2000
    rows = sorted(out.withColumn("task", F.spark_partition_id()).collect(), key=lambda r: (r.path, r.chunk or 0))
    assert [r.error for r in rows if r.error] == ["no samples"] and len({r.task for r in rows}) > 1
    for k, x in audio.items():
        mine = [r for r in rows if r.path.endswith(f"/{k}.wav")]
        assert [(r.chunk, r.start) for r in mine] == [(i, i * step) for i in range(-(-len(x) // step))]
        if mine:
            back = np.concatenate([np.frombuffer(r.tensor.data, r.tensor.dtype).reshape(r.tensor.shape) for r in mine])
            assert back.dtype == x.dtype and (back == x).all()


def test_one_kind_of_chunk(spark):
    for bad in ({}, {"num_packets": 1, "duration": 1.0}, {"num_packets": 0}, {"duration": -1.0}):
        with pytest.raises(ValueError):
            ranges.wav_chunks(paths(spark, "x"), **bad)


def test_chunks_are_those_of_the_whole_file(spark, tmp_path):
    x = np.arange(9000, dtype=np.int32).reshape(-1, 1)
    data = media.encode_wav(x, 8000)
    (tmp_path / "x.wav").write_bytes(data)
    (r,) = ranges.wav_chunks(paths(spark, tmp_path / "x.wav"), num_packets=100).collect()
    assert (np.frombuffer(r.tensor.data, np.int32).reshape(-1, 1) == formats.load_wav(data)).all()
