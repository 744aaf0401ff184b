"""Parsers against the standard library's writers; figures and descriptions."""

import io
import json
import struct
import tarfile
import wave

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace import stats
from millrace.functions import arrays, filters
from millrace.sources import files, formats


def npy(a):
    f = io.BytesIO()
    np.save(f, a)
    return f.getvalue()


@pytest.mark.parametrize("dtype", ["u1", "u2", "i2", "i4", "f4", "f8", ">i4"])
@pytest.mark.parametrize("order", ["C", "F"])
def test_npy(dtype, order):
    a = np.arange(120).astype(dtype).reshape((2, 3, 4, 5), order=order)
    got = formats.load_npy(npy(a))
    assert got.shape == a.shape and (got == a).all()
    assert (formats.from_tensor(formats.tensor(a)) == a).all()


def test_npz():
    f = io.BytesIO()
    np.savez_compressed(f, x=np.arange(4), y=np.eye(2))
    z = formats.Npz(f.getvalue())
    assert z.keys() == ["x", "y"] and (z["x.npy"] == z["x"]).all() and (z["y"] == np.eye(2)).all()
    with pytest.raises(KeyError):
        z["nothing"]


@pytest.mark.parametrize("kind", [tarfile.PAX_FORMAT, tarfile.GNU_FORMAT, tarfile.USTAR_FORMAT])
def test_tar(kind):
    want = {"a.txt": b"hello", "empty": b"", "all": bytes(range(256)) * 5}
    if kind != tarfile.USTAR_FORMAT:
        want["d/" + "x" * 150] = b"long"
    f = io.BytesIO()
    with tarfile.open(fileobj=f, mode="w", format=kind) as t:
        folder = tarfile.TarInfo("folder")
        folder.type = tarfile.DIRTYPE
        t.addfile(folder)
        for k, v in want.items():
            i = tarfile.TarInfo(k)
            i.size = len(v)
            t.addfile(i, io.BytesIO(v))
    data = f.getvalue()
    assert dict(formats.iter_tar(data)) == want
    assert dict(formats.iter_tar(b"\1" * 512 + data)) == want  # a broken header is passed over
    assert list(formats.iter_tar(data[:1300]))[:1] == [("a.txt", b"hello")][: len(list(formats.iter_tar(data[:1300])))]
    assert list(formats.iter_tar(b"")) == []


def wav(bits, samples, kind=1, rate=8000):
    body, channels = samples.tobytes(), samples.shape[1]
    align = channels * bits // 8
    head = b"WAVEfmt " + struct.pack("<IHHIIHH", 16, kind, channels, rate, rate * align, align, bits) + b"data" + struct.pack("<I", len(body))
    return b"RIFF" + struct.pack("<I", len(head) + len(body)) + head + body


@pytest.mark.parametrize(("bits", "kind", "dtype"), [(8, 1, "u1"), (16, 1, "<i2"), (32, 1, "<i4"), (32, 3, "<f4"), (64, 3, "<f8")])
def test_wav(bits, kind, dtype):
    a = np.arange(16000).reshape(-1, 2).astype(dtype)
    data = wav(bits, a, kind)
    assert (formats.load_wav(data) == a).all()
    assert (formats.load_wav(data, 0.25, 0.5) == a[2000:6000]).all() and (formats.load_wav(data, 0.75, 9.0) == a[6000:]).all()
    assert formats.parse_wav(data)["data_size"] == len(a.tobytes())
    for bad in ((1.0, None), (-1, None), (0, -1)):
        with pytest.raises(ValueError):
            formats.load_wav(data, *bad)


def test_wav_of_the_standard_library():
    f = io.BytesIO()
    with wave.open(f, "wb") as w:
        w.setnchannels(2)
        w.setsampwidth(2)
        w.setframerate(8000)
        w.writeframes(np.arange(100, dtype="<i2").tobytes())
    assert (formats.load_wav(f.getvalue()) == np.arange(100).reshape(-1, 2)).all()
    for bad in (b"", b"RIFF", f.getvalue()[:30], wav(24, np.zeros((3, 2), "u1"))):
        with pytest.raises(ValueError):
            formats.load_wav(bad)


def test_tables_of_files_keep_errors_as_rows(spark):
    df = spark.createDataFrame([("good", bytearray(npy(np.arange(3)))), ("bad", bytearray(b"junk")), ("none", None)], "path string, content binary")
    got = {r.path: r for r in formats.npy_table(df).collect()}
    assert (formats.from_tensor(got["good"].tensor) == np.arange(3)).all() and got["bad"].error and got["none"].error


def test_directory_lines_and_listing(spark, tmp_path):
    (tmp_path / "d").mkdir()
    for n in ("b.bin", "a.bin", "c.txt", "d/e.bin"):
        (tmp_path / n).write_bytes(b"x")
    names = lambda df: [r.path.rsplit("/", 1)[1] for r in df.collect()]
    assert names(files.directory(spark, str(tmp_path), "*.bin")) == ["a.bin", "b.bin"]
    assert sorted(names(files.directory(spark, str(tmp_path), "**/*.bin"))) == ["a.bin", "b.bin", "e.bin"]
    (tmp_path / "x.jsonl").write_text(json.dumps({"a": 1}) + "\n\n  \n" + json.dumps({"a": 2}) + "\n")
    assert [r.a for r in files.json_lines(spark, [str(tmp_path / "x.jsonl")], "a int").orderBy("line").collect()] == [1, 2]
    paths = spark.createDataFrame([("train/n00000001/x.JPEG",), ("train/n00000002/x.JPEG",)], "path string")
    classes = spark.createDataFrame([("n00000001", 7)], "wnid string, class_id int")
    assert [r.class_id for r in files.image_listing(paths, classes).collect()] == [7]
    with pytest.raises(Exception, match="no class id"):
        spark.createDataFrame([("x",)], "p string").select(filters.wnid(F.col("p"))).collect()
    with pytest.raises(ValueError):
        files.split_pattern("test")


def test_filter_descriptions(spark):
    one = spark.range(1)
    get = lambda c: one.select(c).first()[0]
    L = F.lit
    assert get(filters.audio_filter()) is None
    assert get(filters.audio_filter(num_channels=L(2), sample_rate=L(16000), start=L(0.5), end=L(float("inf")), num_frames=L(7), sample_fmt=L("fltp"), custom=L("x"))) == (
        "aformat=channel_layouts=2c,aresample=16000,atrim=start=0.5,apad,atrim=end_sample=7,x,aformat=sample_fmts=fltp"
    )
    assert get(filters.video_filter(frame_rate=(L(30), L(1)), scale_width=L(8), scale_mode="crop", crop_height=L(4), num_frames=L(3), pad_color="red", pix_fmt=L("rgb24"))) == (
        "fps=30/1,scale=w=8:h=0:flags=bicubic:force_original_aspect_ratio=increase,crop=w=8:h=0,crop=w=0:h=4,tpad=stop=-1:stop_mode=add:color=red,trim=end_frame=3,format=pix_fmts=rgb24"
    )
    assert get(filters.video_filter(scale_width=L(8), scale_height=L(6), scale_mode=None)) == "scale=w=8:h=6:flags=bicubic"
    with pytest.raises(ValueError):
        filters.video_filter(scale_mode="stretch")


def test_arrays(spark):
    row = spark.createDataFrame([([1.0, 2.0], "a  b c")], "v array<double>, t string")
    got = row.select(arrays.normalised(F.col("v"), 1.0, 2.0), arrays.tokens(F.col("t"), 5), arrays.tokens(F.col("t"), 2), arrays.prompt(F.lit("i"), F.lit(""), F.lit("o"))).first()
    assert list(got) == [[0.0, 0.5], ["a", "b", "c", "<pad>", "<pad>"], ["a", "b"], "### Instruction:\ni\n\n### Response:\no"]
    grey = np.full((6, 4), 128, np.uint8)
    assert (arrays.nv12_to_rgb(grey, full_range=True) == 128).all()
    frame = grey.copy()
    frame[4:, 1::2] = 255  # much red
    rgb, bgr = arrays.nv12_to_rgb(frame), arrays.nv12_to_rgb(frame, bgr=True)
    assert rgb[0, 0, 0, 0] == 255 and (rgb[:, ::-1] == bgr).all()


def test_p_square():
    m = stats.P2(90)
    assert m.value == 0
    for x in (5.0, 1.0, 3.0):
        m.add(x)
    assert m.value == 5.0
    rng = np.random.default_rng(1)
    m = stats.P2(90)
    for x in rng.uniform(size=5000):
        m.add(x)
    assert abs(m.value - 0.9) < 0.02


def _fifo(events):
    open_, out = [], []
    for i, kind in events:
        if kind == "start":
            open_.append(i)
        elif kind == "stop" and open_:
            out.append((open_.pop(0), i))
    return out


def test_pairs_against_a_fold(spark):
    import random

    for seed in range(4):
        rng = random.Random(seed)
        events = [(i, rng.choice(["start", "stop", "other"])) for i in range(60)]
        df = spark.createDataFrame([(0, *e) for e in events], "g int, i int, kind string")
        got = sorted((r.started, r.stopped) for r in stats.event_pairs(df, "i", "kind", "start", "stop", ["g"]).collect())
        assert got == sorted(_fifo(events))


def test_rationals_and_intervals(spark):
    assert filters.rational_window("0.1", 2) == ((1, 10), (2, 1))
    L = F.lit
    got = spark.range(1).select(filters.before((L(1), L(3)), (L(334), L(1000))), filters.before((L(2), L(6)), (L(1), L(3)))).first()
    assert tuple(got) == (True, False)
    df = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("b", 5.0)], "name string, v double")
    rows = {r.name: r for r in stats.mean_interval(df, "name", "v").collect()}
    assert rows["a"].mean == 2.0 and rows["a"].low < 2 < rows["a"].high and rows["b"].low == rows["b"].high == 5.0


def test_a_best_path_without_parents(spark):
    df = spark.createDataFrame([(1, 9, 2.0), (2, 1, 1.0), (3, 1, 0.0), (4, 2, None)], "id long, parent_id long, duration double")
    assert [tuple(r) for r in stats.best_path(df).collect()] == [(1, 2)]


def test_tar_archives_read_from_front_to_back(spark, tmp_path):
    import tarfile

    entries = {"a.txt": b"1" * 700, "x" * 150 + ".txt": b"", "d/é.bin": bytes(range(256)) * 3}
    for kind in (tarfile.GNU_FORMAT, tarfile.PAX_FORMAT):
        f = io.BytesIO()
        with tarfile.open(fileobj=f, mode="w", format=kind) as t:
            t.addfile(tarfile.TarInfo("folder/"))
            for name, body in entries.items():
                info = tarfile.TarInfo(name)
                info.size = len(body)
                t.addfile(info, io.BytesIO(body))
        data = f.getvalue()
        assert dict(formats.walk_tar(io.BytesIO(data))) == entries | {"folder/": b""} or dict(formats.walk_tar(io.BytesIO(data))) == entries
        with pytest.raises(ValueError):
            list(formats.walk_tar(io.BytesIO(data[:900])))
    (tmp_path / "whole.tar").write_bytes(data)
    (tmp_path / "short.tar").write_bytes(data[: len(data) // 2][: 3 * 512 + 100])
    paths = spark.createDataFrame([(str(tmp_path / n),) for n in ("whole.tar", "short.tar", "none.tar")], "path string")
    rows = formats.tar_files(paths).collect()
    assert {r.member: bytes(r.content) for r in rows if r.path.endswith("whole.tar") and r.error is None}.items() >= entries.items()
    assert sum(r.error is not None for r in rows) == 2


def test_json_lines_of_several_blocks(spark, tmp_path):
    (tmp_path / "big.jsonl").write_text("".join(f'{{"a": {i}}}\n' + ("\n" if i % 5 == 0 else "") for i in range(3000)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")
    try:
        rows = files.json_lines(spark, [str(tmp_path / "big.jsonl")], "a int").orderBy("line").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert [r.a for r in rows] == list(range(3000)) and rows[1].line == 2 and len({r.line for r in rows}) == 3000
