import os
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace import hooks
from millrace.sources import formats, media


def test_images_and_audio_round_trip():
    rng = np.random.default_rng(0)
    for shape in ((4, 6, 3), (5, 3, 1)):
        a = rng.integers(0, 256, shape, np.uint8)
        assert (media.decode_pnm(media.encode_pnm(a)) == a).all()
    assert media.decode_pnm(b"P5 # c\n# d\n1 1\n255\nx")[0, 0, 0] == ord("x")
    for bad in (b"", b"P6 1 1 255", b"P6 1 1 255\nab", b"P3 1 1 255\nabc", b"P5 1 1 65535\nabcd"):
        with pytest.raises(ValueError):
            media.decode_pnm(bad)
    s = np.arange(20, dtype="<i2").reshape(-1, 2)
    assert (formats.load_wav(media.encode_wav(s, 8000)) == s).all()
    with pytest.raises(media.BackendNotInstalled):
        media.backend("video")


def test_image_batches_and_files(spark, tmp_path):
    good = [media.encode_pnm(np.full((2, 2, 3), k, np.uint8)) for k in range(3)]
    df = spark.createDataFrame([(f"p{k}", bytearray(g)) for k, g in enumerate(good)], "path string, content binary")
    assert media.image_batch(df, 4, 3).shape == (3, 3, 4, 3)
    mixed = df.unionByName(spark.createDataFrame([("q", bytearray(b"junk"))], df.schema))
    assert media.image_batch(mixed, 2, 2, strict=False)[:, 0, 0, 0].tolist() == [0, 1, 2]
    for bad, error in ((mixed, RuntimeError), (df.limit(0), ValueError), (mixed.where("path = 'q'"), RuntimeError)):
        with pytest.raises(error):
            media.image_batch(bad, 2, 2)
    frames = media.decoded(df, "image").select(F.col("path").alias("name"), "tensor")
    written = media.write_files(frames, str(tmp_path / "out"), media.encode_pnm, ".ppm").collect()
    assert len(written) == 3 and (tmp_path / "out/p2.ppm").read_bytes() == good[2]


def test_picked_frames_and_groups(spark):
    df = spark.createDataFrame([([10, 11, 12, 13],)], "f array<int>")
    assert df.select(media.pick_frames(F.col("f"), [0, 3], F.size("f"))).first()[0] == [10, 13]
    for bad in ([], [3, 0], [1, 1], [-1]):
        with pytest.raises(ValueError):
            media.pick_frames(F.col("f"), bad, F.size("f"))
    with pytest.raises(Exception, match="out of range"):
        df.select(media.pick_frames(F.col("f"), [4], F.size("f"))).collect()
    packets = [(0, 0, True), (1, 2, False), (2, 1, False), (3, 5, True), (4, 4, False), (5, 6, False)]  # order, time, key
    got = media.decode_groups(spark.createDataFrame([(1, *p) for p in packets], "s int, o int, pts int, key boolean"), "s", "o", "pts", "key")
    assert [r.key_pts for r in got.orderBy("o").collect()] == [0, 0, 0, 5, 0, 5]


def test_hooks(spark):
    df, seen = hooks.observed(spark.range(10), "stage", F.col("id") > 7)
    assert df.count() == 10 and seen.get == {"num_tasks": 10, "num_failures": 2}
    assert hooks.setting(spark, "millrace.stats") == "false" and hooks.stage_name(0, "1", "map", 4) == "0:1:map[4]"
    ran = []
    end = hooks.background(lambda stop: ran.append(stop.wait(5)))
    time.sleep(0.1)
    end()
    assert ran == [True]
    hooks.background(lambda stop: 1 / 0)()


def test_batches_of_images_stay_a_table(spark):
    import numpy as np

    ppm = lambda w, h, v: b"P5 %d %d 255\n" % (w, h) + bytes([v]) * (w * h)
    df = spark.createDataFrame([(f"{k}.pgm", bytearray(ppm(2 + k, 3, 10 * k) if k != 3 else b"P5 broken")) for k in range(5)], "path string, content binary")
    rows = media.image_batches(df, 2, 4, 2).orderBy("batch_id").collect()
    assert [(r.paths, r.failed, r.tensor.shape) for r in rows] == [
        (["0.pgm", "1.pgm"], [], [2, 2, 4, 3]), (["2.pgm"], ["3.pgm"], [1, 2, 4, 3]), (["4.pgm"], [], [1, 2, 4, 3]),
    ]
    assert set(np.frombuffer(rows[0].tensor.data, np.uint8).reshape(2, -1)[1].tolist()) == {10}


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="needs the driver's tables")
def test_audio_is_dealt_to_tasks_by_its_own_size(spark, monkeypatch):
    from millrace import feature_queries

    monkeypatch.setattr(feature_queries, "AUDIO", 1 << 19)
    made = feature_queries._audio(spark, "/root/testdata/sf0.01")
    assert made.rdd.getNumPartitions() == 12 and made.count() == 150  # 10,000 events of 600 bytes
