import struct

import numpy as np
from pyspark.sql import functions as F

from tessera.operators import atlas
from tessera.operators.movie import match_sessions
from tessera.sources import imager, raw


def test_atlas_paints_both_sides(spark):
    square = ([2.0, 7.0, 7.0, 2.0, 2.0], [2.0, 2.0, 8.0, 8.0, 2.0])
    right = [x + 10 for x in square[0]]
    r = spark.createDataFrame([(0, "A", *square, right, square[1])], "region_id int, acronym string, left_x array<double>, left_y array<double>, right_x array<double>, right_y array<double>")
    got = {x["pixel_id"]: x["area_id"] for x in atlas.atlas_of(r, 12, 22).collect()}
    assert got[5 * 22 + 4] == 1 and got[5 * 22 + 14] == -1 and 0 not in got
    assert {(x["area_id"], x["name"]) for x in atlas.area_names(r).collect()} == {(1, "A_left"), (-1, "A_right")}


def test_flattened_areas_are_mirrored(spark):
    rows = [(i, j, 3) for i in range(2, 6) for j in range(1, 5)] + [(8, 1, 3)]
    p = spark.createDataFrame(rows, "i int, j int, label int")
    a = atlas.flatten_areas(p, 10, 12, (6, 5), 1000.0).first()
    assert a["label"] == 3 and max(a["left_y"]) == 0.0 and [-x for x in a["left_x"]] == a["right_x"]
    o = atlas.projection_outline(p, 10, 12, (6, 5), 1000.0, closing=2)
    assert o.count() > 8


def test_recording(spark, tmp_path):
    frames = np.zeros((40, 1, 3, 4), np.uint16)
    frames[4:36] = 100
    frames[4:36:2] = 200
    frames.tofile(tmp_path / "Frames_1_3_4_uint16_7.dat")
    n = 400
    analog = np.zeros((n, 3), "<u2")
    for k in range(4, 36):
        led = k % 2
        analog[k * 10 : k * 10 + 5, led] = 3000
    (tmp_path / "Analog_7.dat").write_bytes(struct.pack("<4d", 0, 0, 3, n) + analog.tobytes())
    r = imager.read_recording(spark, [str(tmp_path / "Frames_1_3_4_uint16_7.dat")], str(tmp_path / "Analog_7.dat"), n_baseline=5)
    got = r.frames.orderBy("frame_id", "channel").collect()
    per = {c: [x for x in got if x["channel"] == c] for c in (0, 1)}
    assert len(per[0]) == len(per[1]) == 16
    assert {x["pixels"][0] for x in per[0]} == {200.0} and {x["pixels"][0] for x in per[1]} == {100.0}
    assert r.baseline.filter("channel = 0").agg(F.avg("f0")).first()[0] == 200.0


def test_tiffs_come_back(spark, tmp_path):
    x = np.arange(6 * 2 * 3 * 4, dtype=np.float32).reshape(12, 12)
    rows = [(k // 2, k % 2, 3, 4, r.tolist()) for k, r in enumerate(x)]
    f = spark.createDataFrame(rows, "frame_id long, channel int, h int, w int, pixels array<float>")
    assert raw.write_tiffs(f, str(tmp_path / "t"), chunk=4) == 2
    back = raw.read_movie(spark, str(tmp_path / "t")).orderBy("frame_id", "channel").collect()
    assert [list(r["pixels"]) for r in back] == x.tolist()


def test_sessions_match(spark):
    from tessera.operators.morphology import gaussian

    big = gaussian(np.random.default_rng(0).standard_normal((48, 48)), 2.0) * 1000 + 1000
    one = lambda a: spark.createDataFrame([(0, 0, a.ravel().tolist())], "frame_id long, channel int, pixels array<double>")
    mask = spark.createDataFrame([(p, p % 32 < 16) for p in range(1024)], "pixel_id int, keep boolean")
    points = spark.createDataFrame([(10.0, 12.0)], "x double, y double")
    m, p, k = match_sessions(one(big[8:40, 8:40]), one(big[6:38, 7:39]), points, mask, 32, 32)
    got = p.first()
    assert abs(got["y"] - 14) < 0.7 and abs(got["x"] - 11) < 0.7
    assert k.count() == 1024
