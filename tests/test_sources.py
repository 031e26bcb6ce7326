import os
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.sources import raw
from tessera.sources.landmarks import STANDARD, points_of, read_landmarks
from tessera.sources.names import parse_name
from tessera.streaming import movies


def test_raw_movies(spark, tmp_path):
    x = np.arange(20 * 2 * 3 * 4, dtype=np.uint16).reshape(20, 2, 3, 4)
    x[:12].tofile(tmp_path / "run_2_3_4_uint16_1.dat")
    x[12:].tofile(tmp_path / "run_2_3_4_uint16_2.dat")
    df = raw.read_raw(spark, str(tmp_path), blocksize=5)
    rows = df.orderBy("frame_id", "channel").collect()
    assert len(rows) == 40
    assert np.array_equal(np.array([r["pixels"] for r in rows]).reshape(x.shape), x.astype(np.float32))
    some = raw.read_raw(spark, str(tmp_path), blocksize=5).filter((F.col("frame_id") >= 11) & (F.col("frame_id") < 14))
    assert sorted({r["frame_id"] for r in some.collect()}) == [11, 12, 13]
    out = str(tmp_path / "out")
    raw.write_raw(df.select("frame_id", "channel", "h", "w", "pixels"), out, chunk=8)
    back = raw.read_raw(spark, out).orderBy("frame_id", "channel").collect()
    assert [r["pixels"] for r in back] == [r["pixels"] for r in rows]
    assert raw.read_movie(spark, out).count() == 40
    with pytest.raises(FileNotFoundError):
        raw.files_of(str(tmp_path / "none"))


def test_names():
    assert parse_name("a/run3_2_540_640_uint16_07.dat") == (2, 540, 640, "uint16", [7])
    with pytest.raises(ValueError):
        parse_name("run.dat")


def test_analog_npy_tiff(spark, tmp_path):
    samples = np.array([[1, 2], [3, 4], [5, 6]], "<u2")
    (tmp_path / "Analog_4.dat").write_bytes(struct.pack("<4d", 1.5, 2.0, 2, 3) + samples.tobytes())
    a = raw.read_analog(spark, str(tmp_path / "Analog_4.dat")).orderBy("sample", "analog_channel").collect()
    assert [r["value"] for r in a] == [1, 2, 3, 4, 5, 6] and a[0]["number"] == 4
    np.save(tmp_path / "u.npy", np.arange(6.0).reshape(2, 3))
    n = raw.read_npy(spark, str(tmp_path / "u.npy")).orderBy("position").collect()
    assert [r["value"] for r in n] == list(range(6)) and n[0]["shape"] == [2, 3]
    os.mkdir(tmp_path / "t")
    page = np.arange(12, dtype="<u2").reshape(3, 4)
    tags = [(256, 3, 1, 4), (257, 3, 1, 3), (258, 3, 1, 16), (259, 3, 1, 1), (273, 4, 1, 8), (279, 4, 1, 24)]
    ifd = struct.pack("<H", len(tags)) + b"".join(struct.pack("<HHII", *t) for t in tags) + struct.pack("<I", 0)
    (tmp_path / "t" / "a.tif").write_bytes(b"II*\0" + struct.pack("<I", 32) + page.tobytes() + ifd)
    t = raw.read_movie(spark, str(tmp_path / "t")).collect()
    assert len(t) == 1 and list(t[0]["pixels"]) == list(range(12))


def test_landmarks(spark, tmp_path):
    (tmp_path / "l.json").write_text(STANDARD)
    p = points_of(read_landmarks(spark, str(tmp_path / "l.json")), "landmarks").collect()
    assert {r["name"] for r in p} == {"OB_left", "OB_center", "OB_right", "RSP_base"}


def test_ttl_stream_is_the_batch_result(spark, tmp_path):
    values = [0, 0, 5, 5, 5, 0, 9, 0, 0, 5, 5, 0, 0, 0]
    src = tmp_path / "in"
    for k in range(0, len(values), 5):
        rows = [(0, k + i, float(v)) for i, v in enumerate(values[k : k + 5])]
        spark.createDataFrame(rows, "channel int, sample long, value double").coalesce(1).write.mode("append").parquet(str(src))
    stream = movies.frame_files(spark, str(src), "channel int, sample long, value double", per_trigger=10)
    q = movies.ttl_edges_stream(stream, 2.5).writeStream.format("memory").queryName("edges").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    got = {(r["sample"], r["edge"]) for r in spark.sql("select * from edges").collect()}
    assert got == {(2, 1), (6, -1), (9, 1), (11, -1)}  # the medians are 0 0 5 5 5 5 0 0 0 5 5 0 0


def test_binned_stream(spark, tmp_path):
    spark.createDataFrame([(0, 0, 60 * k, float(k)) for k in range(5)], "channel int, pixel_id int, s long, value double").select("channel", "pixel_id", F.timestamp_seconds("s").alias("ts"), "value").write.parquet(str(tmp_path / "f"))
    stream = movies.frame_files(spark, str(tmp_path / "f"), "channel int, pixel_id int, ts timestamp, value double")
    q = movies.binned_stream(stream).writeStream.format("memory").queryName("bins").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    assert spark.sql("select * from bins").count() >= 2


def test_job_states(spark):
    e = spark.createDataFrame([("a", 1, "in_transfer"), ("a", 2, "restart"), ("b", 1, "submitted"), ("b", 2, "got_results")], "job string, at int, event string")
    assert {r["job"]: r["state"] for r in movies.job_states(e).collect()} == {"a": "pending_transfer", "b": "got_results"}


def test_npy_products(spark, tmp_path):
    rows = spark.createDataFrame([(2, [5.0, 6.0]), (0, [1.0, 2.0]), (1, None)], "k int, v array<double>").withColumn("v", F.coalesce("v", F.array(F.lit(3.0), F.lit(4.0)))).repartition(3)
    raw.write_npy(rows, str(tmp_path / "a.npy"), "k", "v", (3, 2))
    raw.write_npy(rows, f"file://{tmp_path}/b.npy", "k", "v", (2, 3), columns_first=True, dtype="float64")
    assert np.array_equal(np.load(tmp_path / "a.npy"), np.float32([[1, 2], [3, 4], [5, 6]])) and np.array_equal(np.load(tmp_path / "b.npy"), [[1.0, 3, 5], [2, 4, 6]])
    raw.write_npy(spark.createDataFrame([(0, 1.0), (1, None)], "k int, v double"), str(tmp_path / "c.npy"), "k", "v", (2,))
    assert np.isnan(np.load(tmp_path / "c.npy")[1])
    with pytest.raises(ValueError):
        raw.write_npy(rows, str(tmp_path / "d.npy"), "k", "v", (5, 2))
    assert not (tmp_path / "d.npy").exists()


def test_preprocess_saves_its_products(spark, tmp_path):
    from tessera.operators import morphology, movie

    r = np.random.default_rng(6)
    im = morphology.gaussian(r.standard_normal((16, 16)), 1.5) * 300 + 1000
    x = np.stack([[np.roll(im, t % 2, 0) + r.standard_normal((16, 16)) for _ in range(2)] for t in range(90)])
    frames = spark.createDataFrame([(t, c, x[t, c].ravel().tolist()) for t in range(90) for c in range(2)], "frame_id long, channel int, pixels array<double>")
    out = str(tmp_path / "out")
    m, done = movie.preprocess(frames, 16, 16, k=5, out=out, mask=np.ones((16, 16), bool))
    has = {n: np.load(f"{out}/{n}.npy").shape for n in ("U", "SVT", "SVTcorr", "rcoeffs", "T", "frames_average", "mask", "motion_correction_shifts", "motion_correction_rotation")}
    assert has == {"U": (16, 16, 5), "SVT": (5, 180), "SVTcorr": (5, 90), "rcoeffs": (16, 16), "T": (5, 5), "frames_average": (2, 16, 16), "mask": (16, 16), "motion_correction_shifts": (90, 2, 2), "motion_correction_rotation": (90, 2)}
    v = np.stack(m.temporal.orderBy("t").toPandas()["v"])
    assert np.allclose(np.load(f"{out}/SVT.npy"), v.T, atol=1e-5)
    assert raw.read_movie(spark, f"{out}/motioncorrect").count() == 180


def recording(folder, tiff=False):
    """Two trials of 60 lit frames, signal and reference by turns, between dark ones, and their analog files."""
    r = np.random.default_rng(3)
    for trial in (1, 2):
        bright = [0] * 5 + [1] * 60 + [0] * 5
        x = np.stack([np.full((4, 5), 1000 * b) + r.integers(0, 50, (4, 5)) + 100 * (k % 2) * b for k, b in enumerate(bright)]).astype(np.uint16)
        if tiff:
            (folder / f"Frames_{trial}.tif").write_bytes(raw.tiff_bytes(list(x)))
        else:
            x.tofile(folder / f"Frames_1_4_5_uint16_{trial}.dat")
        pulses = np.zeros((70 * 10, 2), "<u2")
        for k in range(5, 65):
            pulses[k * 10 : k * 10 + 5, k % 2] = 1000
        (folder / f"Analog_{trial}.dat").write_bytes(struct.pack("<4d", 1.0, 2.0, 2, len(pulses)) + pulses.tobytes())


@pytest.mark.parametrize("tiff", [False, True])
def test_recording_folder(spark, tmp_path, tiff):
    from tessera.sources import imager

    recording(tmp_path, tiff)
    got = imager.read_folder(spark, str(tmp_path), n_baseline=5)
    n = got.frames.groupBy("channel").count().collect()
    assert {r["channel"] for r in n} == {0, 1} and len({r["count"] for r in n}) == 1 and n[0]["count"] >= 58
    assert raw.read_movie(spark, str(tmp_path)).count() == sum(r["count"] for r in n)
    assert got.trials.count() == 2
    imager.write_recording(got, str(tmp_path / "out"))
    assert raw.read_raw(spark, str(tmp_path / "out")).count() == sum(r["count"] for r in n)
    assert np.load(tmp_path / "out" / "trial_onsets.npy").shape == (2, 3) and np.load(tmp_path / "out" / "frames_average.npy").shape == (2, 2, 4, 5)


def test_router_order(spark, tmp_path):
    (tmp_path / "empty").mkdir()
    assert raw.read_movie(spark, str(tmp_path / "empty")) is None
    (tmp_path / "mixed").mkdir()
    (tmp_path / "mixed" / "a.tif").write_bytes(raw.tiff_bytes([np.ones((2, 2))] * 4))
    np.zeros((9, 1, 2, 2), np.uint16).tofile(tmp_path / "mixed" / "r_1_2_2_uint16.dat")
    assert raw.read_movie(spark, str(tmp_path / "mixed"), channels=1).count() == 4  # TIFF before raw .dat
    np.zeros((7, 1, 2, 2), np.uint16).tofile(tmp_path / "mixed" / "r_1_2_2_uint16.bin")
    assert raw.read_movie(spark, str(tmp_path / "mixed")).count() == 7  # raw .bin before all
    (tmp_path / "video").mkdir()
    (tmp_path / "video" / "a.mj2").write_bytes(b"\1\2\3")
    with pytest.raises(NotImplementedError):
        raw.read_movie(spark, str(tmp_path / "video"))
    got = raw.read_movie(spark, str(tmp_path / "video"), channels=1, decoder=lambda content: (np.full((2, 3), x) for x in content)).orderBy("frame_id").collect()
    assert [r["pixels"][0] for r in got] == [1.0, 2.0, 3.0]


def test_atlas_reference_and_volume(spark, tmp_path):
    import gzip

    from tessera.operators import atlas

    regions = spark.createDataFrame([(0, "VIS", 1, [0.0, 1.0], [0.0, 1.0]), (1, "MO", 2, [2.0], [3.0])], "region_id int, acronym string, label int, left_x array<double>, left_y array<double>")
    projection = spark.createDataFrame([(i, j, i * 3 + j) for i in range(2) for j in range(3)], "i int, j int, label int")
    outline = spark.createDataFrame([(0, 1.0, 2.0), (1, 3.0, 4.0)], "vertex int, x double, y double")
    atlas.save_reference(regions, projection, outline, str(tmp_path), "dorsal")
    r, p, o = atlas.load_reference(spark, str(tmp_path), "dorsal")
    assert [(x["region_id"], x["acronym"], x["left_x"]) for x in r.orderBy("region_id").collect()] == [(0, "VIS", [0.0, 1.0]), (1, "MO", [2.0])]
    assert {tuple(x) for x in p.collect()} == {(i, j, i * 3 + j) for i in range(2) for j in range(3)}
    assert {tuple(x) for x in o.collect()} == {(0, 1.0, 2.0), (1, 3.0, 4.0)}
    v = np.arange(24, dtype=np.uint16).reshape(2, 3, 4)
    np.save(tmp_path / "v.npy", v)
    (tmp_path / "v.nrrd").write_bytes(b"NRRD0004\n# made here\ntype: ushort\ndimension: 3\nsizes: 2 3 4\nendian: little\nencoding: gzip\n\n" + gzip.compress(v.tobytes(order="F")))
    for name in ("v.npy", "v.nrrd"):
        got = atlas.read_volume(spark, str(tmp_path / name)).collect()
        assert len(got) == 24 and all(v[x["i"], x["z"], x["j"]] == x["label"] for x in got)


def test_streams_of_projections_sessions_and_lines(spark, tmp_path):
    r = np.random.default_rng(4)
    u, f0 = r.standard_normal((3, 6)), 100 + r.random((2, 6))
    x = f0[np.arange(20) % 2] * (1 + 0.1 * r.standard_normal((20, 6)))
    schema = "frame_id long, channel int, pixels array<double>"
    for k in range(0, 20, 5):
        spark.createDataFrame([(t // 2, t % 2, x[t].tolist()) for t in range(k, k + 5)], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    q = movies.project_stream(movies.frame_files(spark, str(tmp_path / "in"), schema), u, f0, str(tmp_path / "out"), str(tmp_path / "check"))
    q.processAllAvailable()
    q.stop()
    got = spark.read.parquet(str(tmp_path / "out")).orderBy("frame_id", "channel").toPandas()
    base = f0[np.arange(20) % 2] + 1e-10
    assert np.allclose(np.stack(got["v"]), ((x - base) / base) @ u.T)
    spark.createDataFrame([(1, s) for s in (0, 10, 20, 100, 110, 400)] + [(2, 5)], "user_id int, s long").select("user_id", F.timestamp_seconds("s").alias("ts")).coalesce(1).write.parquet(str(tmp_path / "events"))
    q = movies.trial_sessions(movies.frame_files(spark, str(tmp_path / "events"), "user_id int, ts timestamp")).writeStream.format("memory").queryName("sessions").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    assert sorted((z["user_id"], z["n"]) for z in spark.sql("select * from sessions").collect()) == [(1, 2), (1, 3), (2, 1)]
    (tmp_path / "logs").mkdir()
    (tmp_path / "logs" / "a.log").write_text("one\ntwo\n")
    q = movies.log_lines(spark, str(tmp_path / "logs")).writeStream.format("memory").queryName("lines").outputMode("append").start()
    q.processAllAvailable()
    (tmp_path / "logs" / "b.log").write_text("three\n")
    q.processAllAvailable()
    q.stop()
    assert sorted(tuple(z) for z in spark.sql("select * from lines").collect()) == [("a.log", "one"), ("a.log", "two"), ("b.log", "three")]


def test_settings_over_defaults(tmp_path):
    from tessera.sources import config

    (tmp_path / "c.json").write_text('{"k": 5, "at": {"host": "b"}}')
    defaults = {"k": 1, "fs": 30, "at": {"host": "a", "port": 1}}
    assert config.read_config(str(tmp_path / "c.json"), defaults) == {"k": 5, "fs": 30, "at": {"host": "b", "port": 1}}
    assert config.read_config(str(tmp_path / "none.json"), defaults) == defaults


@pytest.mark.parametrize(("number", "pack"), [(1, bytes), (8, zlib.compress), (32773, lambda x: b"".join(bytes([0, b]) for b in x)), (32773, lambda x: bytes([128, len(x) - 1]) + x)])
@pytest.mark.parametrize("differences", [False, True])
def test_packed_tiff(number, pack, differences):
    page = np.arange(12, dtype="<u2").reshape(3, 4) ** 3
    stored = np.concatenate([page[:, :1], page[:, 1:] - page[:, :-1]], 1) if differences else page
    data = pack(stored.astype("<u2").tobytes())
    tags = [(256, 3, 1, 4), (257, 3, 1, 3), (258, 3, 1, 16), (259, 3, 1, number), (273, 4, 1, 8), (279, 4, 1, len(data)), (317, 3, 1, 2 if differences else 1)]
    ifd = struct.pack("<H", len(tags)) + b"".join(struct.pack("<HHII", *x) for x in tags) + struct.pack("<I", 0)
    got = list(raw.tiff_pages(b"II*\0" + struct.pack("<I", 8 + len(data)) + data + ifd))
    assert len(got) == 1 and np.array_equal(got[0], page)


def test_packed_repeats():
    assert raw.unpacked_bits(bytes([254, 7, 1, 1, 2])) == bytes([7, 7, 7, 1, 2])
