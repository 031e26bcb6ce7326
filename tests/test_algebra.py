"""Products of arrays at the rank and length that are in use, and what is built on them, against NumPy."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tessera.operators import factor, frames, morphology, registration, signals, stats
from tessera.operators.algebra import comoments

RANK, FRAMES = 200, 100_000


@pytest.fixture(scope="module")
def long_factor(spark, tmp_path_factory):
    """A temporal factor of rank 200 over 100,000 frames, in a file."""
    r = np.random.default_rng(20)
    v = (r.standard_normal((FRAMES, RANK), np.float32) + 5).astype(np.float64)
    path = str(tmp_path_factory.mktemp("factor") / "v.parquet")
    pd.DataFrame({"t": np.arange(FRAMES), "frame_id": np.arange(FRAMES) // 2, "channel": (np.arange(FRAMES) % 2).astype(np.int32), "v": list(v)}).to_parquet(path, row_group_size=10_000)
    return v, spark.read.parquet(path)


def test_comoments_of_a_long_factor(spark, long_factor):
    v, rows = long_factor
    got = comoments(rows, "v", "v")
    assert got.n == FRAMES and np.allclose(got.mean_a, v.mean(0)) and np.allclose(got.covariance(), np.cov(v.T), atol=1e-8) and np.allclose(got.products, v.T @ v)
    none = comoments(rows.limit(0), "v", "v")
    assert none.n == 0 and none.c.shape == (0, 0)
    one = comoments(rows.limit(1), "v", "v")
    assert np.isnan(one.covariance()).all()


def test_statistics_of_a_long_factor(spark, long_factor):
    v, rows = long_factor
    u = np.random.default_rng(21).standard_normal((40, RANK))
    spatial = spark.createDataFrame([(p, 0, p, u[p].tolist()) for p in range(40)], "pixel_id int, y int, x int, u array<double>")
    c = np.cov(v.T)
    got = stats.pixel_stats(spatial, rows).orderBy("pixel_id").toPandas()
    assert np.allclose(got["mean"], u @ v.mean(0)) and np.allclose(got["var"], np.einsum("pi,ij,pj->p", u, c * (FRAMES - 1) / FRAMES, u))
    a, b = v[0::2], v[1::2]
    r = stats.regression_coefficients(spatial, rows.filter("channel = 0"), rows.filter("channel = 1")).orderBy("pixel_id").toPandas()["r"]
    assert np.allclose(r, np.einsum("pi,ij,pj->p", u, a.T @ b, u) / np.einsum("pi,ij,pj->p", u, b.T @ b, u))
    seed = stats.seed_correlation(spatial, rows, 3).orderBy("pixel_id").toPandas()["r"]
    cov, sd = u @ c @ u[3], np.sqrt(np.einsum("pi,ij,pj->p", u, c, u))
    assert np.isnan(seed[3]) and np.allclose(seed.drop(3), np.delete(cov / (sd * sd[3] + 0.001), 3))
    assert stats.seed_correlation(spatial, rows, 99).count() == 0
    t = factor.correction_matrix(spatial, spark.createDataFrame([(p, float("nan") if p == 0 else 0.1 * p) for p in range(40)], "pixel_id int, r double"))
    w = np.array([1e-10, *(0.1 * np.arange(1, 40))])
    assert np.allclose(u @ t, u @ np.linalg.pinv(u.T @ u) @ (u.T * w) @ u, atol=1e-6)


def test_reconstruct_in_blocks(spark):
    r = np.random.default_rng(22)
    u, v = r.standard_normal((30, 5)), r.standard_normal((70, 5))
    sp = spark.createDataFrame([(p, u[p].tolist()) for p in range(30)], "pixel_id int, u array<double>")
    te = spark.createDataFrame([(t, t, 0, v[t].tolist()) for t in range(70)], "t long, frame_id long, channel int, v array<double>")
    got = stats.reconstruct(sp, te, side=16).toPandas()
    assert len(got) == 2100 and np.allclose(got.sort_values(["t", "pixel_id"])["value"], (v @ u.T).ravel())
    assert stats.reconstruct(sp.limit(0), te).count() == 0


def test_gram_in_blocks(spark):
    r = np.random.default_rng(23)
    x = r.standard_normal((2, 9, 12))  # channel, bin, pixel
    rows = spark.createDataFrame([(c, b, p, float(x[c, b, p])) for c in range(2) for b in range(9) for p in range(12)], "channel int, bin long, pixel_id int, value double")
    got = stats.gram(rows, held=40).toPandas()
    want = np.einsum("cip,cjp->ij", x, x) / 24
    assert len(got) == 45 and np.allclose(got["value"], want[got["i"], got["j"]])
    assert stats.gram(rows.limit(0)).count() == 0


@pytest.mark.parametrize("held", [16_000_000, 500])
def test_svd_in_blocks_of_pixels(spark, monkeypatch, held):
    monkeypatch.setattr(factor, "HELD", held)
    r = np.random.default_rng(24)
    x = 1000 + r.standard_normal((60, 2, 50)) * 10
    rows = spark.createDataFrame([(t, c, x[t, c].tolist()) for t in range(60) for c in range(2)], "frame_id long, channel int, pixels array<double>")
    mask = np.arange(50) != 7
    u, v = factor.approximate_svd(rows, 50, per_bin=1, mask=mask)
    rel = (x - x.mean(0)) / x.mean(0)
    U = np.stack(u.orderBy("pixel_id").toPandas()["u"])
    V = np.stack(v.orderBy("t").toPandas()["v"])
    assert U.shape[0] == 50 and np.allclose(U[7], 0) and np.allclose((V @ U.T).reshape(60, 2, 50)[:, :, mask], rel[:, :, mask], atol=1e-8)
    pieces = factor.projected(factor.frame_dff(rows, factor.baseline_frames(rows)), u, 50, U.shape[1], sent=0)
    again = np.stack(pieces.orderBy("frame_id", "channel").toPandas()["v"])
    assert np.allclose(again, V)


def test_svd_edges_of_the_published_algorithm(spark):
    r = np.random.default_rng(25)
    x = 100 + r.standard_normal((40, 1, 6))
    rows = spark.createDataFrame([(t, 0, x[t, 0].tolist()) for t in range(40)], "frame_id long, channel int, pixels array<double>")
    trials = spark.createDataFrame([(0, 4), (1, 20)], "trial_id int, onset_frame long")
    v = {z["frame_id"]: z["v"] for z in factor.approximate_svd(rows, 4, per_bin=5, compat=True, trials=trials)[1].collect()}
    assert all(abs(sum(map(abs, v[t]))) == 0 for t in (0, 1, 2, 3, 39)) and all(sum(map(abs, v[t])) > 0 for t in (4, 38))
    plain = {z["frame_id"]: z["v"] for z in factor.approximate_svd(rows, 4, per_bin=5)[1].collect()}
    assert all(sum(map(abs, plain[t])) > 0 for t in range(40))


def test_recursion_by_single_steps():
    r = np.random.default_rng(26)
    for high in (False, True):
        b, a = signals.butter2(3.0, 30.0, high)
        x = r.standard_normal((3, 1000))
        zi = np.linalg.solve(np.array([[1 + a[1], -1.0], [a[2], 1.0]]), np.array([b[1] - a[1] * b[0], b[2] - a[2] * b[0]]))
        want = np.zeros_like(x)
        for s in range(3):
            z = zi * x[s, 0]
            for k in range(1000):
                want[s, k] = b[0] * x[s, k] + z[0]
                z = np.array([b[1] * x[s, k] - a[1] * want[s, k] + z[1], b[2] * x[s, k] - a[2] * want[s, k]])
        assert np.allclose(signals.recursion(b, a, x), want, atol=1e-12) and np.allclose(signals.recursion(b, a, x[0], block=7), want[0], atol=1e-12)


def test_regions_by_flooding():
    r = np.random.default_rng(27)
    for shape in ((1, 1), (7, 9), (20, 13), (1, 30), (30, 1)):
        for share in (0.3, 0.6, 1.0, 0.0):
            m = r.random(shape) < share
            want, n = np.zeros(shape, int), 0
            for i in range(shape[0]):
                for j in range(shape[1]):
                    if m[i, j] and not want[i, j]:
                        n += 1
                        todo = [(i, j)]
                        while todo:
                            y, x = todo.pop()
                            if 0 <= y < shape[0] and 0 <= x < shape[1] and m[y, x] and not want[y, x]:
                                want[y, x] = n
                                todo += [(y + 1, x), (y - 1, x), (y, x + 1), (y, x - 1)]
            assert np.array_equal(morphology.label_regions(m), want)


@pytest.mark.parametrize("model", ["affine", "homography"])
def test_ecc_finds_a_planted_transform(spark, model):
    r = np.random.default_rng(28)
    im = morphology.gaussian(r.standard_normal((48, 48)), 3.0) * 1000 + 1000
    m = np.array([[1.02, 0.02, 0.6], [-0.015, 0.99, -0.8], [0.0003 if model == "homography" else 0.0, 0.0, 1.0]])
    template = registration.warp_image(im, m)
    found = registration.ecc_matrix(template, im, model)
    inner = np.s_[8:-8, 8:-8]
    assert np.abs(registration.warp_image(im, found)[inner] - template[inner]).mean() < 0.1 * np.abs(im[inner] - template[inner]).mean()
    frames = spark.createDataFrame([(t, 0, im.ravel().tolist()) for t in range(2)], "frame_id long, channel int, pixels array<double>")
    out = registration.register_frames(frames, {0: template}, 48, 48, model).first()
    assert abs(out["rot_deg"] - np.degrees(np.arctan2(m[1, 0], m[0, 0]))) < 0.5
    with pytest.raises(ValueError):
        registration.register_frames(frames, {0: template}, 48, 48, "none")


def test_as_of_beside_columns_of_like_names(spark):
    rows = spark.createDataFrame([(1, "a", "b"), (5, "c", "d")], "at long, _m string, __row string")
    marks = spark.createDataFrame([(0, 10), (5, 11)], "mark_at long, _b int")
    got = frames.as_of(rows, marks, "at", "mark_at", ["_b"]).orderBy("at").collect()
    assert [tuple(r) for r in got] == [(1, "a", "b", 10), (5, "c", "d", 11)]
    assert frames.as_of(rows, marks, "at", "mark_at", ["_b"], strict=True).filter(F.col("_b") == 10).count() == 2


def test_noise_is_rough(spark):
    rows = factor.noise_roughness(spark, 6, 7, 40, blocks=20, components=2)
    got = rows.orderBy("block", "component").toPandas()
    e = np.random.default_rng([0, 3]).standard_normal((42, 40))
    u, _, v = np.linalg.svd(e, full_matrices=False)
    long = spark.createDataFrame([(0, y, x, float(u[y * 7 + x, 0])) for y in range(6) for x in range(7)], "component int, y int, x int, value double")
    series = spark.createDataFrame([(0, t, float(v[0, t])) for t in range(40)], "component int, t int, value double")
    one = got[(got["block"] == 3) & (got["component"] == 0)].iloc[0]
    assert len(got) == 40 and abs(one["spatial"] - stats.spatial_roughness(long).first()["value"]) < 1e-9 and abs(one["temporal"] - stats.temporal_roughness(series).first()["value"]) < 1e-9
    limit = factor.noise_thresholds(rows, 0.9).first()
    assert (got["spatial"] > limit["spatial"]).mean() >= 0.85 and limit["temporal"] > 0
