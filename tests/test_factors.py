"""Operators that SQL does not express, against planted truth."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tessera.operators import events, factor, locanmf, morphology, movie, registration, signals, stats

H, W, T = 8, 8, 200


def low_rank(rng, channels=2):
    u, v = rng.standard_normal((H * W, 3)), rng.standard_normal((3, T * channels))
    return 1000 * (1 + 0.02 * (u @ v).T)  # (t, pixel)


def as_frames(spark, x, channels=2):
    rows = [(t // channels, t % channels, r.tolist()) for t, r in enumerate(x)]
    return spark.createDataFrame(rows, "frame_id long, channel int, pixels array<double>")


def test_svd_rebuilds_a_low_rank_movie(spark):
    x = low_rank(np.random.default_rng(0))
    f = as_frames(spark, x)
    u, v = factor.approximate_svd(f, 6, per_bin=5)
    U = np.stack([r["u"] for r in u.orderBy("pixel_id").collect()])
    V = np.stack([r["v"] for r in v.orderBy("t").collect()])
    base = np.stack([x[0::2].mean(0), x[1::2].mean(0)])
    rel = (x - base[np.arange(len(x)) % 2]) / base[np.arange(len(x)) % 2]
    assert np.abs(V @ U.T - rel).max() < 1e-6
    norms = np.sqrt((U * U).sum(0))
    assert np.allclose(norms[:3], 1)


def fading(rng, t=120, channels=2, px=60):
    """A movie (t x channels, pixel) whose components fade, each to four fifths of the one before."""
    u, v = np.linalg.qr(rng.standard_normal((px, px)))[0], np.linalg.qr(rng.standard_normal((t * channels, px)))[0]
    return 1000 + 100 * (v * 0.8 ** np.arange(px)) @ u.T


def test_no_matrix_of_all_bins_reaches_the_driver(spark, monkeypatch):
    seen = []
    inner = np.linalg.eigh
    monkeypatch.setattr(np.linalg, "eigh", lambda c: seen.append(len(c)) or inner(c))
    rows = as_frames(spark, fading(np.random.default_rng(7)))
    u, _ = factor.approximate_svd(rows, 60, per_bin=1)  # 240 bins of 60 pixels
    U = np.stack([r["u"] for r in u.orderBy("pixel_id").collect()])
    assert max(seen) <= 60 and np.allclose(U.T @ U, np.eye(60), atol=1e-9)


@pytest.mark.parametrize("held", [16_000_000, 500])
@pytest.mark.parametrize(("per_bin", "whole"), [(1, 50), (10, 2048), (10, 20)])
def test_svd_by_bins(spark, monkeypatch, held, per_bin, whole):
    """240 bins with more pixels than a matrix holds; 24 bins of 60 pixels, as a matrix and without it."""
    x = fading(np.random.default_rng(8))
    monkeypatch.setattr(factor, "HELD", held)
    monkeypatch.setattr(factor, "WHOLE", whole)
    u, v = factor.approximate_svd(as_frames(spark, x), 5, per_bin=per_bin)
    got = np.stack([r["u"] for r in u.orderBy("pixel_id").collect()])
    cube = x.reshape(120, 2, 60)
    bins = (cube / cube.mean(0) - 1).reshape(-1, per_bin, 2, 60).mean(1).reshape(-1, 60)
    want = np.linalg.svd(bins)[2][:5].T
    assert np.abs(np.abs((got * want).sum(0)) - 1).max() < 1e-9 and np.allclose((got * got).sum(0), 1) and v.count() == 240


def test_leading_vectors_with_restarts():
    rng = np.random.default_rng(9)
    q = np.linalg.qr(rng.standard_normal((600, 600)))[0]
    size = np.concatenate([[50, 49.9, 20], np.linspace(2, 0, 597)])  # no gap in the rest
    c = (q * size) @ q.T
    done = []
    got, vectors = factor.leading_vectors(lambda x: done.append(x.shape[1]) or c @ x, 600, 8)
    assert np.allclose(got, size[:8], rtol=1e-9) and np.abs(c @ vectors - vectors * got).max() < 1e-6 and max(done) <= 28
    assert len(done) > 4  # restarted
    zero = factor.leading_vectors(lambda x: 0 * x, 30, 3)
    assert zero[0].tolist() == [0, 0, 0]
    every = factor.leading_vectors(lambda x: c[:40, :40] @ x, 40, 40)
    assert np.allclose(every[0], np.linalg.eigvalsh(c[:40, :40])[::-1])


def test_blockwise_svd_rebuilds(spark):
    rng = np.random.default_rng(1)
    x = rng.standard_normal((40, 3)) @ rng.standard_normal((3, H * W))
    long = [(t, p, p // W, p % W, float(x[t, p])) for t in range(40) for p in range(H * W)]
    df = spark.createDataFrame(long, "t long, pixel_id int, y int, x int, value double")
    u, v, s = factor.blockwise_svd(df, H, W, k=10, block_k=5, size=5, overlap=2)
    built = u.join(v.withColumnRenamed("value", "s"), "component").groupBy("pixel_id", "t").agg(F.sum(F.col("value") * F.col("s")).alias("b")).toPandas()
    got = np.zeros_like(x)
    got[built["t"], built["pixel_id"]] = built["b"]
    assert np.abs(got - x).max() < 1e-6
    assert (np.diff(s) <= 1e-9).all()


def test_filters():
    fs = 30
    t = np.arange(900) / fs
    slow, fast = np.sin(2 * np.pi * 0.5 * t), np.sin(2 * np.pi * 13 * t)
    assert np.abs(signals.filtfilt(slow + fast, 5, fs, False)[100:-100] - slow[100:-100]).max() < 0.02
    assert np.abs(signals.filtfilt(slow + fast, 5, fs, True)[100:-100] - fast[100:-100]).max() < 0.03
    at = signals.filtfilt(np.sin(2 * np.pi * 5 * t), 5, fs, False)[200:-200]
    assert abs(at.std() * 2**0.5 - 0.5) < 0.02  # half at the cutoff after both directions
    with pytest.raises(ValueError):
        signals.filtfilt(np.zeros(50), 5, fs, False)


def test_hemodynamic_correction_recovers_the_coefficient(spark):
    rng = np.random.default_rng(2)
    u, ref, sig = rng.standard_normal((30, 3)), rng.standard_normal((3, 400)), rng.standard_normal((3, 400)) * 0.2
    rows = [(2 * f + c, f, c, (sig[:, f] + 0.7 * ref[:, f] if c == 0 else ref[:, f]).tolist()) for f in range(400) for c in (0, 1)]
    temporal = spark.createDataFrame(rows, "t long, frame_id long, channel int, v array<double>")
    spatial = spark.createDataFrame([(p, 0, p, u[p].tolist()) for p in range(30)], "pixel_id int, y int, x int, u array<double>")
    done = factor.hemodynamic_correction(spatial, temporal, filters=False)
    r = np.array([x["r"] for x in done.coefficients.orderBy("pixel_id").collect()])
    assert abs(np.median(r) - 0.7) < 0.05
    got = done.temporal.toPandas().pivot(index="component", columns="t", values="value").to_numpy()
    want = sig - sig.mean(1, keepdims=True)
    assert np.corrcoef(got.ravel(), want.ravel())[0, 1] > 0.9


def test_registration_finds_planted_shifts(spark):
    rng = np.random.default_rng(3)
    big = morphology.gaussian(rng.standard_normal((64, 64)), 2.0) * 1000 + 1000
    template = big[16:48, 16:48]
    for dy, dx in ((0, 0), (2, -3), (-4, 1)):
        im = big[16 - dy : 48 - dy, 16 - dx : 48 - dx]
        got = registration.phase_shift(template, im)
        assert abs(got[0] - dy) < 0.6 and abs(got[1] - dx) < 0.6
        fixed = registration.shift_image(im, *got)
        assert np.abs(fixed[8:-8, 8:-8] - template[8:-8, 8:-8]).mean() < np.abs(im[8:-8, 8:-8] - template[8:-8, 8:-8]).mean() + 1e-9 or (dy, dx) == (0, 0)
    turned = registration.shift_image(template, 0.5, -0.5, 2.0)
    _, _, rot = registration.ecc(template, turned)
    assert abs(rot + 2.0) < 0.5
    frames = spark.createDataFrame([(t, 0, template.ravel().tolist()) for t in range(4)], "frame_id long, channel int, pixels array<double>")
    out = registration.motion_correct(frames, 32, 32, n_reference=2)
    assert out.agg(F.max(F.abs("dy"))).first()[0] < 0.2


def test_frames_are_registered_together_as_one_by_one():
    rng = np.random.default_rng(10)
    template, stack = rng.standard_normal((9, 12)) + 5, rng.standard_normal((40, 9, 12)) + 5
    dy, dx = registration.phase_shifts(template, stack)
    moved = registration.shift_images(stack, dy, dx)
    for k, im in enumerate(stack):
        assert registration.phase_shift(template, im) == (dy[k], dx[k])
        assert np.allclose(moved[k], registration.shift_image(im, dy[k], dx[k]), atol=1e-12)


def test_channels_have_templates_of_their_own_frames(spark):
    """Frame numbers with gaps, and a channel that begins late."""
    rng = np.random.default_rng(11)
    im = morphology.gaussian(rng.standard_normal((16, 16)), 1.5) * 300 + 1000
    rows = [(7 * t, 0, im.ravel().tolist()) for t in range(5)] + [(500 + 3 * t, 1, im.ravel().tolist()) for t in range(9)]
    out = registration.motion_correct(spark.createDataFrame(rows, "frame_id long, channel int, pixels array<double>"), 16, 16, n_reference=3).collect()
    assert len(out) == 14 and max(abs(r["dy"]) + abs(r["dx"]) for r in out) < 0.3


def test_query_preprocess_registers(spark, tmp_path):
    """A movie whose frames are moved: the query's coefficients are those of the registered movie."""
    from __spark_entry__ import queries
    from tessera.sources import adapters as ad

    rng = np.random.default_rng(12)
    im = morphology.gaussian(rng.standard_normal((8, 8)), 1.0) * 3
    x = np.stack([np.roll(im, (k // 2) % 3, 0) * (1 + 0.1 * rng.standard_normal()) for k in range(400)])
    pd.DataFrame({"vec_id": range(400), "embedding": list(x.reshape(400, 64).astype(np.float32))}).to_parquet(tmp_path / "embeddings.parquet")
    got = {r["pixel_id"]: r["r"] for r in queries()["preprocess"](spark, str(tmp_path)).collect()}
    frames = registration.motion_correct(ad.frames(spark, str(tmp_path)), 8, 8).select("frame_id", "channel", "pixels")
    want = {r["pixel_id"]: r["r"] for r in movie.preprocess(frames, 8, 8, k=8, mode=None)[1].coefficients.collect()}
    assert len(got) == 64 and max(abs(got[p] - want[p]) for p in want) < 1e-3


def test_morphology():
    m = np.zeros((9, 9), bool)
    m[2:7, 2:7] = True
    m[4, 4] = False
    assert morphology.fill_holes(m)[4, 4] and not morphology.fill_holes(m)[0, 0]
    two = np.zeros((6, 6), bool)
    two[0, :3], two[4:, 4:] = True, True
    labels = morphology.label_regions(two)
    assert labels.max() == 2 and labels[0, 0] == 1 and labels[5, 5] == 2
    assert morphology.drop_small(two, 4).sum() == 4
    flat = np.full((10, 10), 3.0)
    assert np.allclose(morphology.gaussian(flat, 2.0), 3.0)
    square = morphology.contour_mask(np.array([2.0, 2, 7, 7, 2]), np.array([2.0, 7, 7, 2, 2]), 10, 10)
    assert square[4, 4] and not square[0].any()


def test_chunks_and_blocks(spark):
    assert events.chunk_ranges(spark, 15).count() == 0
    last = events.chunk_ranges(spark, 520).collect()
    assert [(r["first"], r["last"]) for r in last] == [(0, 520)]
    cover = events.blocks_of_pixels(spark.range(90).select(F.col("id").cast("int").alias("pixel_id"), F.expr("int(id div 10)").alias("y"), (F.col("id") % 10).cast("int").alias("x")), 9, 10, 4, 1)
    assert cover.select("pixel_id").distinct().count() == 90


def test_factored_movie_matches_the_full_one(spark):
    rng = np.random.default_rng(4)
    u, v = rng.standard_normal((H * W, 3)), rng.standard_normal((50, 3))
    sp = spark.createDataFrame([(p, p // W, p % W, u[p].tolist()) for p in range(H * W)], "pixel_id int, y int, x int, u array<double>")
    te = spark.createDataFrame([(t, t, 0, v[t].tolist()) for t in range(50)], "t long, frame_id long, channel int, v array<double>")
    m = movie.FactoredMovie(sp, te, 3, H, W)
    full = u @ v.T
    got = m.pixel_stats().orderBy("pixel_id").toPandas()
    assert np.allclose(got["mean"], full.mean(1)) and np.allclose(got["var"], full.var(1))
    c = m.correlation(1, 2).toPandas().set_index("pixel_id")["r"]
    assert c.isna().sum() == 1 and m.correlation(9, 0) is None
    top = m.apply(lambda x: x.max(1)).orderBy("pixel_id").toPandas()["value"]
    assert np.allclose(top, full.max(1))


def test_locanmf_keeps_components_at_home(spark):
    rng = np.random.default_rng(5)
    u = np.zeros((H * W, 2))
    area = np.where(np.arange(H * W) % W < 4, 1, 2)
    u[area == 1, 0], u[area == 2, 1] = 1 + rng.random((area == 1).sum()), 1 + rng.random((area == 2).sum())
    v = rng.standard_normal((60, 2))
    sp = spark.createDataFrame([(p, p // W, p % W, u[p].tolist()) for p in range(H * W)], "pixel_id int, y int, x int, u array<double>")
    te = spark.createDataFrame([(t, t, 0, v[t].tolist()) for t in range(60)], "t long, frame_id long, channel int, v array<double>")
    at = spark.createDataFrame(pd.DataFrame({"pixel_id": range(H * W), "area_id": area}), "pixel_id int, area_id int")
    a, c, regions = locanmf.locanmf(sp, te, at, 2, min_pixels=4, max_rank=2)
    A = np.stack([r["a"] for r in a.orderBy("pixel_id").collect()])
    home = [r["area_id"] for r in regions.orderBy("component").collect()]
    for k, h in enumerate(home):
        assert (A[area == h, k] ** 2).sum() >= 0.7 * (A[:, k] ** 2).sum()
    C = c.toPandas().pivot(index="component", columns="t", values="value").to_numpy()
    assert np.abs(A @ C - u @ v.T).max() < 0.1


def test_roi_timecourse_is_linear(spark):
    sp = spark.createDataFrame([(0, 0, 0, [1.0, 0.0]), (1, 0, 1, [3.0, 2.0])], "pixel_id int, y int, x int, u array<double>")
    te = spark.createDataFrame([(0, 0, 0, [1.0, 1.0])], "t long, frame_id long, channel int, v array<double>")
    assert stats.roi_timecourse(sp, te, spark.createDataFrame([(0,), (1,)], "pixel_id int")).first()["value"] == 3.0
