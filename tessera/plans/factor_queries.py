"""Queries of factors, filters and whole images. Where SQL expresses what follows from them, free of signs and order, it is given; the others' rows are
checked by tests against planted truth."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from tessera.operators import atlas, factor, locanmf, morphology, movie, registration, signals, stats
from tessera.operators import frames as fr
from tessera.operators.algebra import comoments
from tessera.plans.queries import MEAN_MAP, M, r, rounded
from tessera.plans.registry import query
from tessera.sources import adapters as ad
from tessera.sources.adapters import MOVIE, RANK, SIDE, SPATIAL, TEMPORAL


@query("butter_filtfilt")
def _(spark, d):
    t = stats.components_long(ad.temporal(spark, d).filter("channel = 0")).withColumnRenamed("frame_id", "f").select("component", F.col("f").alias("t"), "value")
    return rounded(signals.highpass(signals.lowpass(t, 7.5), 0.1), "value")


FRAME_DFF = f"{MOVIE}, f0 AS (SELECT channel, pixel_id, avg(value) AS f0 FROM movie GROUP BY ALL), dff AS (SELECT frame_id, channel, pixel_id, (value - (f0 + 1e-10)) / (f0 + 1e-10) AS value FROM movie JOIN f0 USING (channel, pixel_id))"


@query("approximate_svd", f"WITH {FRAME_DFF} SELECT frame_id, channel, {r('sum(value * value)')} AS energy FROM dff GROUP BY ALL")
def _(spark, d):
    """Sums of squares of each frame's components, free of the factors' signs: with as many components as pixels they are those of dF/F."""
    _, v = factor.approximate_svd(ad.frames(spark, d), SIDE * SIDE)
    return rounded(v.select("frame_id", "channel", F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x).alias("energy")), "energy")


@query("svd_components", f"WITH {SPATIAL} SELECT DISTINCT CAST(a.k AS INTEGER) AS i, CAST(b.k AS INTEGER) AS j, CASE WHEN a.k = b.k THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS value FROM spatial a, spatial b")
def _(spark, d):
    """Products of the spatial components over the pixels: they are orthogonal unit vectors."""
    u, _ = factor.approximate_svd(ad.frames(spark, d), SIDE * SIDE)
    c = comoments(u, "u", "u").products
    i, j = np.indices(c.shape)
    return rounded(spark.createDataFrame(pd.DataFrame({"i": i.ravel(), "j": j.ravel(), "value": c.ravel()}), "i int, j int, value double"), "value")


@query("svd_blockwise", f"WITH {FRAME_DFF} SELECT pixel_id, frame_id * 2 + channel AS t, {r('value')} AS value FROM dff")
def _(spark, d):
    """The movie rebuilt from blocks that keep all components."""
    f = ad.frames(spark, d)
    rel = ad.long_layout(factor.frame_dff(f, factor.baseline_frames(f)), SIDE).withColumn("t", F.col("frame_id") * 2 + F.col("channel"))
    u, v, _ = factor.blockwise_svd(rel, SIDE, SIDE, k=SIDE * SIDE, block_k=25, size=5, overlap=2)
    of = lambda rows, key, name: rows.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("component", "value"))), lambda s: s["value"]).alias(name))
    times = of(v, "t", "v").select("t", F.col("t").alias("frame_id"), F.lit(0).alias("channel"), "v")
    return rounded(stats.reconstruct(of(u, "pixel_id", "u"), times).select("pixel_id", "t", "value"), "value")


@query("hemodynamic_correction")
def _(spark, d):
    done = factor.hemodynamic_correction(ad.spatial(spark), ad.temporal(spark, d))
    return rounded(done.temporal, "value")


CENTRED = f"{SPATIAL}, {TEMPORAL}, c AS (SELECT channel, k, frame_id, v - avg(v) OVER (PARTITION BY channel, k) AS v FROM temporal), pairs AS (SELECT a.frame_id, a.k, a.v AS a, b.v AS b FROM c a JOIN c b USING (frame_id, k) WHERE a.channel = 0 AND b.channel = 1)"
CORRECTED = f"""{CENTRED}, x AS (SELECT frame_id, pixel_id, sum(u * a) AS a, sum(u * b) AS b FROM pairs JOIN spatial USING (k) GROUP BY ALL),
 r AS (SELECT pixel_id, sum(a * b) / (sum(b * b) + 1e-10) AS r FROM x GROUP BY 1), rest AS (SELECT frame_id, pixel_id, a - r * b AS v FROM x JOIN r USING (pixel_id)),
 n AS (SELECT k, sum(u * u) AS n FROM spatial GROUP BY 1), t AS (SELECT k AS component, frame_id AS t, sum(u * v) / max(n) AS v FROM rest JOIN spatial USING (pixel_id) JOIN n USING (k) GROUP BY ALL)"""


@query("hemodynamic_unfiltered", f"WITH {CORRECTED} SELECT component, t, {r('v - avg(v) OVER (PARTITION BY component)')} AS value FROM t")
def _(spark, d):
    """Without the filters. The SQL works on pixels, as the components span them all, and projects back on the orthogonal components."""
    return rounded(factor.hemodynamic_correction(ad.spatial(spark), ad.temporal(spark, d), filters=False).temporal, "value")


@query("motion_correct_2d")
def _(spark, d):
    return rounded(registration.motion_correct(ad.frames(spark, d), SIDE, SIDE).select("frame_id", "channel", "dy", "dx", "rot_deg"), "dy", "dx", digits=3)


@query("motion_correct_ecc")
def _(spark, d):
    return rounded(registration.motion_correct(ad.frames(spark, d), SIDE, SIDE, "ecc").select("frame_id", "channel", "dy", "dx", "rot_deg"), "dy", "dx", "rot_deg", digits=3)


def images(spark, d):
    return ad.frames(spark, d).select((F.col("frame_id") * 2 + F.col("channel")).alias("image_id"), "pixels")


#: A deviation of 1, cut at four, with pixels reflected at the edges.
SMOOTH = """k AS (SELECT k, exp(-0.5::DOUBLE * k * k) / sum(exp(-0.5::DOUBLE * k * k)) OVER () AS w FROM range(-4, 5) a(k)),
 near AS (SELECT CAST(o AS INTEGER) AS o, CAST(CASE WHEN o + k < 0 THEN -(o + k) - 1 WHEN o + k > 7 THEN 15 - (o + k) ELSE o + k END AS INTEGER) AS i, w FROM range(8) b(o), k),
 down AS (SELECT image_id, o AS y, x, sum(w * value) AS value FROM image JOIN near ON i = y GROUP BY ALL), smooth AS (SELECT image_id, y, o AS x, CAST(y * 8 + o AS INTEGER) AS pixel_id, sum(w * value) AS value FROM down JOIN near ON i = x GROUP BY ALL)"""
IMAGES = f"{MOVIE}, image AS (SELECT frame_id * 2 + channel AS image_id, y, x, pixel_id, value FROM movie)"


@query("gaussian_filter", f"WITH {IMAGES}, {SMOOTH} SELECT image_id, pixel_id, {r('value')} AS value FROM smooth")
def _(spark, d):
    return rounded(morphology.each_image(images(spark, d), lambda x: morphology.gaussian(x, 1.0), SIDE, SIDE).select("image_id", F.posexplode("pixels").alias("pixel_id", "value")), "value")


def one_image(spark, rows):
    """An image (pixel_id, value) as one row."""
    return rows.agg(F.transform(F.array_sort(F.collect_list(F.struct("pixel_id", "value"))), lambda x: x["value"]).alias("pixels")).select(F.lit(0).cast("long").alias("image_id"), "pixels")


@query("smoothed_peak", f"WITH {MOVIE}, {MEAN_MAP}, image AS (SELECT 0 AS image_id, pixel_id // 8 AS y, pixel_id % 8 AS x, f0 AS value FROM f0 WHERE channel = 0), {SMOOTH} SELECT pixel_id, {r('value')} AS value FROM smooth ORDER BY value DESC, pixel_id LIMIT 1")
def _(spark, d):
    m = fr.mean_map(ad.movie(spark, d).filter("channel = 0")).select("pixel_id", F.col("f0").alias("value"))
    smooth = morphology.each_image(one_image(spark, m), lambda x: morphology.gaussian(x, 1.0), SIDE, SIDE)
    return rounded(stats.peak_pixel(smooth.select(F.posexplode("pixels").alias("pixel_id", "value"))), "value")


@query("std_mask")
def _(spark, d):
    """Of the deviations over all frames."""
    s = stats.std_projection(ad.movie(spark, d).filter("channel = 0"), None)
    return morphology.each_image(one_image(spark, s), lambda x: morphology.std_mask(x, 1.0, 40.0, 2), SIDE, SIDE).select(F.posexplode("pixels").alias("pixel_id", "keep"))


@query("connected_regions", f"""WITH RECURSIVE {IMAGES}, cut AS (SELECT image_id, median(value) AS m FROM image GROUP BY 1), on_ AS (SELECT image_id, y, x, pixel_id FROM image JOIN cut USING (image_id) WHERE value > m),
 links AS (SELECT a.image_id, a.pixel_id AS p, b.pixel_id AS q FROM on_ a JOIN on_ b ON a.image_id = b.image_id AND abs(a.y - b.y) + abs(a.x - b.x) = 1),
 reach AS (SELECT image_id, pixel_id AS p, pixel_id AS q FROM on_ UNION SELECT reach.image_id, reach.p, links.q FROM reach JOIN links ON reach.image_id = links.image_id AND reach.q = links.p),
 root AS (SELECT image_id, p AS pixel_id, min(q) AS root FROM reach GROUP BY ALL), named AS (SELECT image_id, pixel_id, dense_rank() OVER (PARTITION BY image_id ORDER BY root) AS label FROM root)
 SELECT image_id, pixel_id, CAST(coalesce(label, 0) AS DOUBLE) AS label FROM image LEFT JOIN named USING (image_id, pixel_id)""")
def _(spark, d):
    return morphology.each_image(images(spark, d), lambda x: morphology.label_regions(x > np.median(x)), SIDE, SIDE).select("image_id", F.posexplode("pixels").alias("pixel_id", "label"))


@query("adaptive_histogram")
def _(spark, d):
    return rounded(morphology.each_image(images(spark, d), lambda x: morphology.adapt_histogram(x, 2), SIDE, SIDE).select("image_id", F.posexplode("pixels").alias("pixel_id", "value")), "value")


@query("contour_mask")
def _(spark, d):
    """A contour for each region of the table, a square whose place follows from its key, each filled in a group of its own."""
    at = ad.table(spark, d, "region").select(F.col("r_regionkey").cast("int").alias("region_id"), F.lit("left").alias("side"), F.posexplode(F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in ((30.0, 20.0), (90.0, 20.0), (90.0, 80.0), (30.0, 80.0), (30.0, 20.0))])).alias("vertex", "p"))
    return atlas.region_masks(at.select("region_id", "side", "vertex", (F.col("p.x") + F.col("region_id") * 3).alias("x"), F.col("p.y").alias("y")), 100, 120).select("region_id", "pixel_id")


def quarters(spark):
    return ad.spatial(spark).select("pixel_id", F.expr("1 + (y div 4) * 2 + x div 4").cast("int").alias("area_id"))


@query("locanmf")
def _(spark, d):
    _, c, regions = locanmf.locanmf(ad.spatial(spark), ad.temporal(spark, d), quarters(spark), RANK, max_rank=2, min_pixels=4, steps=10)
    return rounded(c.join(F.broadcast(regions), "component").select("component", "area_id", "t", "value"), "value", digits=4)  # a row a component


@query("area_correlations")
def _(spark, d):
    return rounded(movie.area_correlations(ad.spatial(spark), ad.temporal(spark, d), quarters(spark), keep=2), "r")


@query("preprocess")
def _(spark, d):
    """With all its steps: registration, factors, correction."""
    _, done = movie.preprocess(ad.frames(spark, d), SIDE, SIDE, k=8)
    return rounded(done.coefficients, "r", digits=4)


@query("warped_components", f"""WITH {SPATIAL}, i AS (SELECT k, y, x, CASE WHEN y IN (0, 7) OR x IN (0, 7) THEN 1e-10 ELSE u END AS u FROM spatial),
 o AS (SELECT CAST(p AS INTEGER) AS pixel_id, 0.9::DOUBLE * (p % 8) - 0.2::DOUBLE * (p // 8) + 1.5 AS sx, 0.2::DOUBLE * (p % 8) + 0.9::DOUBLE * (p // 8) - 0.75 AS sy FROM range(64) a(p)),
 w AS (SELECT k, pixel_id, sum(u * (1 - abs(sx - x)) * (1 - abs(sy - y))) AS value FROM i, o WHERE abs(sx - x) < 1 AND abs(sy - y) < 1 GROUP BY ALL), every_ AS (SELECT pixel_id, CAST(k AS INTEGER) AS k FROM o, range({RANK}) b(k))
 SELECT pixel_id, k AS component, {r('coalesce(value, 0)')} AS value FROM every_ LEFT JOIN w USING (k, pixel_id)""")
def _(spark, d):
    m = movie.FactoredMovie(ad.spatial(spark), ad.temporal(spark, d), RANK, SIDE, SIDE).warped(M)
    return rounded(m.spatial.select("pixel_id", F.posexplode("u").alias("component", "value")), "value")
