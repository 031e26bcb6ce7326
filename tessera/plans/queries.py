"""The engine's operators on the driver's tables, each with the SQL of the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.operators import events as ev
from tessera.operators import frames as fr
from tessera.operators import geometry as geo
from tessera.operators import stats as st
from tessera.plans.registry import query
from tessera.sources import adapters as ad
from tessera.sources.adapters import MOVIE, RECONSTRUCTED, SERIES, SIDE, SPATIAL, TEMPORAL, TRIALS


def rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    """Sums of floats taken in another order agree after rounding; adding zero turns a negative zero positive."""
    return df.withColumns({c: F.round(F.col(c).cast("double"), digits) + F.lit(0.0) for c in columns})


def r(sql: str, digits: int = 6) -> str:
    return f"(round(({sql})::DOUBLE, {digits}) + 0.0)"


def one_channel(spark: SparkSession, d: str, channel: int = 0) -> DataFrame:
    return ad.movie(spark, d).filter(F.col("channel") == channel)


MEAN_MAP = "f0 AS (SELECT channel, pixel_id, avg(m) AS f0 FROM (SELECT frame_id // 64 AS c, channel, pixel_id, avg(value) AS m FROM movie GROUP BY ALL) GROUP BY ALL)"
DFF = f"{MOVIE}, {MEAN_MAP}, dff AS (SELECT frame_id, channel, pixel_id, y, x, (value - (f0 + 1e-10)) / (f0 + 1e-10) AS value FROM movie JOIN f0 USING (channel, pixel_id))"
BINNED = f"{DFF}, nb AS (SELECT least(5000, (max(frame_id) + 1) // 15) AS n FROM movie), binned AS (SELECT frame_id // 15 AS bin, channel, pixel_id, avg(value) AS value FROM dff, nb WHERE frame_id < n * 15 GROUP BY ALL)"
ROI = "pixel_id IN (SELECT p FROM range(64) a(p) WHERE p // 8 BETWEEN 2 AND 4 AND p % 8 BETWEEN 3 AND 5)"


def roi(spark: SparkSession) -> DataFrame:
    return spark.range(64).select(F.col("id").cast("int").alias("pixel_id")).filter("pixel_id div 8 between 2 and 4 and pixel_id % 8 between 3 and 5")


def binned(spark: SparkSession, d: str) -> DataFrame:
    m = ad.movie(spark, d)
    return fr.bin_time(fr.dff(m, fr.mean_map(m)))


@query("roi_timecourse", f"WITH {BINNED} SELECT bin, channel, {r('avg(value)')} AS value FROM binned WHERE {ROI} GROUP BY ALL")
def _(spark, d):
    """Movie, baseline, dF/F, time bins, mean over a region: the flagship."""
    return rounded(binned(spark, d).join(roi(spark), "pixel_id", "left_semi").groupBy("bin", "channel").agg(F.avg("value").alias("value")), "value")


@query("frame_mean_map", f"WITH {MOVIE}, {MEAN_MAP} SELECT channel, pixel_id, {r('f0')} AS f0 FROM f0")
def _(spark, d):
    return rounded(fr.mean_map(ad.movie(spark, d)), "f0")


@query("trial_baseline", f"WITH {MOVIE}, {TRIALS} SELECT trial_id, channel, pixel_id, {r('avg(value)')} AS f0 FROM movie JOIN trials ON frame_id BETWEEN onset_frame AND onset_frame + 4 GROUP BY ALL")
def _(spark, d):
    return rounded(ev.trial_baseline(ad.movie(spark, d), ad.trials(spark, d), 5), "f0")


@query("dff", f"WITH {DFF} SELECT frame_id, channel, pixel_id, {r('value')} AS value FROM dff")
def _(spark, d):
    m = ad.movie(spark, d)
    return rounded(fr.dff(m, fr.mean_map(m)).select("frame_id", "channel", "pixel_id", "value"), "value")


@query("dff_difference", f"WITH {MOVIE}, {MEAN_MAP} SELECT frame_id, channel, pixel_id, {r('value - (f0 + 1e-10)')} AS value FROM movie JOIN f0 USING (channel, pixel_id)")
def _(spark, d):
    m = ad.movie(spark, d)
    return rounded(fr.dff(m, fr.mean_map(m), divide=False).select("frame_id", "channel", "pixel_id", "value"), "value")


@query("inverse_dff", f"WITH {MOVIE} SELECT frame_id, channel, pixel_id, {r('value', 4)} AS value FROM movie")
def _(spark, d):
    m = ad.movie(spark, d)
    f0 = fr.mean_map(m)
    return rounded(fr.inverse_dff(fr.dff(m, f0, eps=0.0), f0).select("frame_id", "channel", "pixel_id", "value"), "value", digits=4)


@query("time_bin", f"WITH {BINNED} SELECT bin, channel, pixel_id, {r('value')} AS value FROM binned")
def _(spark, d):
    return rounded(binned(spark, d), "value")


@query("gram", f"WITH {BINNED} SELECT a.bin AS i, b.bin AS j, {r('sum(a.value * b.value) / 128', 8)} AS value FROM binned a JOIN binned b USING (channel, pixel_id) WHERE a.bin <= b.bin GROUP BY ALL")
def _(spark, d):
    return rounded(st.gram(binned(spark, d)), "value", digits=8)


@query("pixel_stats", f"WITH {RECONSTRUCTED} SELECT pixel_id, {r('avg(value)')} AS mean, {r('var_pop(value)')} AS var, {r('stddev_pop(value)')} AS std FROM full_movie GROUP BY pixel_id")
def _(spark, d):
    """From the factors; the SQL reconstructs."""
    return rounded(st.pixel_stats(ad.spatial(spark), ad.temporal(spark, d)), "mean", "var", "std")


@query("pixelwise_function", f"WITH {RECONSTRUCTED} SELECT pixel_id, {r('max(value) - min(value)')} AS value FROM full_movie GROUP BY pixel_id")
def _(spark, d):
    return rounded(st.apply_pixelwise(ad.spatial(spark), ad.temporal(spark, d), lambda x: x.max(1) - x.min(1)), "value")


@query("pixel_percentile", f"WITH {MOVIE} SELECT pixel_id, {r('quantile_cont(value, 0.1)')} AS value FROM movie WHERE channel = 0 GROUP BY pixel_id")
def _(spark, d):
    return rounded(st.percentile_map(one_channel(spark, d)), "value")


@query("hemo_coeffs", f"WITH {RECONSTRUCTED} SELECT a.pixel_id, {r('sum(a.value * b.value) / (sum(b.value * b.value) + 1e-10)')} AS r FROM full_movie a JOIN full_movie b USING (frame_id, pixel_id) WHERE a.channel = 0 AND b.channel = 1 GROUP BY 1")
def _(spark, d):
    t = ad.temporal(spark, d)
    return rounded(st.regression_coefficients(ad.spatial(spark), t.filter("channel = 0"), t.filter("channel = 1")), "r")


@query("interp_violet", f"""WITH {TEMPORAL}, b AS (SELECT *, lag(v) OVER w AS a, lead(v) OVER w AS b, lag(v, 3) OVER w AS a3, lead(v, 3) OVER w AS b3 FROM temporal WINDOW w AS (PARTITION BY k ORDER BY t))
 SELECT k AS component, t, {r('CASE WHEN a IS NOT NULL AND b IS NOT NULL THEN (a + b) / 2 WHEN a IS NULL THEN b - (b3 - b) / 2 ELSE a + (a - a3) / 2 END')} AS value FROM b WHERE t % 2 = 0""")
def _(spark, d):
    return rounded(fr.interpolate_reference(st.components_long(ad.temporal(spark, d))).select("component", "t", "value"), "value")


@query("component_cov", f"WITH {TEMPORAL} SELECT a.k AS i, b.k AS j, {r('covar_samp(a.v, b.v)')} AS value FROM temporal a JOIN temporal b USING (t) GROUP BY ALL")
def _(spark, d):
    return rounded(st.component_covariance(ad.temporal(spark, d)), "value")


@query("seed_correlation", f"""WITH {RECONSTRUCTED}, s AS (SELECT t, value AS sv FROM full_movie WHERE pixel_id = 27)
 SELECT pixel_id, CASE WHEN pixel_id <> 27 THEN {r('covar_samp(value, sv) / (stddev_samp(value) * stddev_samp(sv) + 0.001)')} END AS r FROM full_movie JOIN s USING (t) GROUP BY pixel_id""")
def _(spark, d):
    return rounded(st.seed_correlation(ad.spatial(spark), ad.temporal(spark, d), 27), "r")


@query("correlation_rescaled", f"""WITH {RECONSTRUCTED}, s AS (SELECT t, value AS sv FROM full_movie WHERE pixel_id = 27)
 SELECT pixel_id, {r('(covar_samp(value, sv) / (stddev_samp(value) * stddev_samp(sv) + 0.001) + 1) / 2')} AS r FROM full_movie JOIN s USING (t) WHERE pixel_id <> 27 GROUP BY pixel_id""")
def _(spark, d):
    return rounded(st.seed_correlation(ad.spatial(spark), ad.temporal(spark, d), 27).filter("pixel_id <> 27").withColumn("r", fr.rescale(F.col("r"))), "r")


@query("svd_roi_timecourse", f"WITH {RECONSTRUCTED} SELECT t, {r('avg(value)')} AS value FROM full_movie WHERE {ROI} GROUP BY t")
def _(spark, d):
    return rounded(st.roi_timecourse(ad.spatial(spark), ad.temporal(spark, d), roi(spark)), "value")


@query("roi_trace_window", f"WITH {RECONSTRUCTED} SELECT t, {r('avg(value)')} AS value FROM full_movie WHERE {ROI} AND t BETWEEN 100 - 50 AND 100 + 50 GROUP BY t")
def _(spark, d):
    return rounded(st.roi_timecourse(ad.spatial(spark), ad.temporal(spark, d).filter("t between 50 and 150"), roi(spark)), "value")


@query("event_triggered_avg", f"""WITH {TEMPORAL}, {TRIALS}, e AS (SELECT min(frame_id) AS lo, max(frame_id) AS hi FROM temporal WHERE channel = 0)
 SELECT k AS component, CAST(frame_id - onset_frame AS INTEGER) AS lag, {r('avg(v)')} AS value FROM temporal, trials, e WHERE channel = 0 AND onset_frame - 5 >= lo AND onset_frame + 9 <= hi
 AND frame_id BETWEEN onset_frame - 5 AND onset_frame + 9 GROUP BY ALL""")
def _(spark, d):
    t = st.components_long(ad.temporal(spark, d).filter("channel = 0"))
    return rounded(ev.triggered_average(t, ad.trials(spark, d), 5, 10, ("component",)), "value")


@query("repeat_fold", f"WITH {MOVIE} SELECT pixel_id, frame_id % 20 AS phase, {r('avg(value)')} AS value FROM movie WHERE channel = 0 GROUP BY ALL")
def _(spark, d):
    return rounded(ev.repeat_fold(one_channel(spark, d), 20, ("pixel_id",)), "value")


@query("argmax_map", f"WITH {MOVIE} SELECT pixel_id, arg_max(frame_id, (value, -frame_id)) AS frame_id, {r('max(value)')} AS peak, {r('avg(value)')} AS mean FROM movie WHERE channel = 0 GROUP BY pixel_id")
def _(spark, d):
    return rounded(st.argmax_map(one_channel(spark, d)), "peak", "mean")


@query("spatial_roughness", f"""WITH {SPATIAL}, d AS (SELECT k, u, abs(u - lag(u) OVER (PARTITION BY k, x ORDER BY y)) AS dy, abs(u - lag(u) OVER (PARTITION BY k, y ORDER BY x)) AS dx FROM spatial)
 SELECT k AS component, {r('(sum(dy) + sum(dx)) / (count(dy) + count(dx)) / avg(abs(u))')} AS value FROM d GROUP BY k""")
def _(spark, d):
    return rounded(st.spatial_roughness(ad.spatial(spark).select("y", "x", F.posexplode("u").alias("component", "value"))), "value")


@query("temporal_roughness", f"""WITH {TEMPORAL}, d AS (SELECT k, v, abs(lag(v) OVER w + lead(v) OVER w - 2 * v) AS d2 FROM temporal WINDOW w AS (PARTITION BY k ORDER BY t))
 SELECT k AS component, {r('avg(d2) / avg(abs(v))')} AS value FROM d GROUP BY k""")
def _(spark, d):
    return rounded(st.temporal_roughness(st.components_long(ad.temporal(spark, d))), "value")


@query("l2_normalize", f"WITH {TEMPORAL} SELECT k AS component, t, {r('v / sqrt(sum(v * v) OVER (PARTITION BY k))')} AS value FROM temporal")
def _(spark, d):
    return rounded(st.normalise(st.components_long(ad.temporal(spark, d))).select("component", "t", "value"), "value")


@query("l1_normalize", f"WITH {TEMPORAL} SELECT k AS component, t, {r('v / sum(abs(v)) OVER (PARTITION BY k)')} AS value FROM temporal")
def _(spark, d):
    return rounded(st.normalise(st.components_long(ad.temporal(spark, d)), 1).select("component", "t", "value"), "value")


@query("std_projection", f"WITH {MOVIE} SELECT pixel_id, {r('stddev_pop(value)')} AS value FROM movie WHERE channel = 0 GROUP BY pixel_id")
def _(spark, d):
    return rounded(st.std_projection(one_channel(spark, d), None), "value")


@query("percentile_threshold", f"WITH {MOVIE}, s AS (SELECT pixel_id, stddev_pop(value) AS value FROM movie WHERE channel = 0 GROUP BY 1) SELECT pixel_id, value > (SELECT quantile_cont(value, 0.6) FROM s) AS keep FROM s")
def _(spark, d):
    return st.above_percentile(st.std_projection(one_channel(spark, d), None), 0.6)


@query("contrast_scale", f"WITH {MOVIE}, {MEAN_MAP}, i AS (SELECT * FROM f0 WHERE channel = 0) SELECT pixel_id, {r('greatest(0, least(1, f0 / (SELECT quantile_cont(f0, 0.98) FROM i)))')} AS value FROM i")
def _(spark, d):
    return rounded(fr.contrast(fr.mean_map(one_channel(spark, d)).select("pixel_id", F.col("f0").alias("value"))), "value")


@query("distinct_labels", "SELECT DISTINCT label FROM embeddings")
def _(spark, d):
    return ad.table(spark, d, "embeddings").select("label").distinct()


@query("label_centres", f"WITH {SPATIAL} SELECT (y // 3) * 3 + x // 3 AS label, count(*) AS area, {r('avg(y)')} AS y, {r('avg(x)')} AS x FROM (SELECT DISTINCT pixel_id, y, x FROM spatial) GROUP BY 1")
def _(spark, d):
    return rounded(st.label_centres(ad.spatial(spark).select(F.expr("(y div 3) * 3 + x div 3").alias("label"), "y", "x")), "y", "x")


@query("peak_pixel", f"WITH {MOVIE}, {MEAN_MAP} SELECT pixel_id, {r('f0')} AS value FROM f0 WHERE channel = 0 ORDER BY f0 DESC, pixel_id LIMIT 1")
def _(spark, d):
    return rounded(st.peak_pixel(fr.mean_map(one_channel(spark, d)).select("pixel_id", F.col("f0").alias("value"))), "value")


# slices, masks, element-wise ----------------------------------------------------------------------------------------------------------


@query("frame_slice", f"WITH {MOVIE} SELECT frame_id, channel, pixel_id, {r('value')} AS value FROM movie WHERE channel = 1 AND frame_id BETWEEN 10 AND 29")
def _(spark, d):
    return rounded(fr.slice_frames(ad.movie(spark, d), 10, 29, channel=1).select("frame_id", "channel", "pixel_id", "value"), "value")


@query("frame_index_list", f"WITH {MOVIE} SELECT frame_id, channel, pixel_id, {r('value')} AS value FROM movie WHERE frame_id IN (3, 77, 120)")
def _(spark, d):
    return rounded(fr.slice_frames(ad.movie(spark, d), ids=[3, 77, 120]).select("frame_id", "channel", "pixel_id", "value"), "value")


@query("last_frame", f"WITH {MOVIE} SELECT frame_id, channel, pixel_id, {r('value')} AS value FROM movie WHERE frame_id = (SELECT max(frame_id) FROM movie)")
def _(spark, d):
    return rounded(fr.slice_frames(ad.movie(spark, d), -1, -1).select("frame_id", "channel", "pixel_id", "value"), "value")


@query("svd_frame", f"WITH {RECONSTRUCTED} SELECT t, pixel_id, {r('value')} AS value FROM full_movie WHERE t = 42")
def _(spark, d):
    return rounded(st.reconstruct(ad.spatial(spark), ad.temporal(spark, d).filter("t = 42")).select("t", "pixel_id", "value"), "value")


@query("reconstruct", f"WITH {RECONSTRUCTED} SELECT t, channel, pixel_id, {r('value')} AS value FROM full_movie")
def _(spark, d):
    return rounded(st.reconstruct(ad.spatial(spark), ad.temporal(spark, d)).select("t", "channel", "pixel_id", "value"), "value")


@query("pixel_trace", f"WITH {RECONSTRUCTED} SELECT t, {r('value')} AS value FROM full_movie WHERE y = 3 AND x = 7")
def _(spark, d):
    return rounded(st.reconstruct(ad.spatial(spark).filter("y = 3 and x = least(9, 7)"), ad.temporal(spark, d)).select("t", "value"), "value")


@query("mask_zero", f"WITH {MOVIE} SELECT frame_id, channel, pixel_id, {r('CASE WHEN pixel_id % 3 = 0 THEN value ELSE 0 END')} AS value FROM movie")
def _(spark, d):
    mask = spark.range(64).select(F.col("id").cast("int").alias("pixel_id"), (F.col("id") % 3 == 0).alias("keep"))
    return rounded(fr.mask_out(ad.movie(spark, d), mask).select("frame_id", "channel", "pixel_id", "value"), "value")


def masks(spark: SparkSession) -> DataFrame:
    p = spark.range(64).select(F.col("id").cast("int").alias("pixel_id"))
    return p.select(F.lit(0).alias("mask_id"), "pixel_id", (F.col("pixel_id") % 4 == 0).alias("keep")).unionByName(p.select(F.lit(1).alias("mask_id"), "pixel_id", (F.col("pixel_id") < 20).alias("keep")))


def included(spark: SparkSession) -> DataFrame:
    return spark.range(64).select(F.col("id").cast("int").alias("pixel_id"), (F.col("id") % 2 == 0).alias("keep"))


@query("mask_to_3d", "SELECT CAST(p AS INTEGER) AS pixel_id, (p % 4 = 0 OR p < 20) AND p % 2 = 0 AS keep FROM range(64) a(p)")
def _(spark, d):
    return fr.mask_union(masks(spark), included(spark))


@query("signals_from_mask", f"WITH {MOVIE} SELECT frame_id, pixel_id, {r('value')} AS value FROM movie WHERE channel = 0 AND (pixel_id % 4 = 0 OR pixel_id < 20) AND pixel_id % 2 = 0")
def _(spark, d):
    return rounded(fr.signals_from_mask(one_channel(spark, d), fr.mask_union(masks(spark), included(spark))).select("frame_id", "pixel_id", "value"), "value")


@query("mask_union", "SELECT CAST(p AS INTEGER) AS pixel_id FROM range(64) a(p) WHERE p % 4 = 0 OR p < 20")
def _(spark, d):
    m = masks(spark).filter("keep")
    return m.filter("mask_id = 0").select("pixel_id").union(m.filter("mask_id = 1").select("pixel_id")).distinct()


@query("mask_intersect", "SELECT CAST(p AS INTEGER) AS pixel_id FROM range(64) a(p) WHERE p % 4 = 0 AND p < 20")
def _(spark, d):
    m = masks(spark).filter("keep")
    return m.filter("mask_id = 0").select("pixel_id").intersect(m.filter("mask_id = 1").select("pixel_id"))


@query("mask_except", "SELECT CAST(p AS INTEGER) AS pixel_id FROM range(64) a(p) WHERE p % 4 = 0 AND NOT p < 20")
def _(spark, d):
    m = masks(spark).filter("keep")
    return m.filter("mask_id = 0").select("pixel_id").join(m.filter("mask_id = 1").select("pixel_id"), "pixel_id", "left_anti")


@query("concat_files", "SELECT vec_id, label FROM embeddings WHERE vec_id % 2 = 0 UNION ALL SELECT vec_id, label FROM embeddings WHERE vec_id % 2 = 1")
def _(spark, d):
    e = ad.table(spark, d, "embeddings").select("vec_id", "label")
    return e.filter("vec_id % 2 = 0").unionByName(e.filter("vec_id % 2 = 1"))


@query("clip_cast", f"WITH {MOVIE} SELECT frame_id, channel, pixel_id, CAST(floor(greatest(0, least(65535, (value - 1000) * 1000))) AS INTEGER) AS value FROM movie")
def _(spark, d):
    return fr.clip(ad.movie(spark, d).withColumn("value", (F.col("value") - 1000) * 1000)).select("frame_id", "channel", "pixel_id", "value")


@query("deinterleave", f"WITH {TEMPORAL} SELECT frame_id, k AS component, {r('max(CASE WHEN channel = 0 THEN v END)')} AS signal, {r('max(CASE WHEN channel = 1 THEN v END)')} AS reference FROM temporal GROUP BY ALL")
def _(spark, d):
    t = fr.functional_first(st.components_long(ad.temporal(spark, d)))
    return rounded(t.groupBy("frame_id", "component").pivot("role", ["signal", "reference"]).agg(F.max("value")), "signal", "reference")


@query("transpose_frames", f"WITH {MOVIE} SELECT frame_id, channel, x * 8 + y AS pixel_id, x AS y, y AS x, {r('value')} AS value FROM movie")
def _(spark, d):
    return rounded(fr.transpose(ad.movie(spark, d), SIDE), "value")


@query("edit_box", "SELECT CAST(p AS INTEGER) AS pixel_id, CASE WHEN abs(p // 8 - 4) <= 2 AND abs(p % 8 - 5) <= 2 THEN TRUE ELSE p % 2 = 0 END AS keep FROM range(64) a(p)")
def _(spark, d):
    m = ad.spatial(spark).select("pixel_id", "y", "x", (F.col("pixel_id") % 2 == 0).alias("keep"))
    return fr.edit_box(m, 4, 5, True, half=2).select("pixel_id", "keep")


@query("border_reset", f"WITH {SPATIAL} SELECT pixel_id, k AS component, {r('CASE WHEN y IN (0, 7) OR x IN (0, 7) THEN 1e-10 ELSE u END')} AS value FROM spatial")
def _(spark, d):
    return rounded(fr.reset_border(ad.spatial(spark), SIDE, SIDE).select("pixel_id", F.posexplode("u").alias("component", "value")), "value")


@query("two_chan_to_rgb", f"WITH {MOVIE}, t AS (SELECT channel, max(value) AS top FROM movie GROUP BY 1), v AS (SELECT frame_id, pixel_id, channel, CAST(floor(value / top * 255) AS INTEGER) AS v FROM movie JOIN t USING (channel)) SELECT frame_id, pixel_id, max(v) FILTER (channel = 0) AS r, max(v) FILTER (channel = 1) AS g, 0 AS b FROM v GROUP BY ALL")
def _(spark, d):
    return fr.two_channel_rgb(ad.movie(spark, d))


@query("trial_boundary", f"WITH {TRIALS} SELECT DISTINCT vec_id // 2 AS frame_id, (vec_id // 2) NOT IN (SELECT onset_frame FROM trials) AS inside FROM embeddings")
def _(spark, d):
    return fr.trial_boundary(ad.temporal(spark, d), ad.trials(spark, d))


@query("trial_absolute", f"WITH {TRIALS} SELECT trial_id, onset_frame + 3 AS frame_id FROM trials")
def _(spark, d):
    t = ad.trials(spark, d)
    relative = t.select("trial_id", F.lit(3).alias("stim_in_trial"))
    return t.join(relative, "trial_id").select("trial_id", (F.col("onset_frame") + F.col("stim_in_trial")).alias("frame_id"))


# joins --------------------------------------------------------------------------------------------------------------------------------


@query("asof_baseline", f"""WITH {TRIALS}, f AS (SELECT DISTINCT vec_id // 2 AS frame_id FROM embeddings)
 SELECT frame_id, coalesce(t.trial_id, (SELECT trial_id FROM trials ORDER BY onset_frame LIMIT 1)) AS trial_id FROM f ASOF LEFT JOIN trials t ON f.frame_id >= t.onset_frame""")
def _(spark, d):
    f = ad.temporal(spark, d).select("frame_id").distinct()
    return fr.as_of(f, ad.trials(spark, d), "frame_id", "onset_frame", ["trial_id"], first=True)


@query("asof_file", "WITH f AS (SELECT i AS file_idx, i * 40 AS first_frame FROM range(1000) a(i)) SELECT v.frame_id, file_idx, v.frame_id - first_frame AS frame_in_file FROM (SELECT DISTINCT vec_id // 2 AS frame_id FROM embeddings) v ASOF JOIN f ON v.frame_id >= f.first_frame")
def _(spark, d):
    files = spark.range(1000).select(F.col("id").alias("file_idx"), (F.col("id") * 40).alias("first_frame"))
    f = ad.temporal(spark, d).select("frame_id").distinct()
    got = fr.as_of(f, files.withColumn("start", F.col("first_frame")), "frame_id", "first_frame", ["file_idx", "start"])
    return got.select("frame_id", "file_idx", (F.col("frame_id") - F.col("start")).alias("frame_in_file"))


@query("asof_strict_stim", """WITH s AS (SELECT event_id AS stim FROM events WHERE event_type = 'purchase'), l AS (SELECT event_id AS led FROM events WHERE event_type = 'click')
 SELECT stim, coalesce(led, 0) AS led FROM s ASOF LEFT JOIN l ON s.stim > l.led""")
def _(spark, d):
    e = ad.table(spark, d, "events")
    s = e.filter("event_type = 'purchase'").select(F.col("event_id").alias("stim"))
    led = e.filter("event_type = 'click'").select(F.col("event_id").alias("at"), F.col("event_id").alias("led"))
    return fr.as_of(s, led, "stim", "at", ["led"], strict=True).withColumn("led", F.coalesce("led", F.lit(0)))


@query("event_windows", f"WITH {TEMPORAL}, {TRIALS}, e AS (SELECT min(frame_id) AS lo, max(frame_id) AS hi FROM temporal) SELECT trial_id, k AS component, CAST(frame_id - onset_frame AS INTEGER) AS lag, {r('v')} AS value FROM temporal, trials, e WHERE channel = 0 AND onset_frame - 3 >= lo AND onset_frame + 3 <= hi AND frame_id BETWEEN onset_frame - 3 AND onset_frame + 3")
def _(spark, d):
    t = st.components_long(ad.temporal(spark, d).filter("channel = 0"))
    return rounded(ev.event_windows(t, ad.trials(spark, d), 3, 4).select("trial_id", "component", "lag", "value"), "value")


@query("area_semi_join", f"WITH {MOVIE} SELECT frame_id, {r('avg(value)')} AS value FROM movie WHERE channel = 0 AND y < 4 AND x < 4 GROUP BY 1")
def _(spark, d):
    atlas = ad.spatial(spark).select("pixel_id", F.when((F.col("y") < 4) & (F.col("x") < 4), 1).otherwise(0).alias("area_id"))
    return rounded(one_channel(spark, d).join(atlas.filter("area_id = 1"), "pixel_id", "left_semi").groupBy("frame_id").agg(F.avg("value").alias("value")), "value")


@query("file_pairing", "SELECT a.i AS number, 'Frames_2_8_8_uint16_' || a.i || '.dat' AS frames_file, 'Analog_' || a.i || '.dat' AS analog_file FROM range(25) a(i) WHERE a.i % 3 <> 0")
def _(spark, d):
    n = spark.range(25)
    a = n.select(F.concat(F.lit("Frames_2_8_8_uint16_"), "id", F.lit(".dat")).alias("frames_file"))
    b = n.filter("id % 3 <> 0").select(F.concat(F.lit("Analog_"), "id", F.lit(".dat")).alias("analog_file"))
    number = lambda c: F.regexp_extract(c, r"_(\d+)\.dat$", 1).cast("long").alias("number")
    return a.select(number("frames_file"), "frames_file").join(b.select(number("analog_file"), "analog_file"), "number")


@query("zip_channels", "SELECT a.n, a.vec_id AS first, b.vec_id AS second FROM (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS n FROM embeddings WHERE label < 5) a JOIN (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS n FROM embeddings WHERE label >= 5) b USING (n)")
def _(spark, d):
    e = ad.table(spark, d, "embeddings").withColumn("c", (F.col("label") >= 5).cast("int"))
    ranked = e.select("vec_id", "c", F.row_number().over(Window.partitionBy("c").orderBy("vec_id")).cast("long").alias("n")).withColumn("n", F.col("n") - 1)
    return ranked.filter("c = 0").select("n", F.col("vec_id").alias("first")).join(ranked.filter("c = 1").select("n", F.col("vec_id").alias("second")), "n")


@query("pixel_load_bins", f"SELECT date_diff('day', DATE '1992-01-01', l_shipdate::DATE) // 30 AS bin, l_partkey % 64 AS pixel_group, CAST(sum(round(l_extendedprice * 100)) AS BIGINT) AS cents, count(*) AS n FROM lineitem GROUP BY ALL")
def _(spark, d):
    p = ad.pixel_load(spark, d)
    cents = F.sum(F.round(F.col("value") * 100).cast("long"))
    return p.groupBy(F.expr("frame_id div 30").alias("bin"), (F.col("pixel_id") % 64).cast("long").alias("pixel_group")).agg(cents.alias("cents"), F.count("*").alias("n"))


# windows and sequences ----------------------------------------------------------------------------------------------------------------


@query("first_difference", f"WITH {SERIES} SELECT channel, sample, {r('value - lag(value) OVER (PARTITION BY channel ORDER BY sample)')} AS d FROM series")
def _(spark, d):
    w = Window.partitionBy("channel").orderBy("sample")
    return rounded(ad.series(spark, d).select("channel", "sample", (F.col("value") - F.lag("value").over(w)).alias("d")), "d")


@query("median3", f"WITH {SERIES}, n AS (SELECT *, lag(value, 1, 0) OVER w AS a, lead(value, 1, 0) OVER w AS b FROM series WINDOW w AS (PARTITION BY channel ORDER BY sample)) SELECT channel, sample, {r('list_sort([a, value, b])[2]')} AS m FROM n")
def _(spark, d):
    w = Window.partitionBy("channel").orderBy("sample")
    a, b, c = F.lag("value", 1, 0.0).over(w), F.col("value"), F.lead("value", 1, 0.0).over(w)
    return rounded(ad.series(spark, d).select("channel", "sample", F.greatest(F.least(a, b), F.least(F.greatest(a, b), c)).alias("m")), "m")


@query("ttl_onsets", f"""WITH {SERIES}, n AS (SELECT *, lag(value, 1, 0) OVER w AS a, lead(value, 1, 0) OVER w AS b FROM series WINDOW w AS (PARTITION BY channel ORDER BY sample)),
 m AS (SELECT channel, sample, list_sort([a, value, b])[2] AS m FROM n), q AS (SELECT *, m - lag(m) OVER (PARTITION BY channel ORDER BY sample) AS d FROM m), h AS (SELECT *, max(abs(d)) OVER (PARTITION BY channel) / 2 AS half FROM q)
 SELECT channel, sample, CASE WHEN d > 0 THEN 1 ELSE -1 END AS edge FROM h WHERE abs(d) > half""")
def _(spark, d):
    return ev.ttl_edges(ad.series(spark, d))


@query("gradient", f"""WITH {SPATIAL}, n AS (SELECT pixel_id, y, x, u, lag(u) OVER v AS a, lead(u) OVER v AS b, lag(u) OVER h AS l, lead(u) OVER h AS q FROM spatial WHERE k = 2 WINDOW v AS (PARTITION BY x ORDER BY y), h AS (PARTITION BY y ORDER BY x))
 SELECT pixel_id, {r('CASE WHEN a IS NULL THEN b - u WHEN b IS NULL THEN u - a ELSE (b - a) / 2 END')} AS gy, {r('CASE WHEN l IS NULL THEN q - u WHEN q IS NULL THEN u - l ELSE (q - l) / 2 END')} AS gx FROM n""")
def _(spark, d):
    return rounded(ev.gradient(ad.spatial(spark).select("pixel_id", "y", "x", F.col("u")[2].alias("value"))).select("pixel_id", "gy", "gx"), "gy", "gx")


@query("file_offsets", "SELECT n_nationkey AS file_idx, 10 + n_nationkey % 7 AS n_frames, sum(10 + n_nationkey % 7) OVER (ORDER BY n_nationkey) - (10 + n_nationkey % 7) AS first_frame FROM nation")
def _(spark, d):
    n = ad.table(spark, d, "nation").select(F.col("n_nationkey").alias("file_idx"), (F.lit(10) + F.col("n_nationkey") % 7).alias("n_frames"))
    return ev.file_offsets(n)


@query("chunk_ranges", "WITH c AS (SELECT n, s FROM (VALUES (1), (15), (16), (511), (512), (520), (528), (1024)) a(n), range(0, 1024, 512) b(s) WHERE s < n AND n - s >= 16) SELECT n, row_number() OVER (PARTITION BY n ORDER BY s) - 1 AS chunk, s AS first, coalesce(lead(s) OVER (PARTITION BY n ORDER BY s), n) AS last FROM c")
def _(spark, d):
    out = None
    for n in (1, 15, 16, 511, 512, 520, 528, 1024):
        c = ev.chunk_ranges(spark, n).select(F.lit(n).alias("n"), F.col("chunk").cast("long").alias("chunk"), "first", "last")
        out = c if out is None else out.unionByName(c)
    return out


@query("frame_parity", "SELECT vec_id, (row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1) % 2 AS parity FROM embeddings")
def _(spark, d):
    w = Window.partitionBy("label").orderBy("vec_id")
    return ad.table(spark, d, "embeddings").select("vec_id", F.pmod(F.row_number().over(w) - 1, F.lit(2)).cast("long").alias("parity"))


@query("natural_sort", "SELECT name, row_number() OVER (ORDER BY CAST(regexp_extract(name, '(\\d+)', 1) AS INTEGER), name) AS position FROM (SELECT 'Frames_' || p_partkey || '.dat' AS name FROM part)")
def _(spark, d):
    p = ad.table(spark, d, "part").select(F.concat(F.lit("Frames_"), "p_partkey", F.lit(".dat")).alias("name"))
    return p.select("name", F.row_number().over(Window.orderBy(F.regexp_extract("name", r"(\d+)", 1).cast("int"), "name")).cast("long").alias("position"))  # a row a file


@query("parse_file_names", "SELECT f AS name, CAST(regexp_extract(f, '_(\\d+)_(\\d+)_(\\d+)_([a-z]+\\d+)(?:_(\\d+))?\\.(bin|dat)$', 1) AS INTEGER) AS channels, CAST(regexp_extract(f, '_(\\d+)_(\\d+)_(\\d+)_([a-z]+\\d+)(?:_(\\d+))?\\.(bin|dat)$', 2) AS INTEGER) AS height, CAST(regexp_extract(f, '_(\\d+)_(\\d+)_(\\d+)_([a-z]+\\d+)(?:_(\\d+))?\\.(bin|dat)$', 3) AS INTEGER) AS width, regexp_extract(f, '_(\\d+)_(\\d+)_(\\d+)_([a-z]+\\d+)(?:_(\\d+))?\\.(bin|dat)$', 4) AS dtype FROM (SELECT 'run_' || (1 + s_suppkey % 2) || '_' || (100 + s_suppkey) || '_640_uint16.dat' AS f FROM supplier)")
def _(spark, d):
    from tessera.sources.names import parsed_names

    s = ad.table(spark, d, "supplier").select(F.concat_ws("_", F.lit("run"), 1 + F.col("s_suppkey") % 2, 100 + F.col("s_suppkey"), F.lit("640"), F.lit("uint16.dat")).alias("name"))
    return parsed_names(s).select("name", "channels", "height", "width", "dtype")


@query("merge_sort_indices", "SELECT event_id, event_type FROM events WHERE event_type IN ('click', 'purchase') ORDER BY event_id")
def _(spark, d):
    e = ad.table(spark, d, "events").select("event_id", "event_type")
    return e.filter("event_type = 'click'").unionByName(e.filter("event_type = 'purchase'")).orderBy("event_id")


@query("top_components", f"WITH {TEMPORAL} SELECT k AS component, {r('sqrt(sum(v * v))')} AS size FROM temporal GROUP BY 1 ORDER BY size DESC, component LIMIT 2")
def _(spark, d):
    t = st.components_long(ad.temporal(spark, d))
    return rounded(t.groupBy("component").agg(F.sqrt(F.sum(F.col("value") ** 2)).alias("size")), "size").orderBy(F.desc("size"), "component").limit(2)


@query("largest_region", "WITH a AS (SELECT label, vec_id % 4 AS region, count(*) AS area FROM embeddings GROUP BY ALL) SELECT label, region, area FROM a QUALIFY row_number() OVER (PARTITION BY label ORDER BY area DESC, region) = 1")
def _(spark, d):
    a = ad.table(spark, d, "embeddings").groupBy("label", (F.col("vec_id") % 4).alias("region")).agg(F.count("*").alias("area"))
    return a.withColumn("n", F.row_number().over(Window.partitionBy("label").orderBy(F.desc("area"), "region"))).filter("n = 1").drop("n")


@query("preview_frames", f"WITH {MOVIE} SELECT frame_id, channel, pixel_id, {r('value')} AS value FROM movie WHERE frame_id < 100")
def _(spark, d):
    """The preview of a recording is its first hundred frames."""
    return rounded(fr.slice_frames(ad.movie(spark, d), 0, 99).select("frame_id", "channel", "pixel_id", "value"), "value")


# phases, geometry, atlas --------------------------------------------------------------------------------------------------------------

PI2 = 6.283185307179586


@query("dft_mag_phase", f"""WITH {MOVIE}, n AS (SELECT pixel_id, count(*) AS n FROM movie WHERE channel = 0 GROUP BY 1),
 x AS (SELECT pixel_id, sum(value * cos({PI2}::DOUBLE * 7 * frame_id / n)) AS re, -sum(value * sin({PI2}::DOUBLE * 7 * frame_id / n)) AS im, max(n) AS n FROM movie JOIN n USING (pixel_id) WHERE channel = 0 GROUP BY 1)
 SELECT pixel_id, {r('2 * sqrt(re * re + im * im) / n')} AS mag, {r(f'CASE WHEN atan2(-im, re) < 0 THEN atan2(-im, re) + {PI2} ELSE atan2(-im, re) END')} AS phase FROM x""")
def _(spark, d):
    return rounded(ev.dft_bin(one_channel(spark, d), 7, ("pixel_id",)).select("pixel_id", "mag", "phase"), "mag", "phase")


def phase_maps(k: int) -> str:
    return f"(SELECT * FROM spatial WHERE k = {k})"


@query("sign_map", f"""WITH {SPATIAL}, n AS (SELECT k, pixel_id, u, lag(u) OVER v AS a, lead(u) OVER v AS b, lag(u) OVER h AS l, lead(u) OVER h AS q FROM spatial WINDOW v AS (PARTITION BY k, x ORDER BY y), h AS (PARTITION BY k, y ORDER BY x)),
 g AS (SELECT k, pixel_id, CASE WHEN a IS NULL THEN b - u WHEN b IS NULL THEN u - a ELSE (b - a) / 2 END AS gy, CASE WHEN l IS NULL THEN q - u WHEN q IS NULL THEN u - l ELSE (q - l) / 2 END AS gx FROM n)
 SELECT s.pixel_id, {r('sin(atan2(s.gx, s.gy) - atan2(t.gx, t.gy))')} AS sign FROM g s JOIN g t USING (pixel_id) WHERE s.k = 1 AND t.k = 3""")
def _(spark, d):
    s = ad.spatial(spark)
    of = lambda k: s.select("pixel_id", "y", "x", F.col("u")[k].alias("value"))
    return rounded(ev.sign_map(of(1), of(3)), "sign")


@query("visual_degrees", f"WITH {SPATIAL}, p AS (SELECT pixel_id, u, min(u) OVER () AS lo, max(u) OVER () AS hi FROM spatial WHERE k = 1) SELECT pixel_id, {r('(u - lo) / (hi - lo) * 60 + (-30)')} AS value FROM p")
def _(spark, d):
    return rounded(ev.visual_degrees(ad.spatial(spark).select("pixel_id", F.col("u")[1].alias("value")), -30, 30), "value")


@query("phase_hsv", f"""WITH {SPATIAL}, p AS (SELECT pixel_id, abs(u) AS mag, abs(u) * 6 AS phase FROM spatial WHERE k = 2), q AS (SELECT quantile_cont(mag, 0.98) AS pv, quantile_cont(pow(mag, 0.3), 0.9) AS ps FROM p)
 SELECT pixel_id, {r(f'greatest(0, least(1, phase / {PI2}))')} AS h, {r('greatest(0, least(1, pow(mag, 0.3) / ps))')} AS s, {r('greatest(0, least(1, mag / pv))')} AS v FROM p, q""")
def _(spark, d):
    m = ad.spatial(spark).select("pixel_id", F.abs(F.col("u")[2]).alias("mag"), (F.abs(F.col("u")[2]) * 6).alias("phase"))
    return rounded(geo.phase_hsv(m), "h", "s", "v")


@query("argmax_hsv", f"""WITH {MOVIE}, m AS (SELECT pixel_id, arg_max(frame_id, (value, -frame_id)) AS f, max(value) AS peak, avg(value) AS mean FROM movie WHERE channel = 0 GROUP BY 1), n AS (SELECT max(frame_id) + 1 AS n FROM movie),
 q AS (SELECT quantile_cont(peak, 0.98) AS pv, quantile_cont(peak - mean, 0.9) AS ps FROM m) SELECT pixel_id, {r('f / n::DOUBLE')} AS h, {r('greatest(0, least(1, (peak - mean) / ps))')} AS s, {r('greatest(0, least(1, peak / pv))')} AS v FROM m, n, q""")
def _(spark, d):
    rows = one_channel(spark, d)
    n = rows.agg(F.max("frame_id") + 1).first()[0] or 1
    return rounded(geo.argmax_hsv(st.argmax_map(rows), n), "h", "s", "v")


@query("combined_hsv", f"""WITH {MOVIE}, p AS (SELECT frame_id % 5 AS stack, pixel_id, stddev_pop(value) AS value FROM movie WHERE channel = 0 GROUP BY ALL),
 x AS (SELECT pixel_id, sum(value * cos({PI2}::DOUBLE * stack / 5)) AS re, -sum(value * sin({PI2}::DOUBLE * stack / 5)) AS im FROM p GROUP BY 1), a AS (SELECT pixel_id, 2 * sqrt(re * re + im * im) / 5 AS mag, atan2(-im, re) AS t FROM x), q AS (SELECT quantile_cont(mag, 0.98) AS top FROM a)
 SELECT pixel_id, {r(f'CASE WHEN t < 0 THEN t + {PI2} ELSE t END / {PI2}')} AS h, {r('greatest(0, least(1, mag / top))')} AS s, {r('greatest(0, least(1, mag / top))')} AS v FROM a, q""")
def _(spark, d):
    """Each fifth frame makes a stack; the deviation over its frames is its projection."""
    return rounded(geo.combined_hsv(one_channel(spark, d).withColumn("stack", F.col("frame_id") % 5), geo.projection("std")), "h", "s", "v")


@query("hsv_to_rgb", """WITH c AS (SELECT p_partkey AS id, (p_partkey % 100)::DOUBLE / 100 AS h, (p_size % 11)::DOUBLE / 10 AS s, (p_partkey % 17)::DOUBLE / 16 AS v FROM part),
 k AS (SELECT *, (5 + h * 6) % 6 AS k5, (3 + h * 6) % 6 AS k3, (1 + h * 6) % 6 AS k1 FROM c)
 SELECT id, round((v - v * s * greatest(0, least(k5, 4 - k5, 1))) * 255, 6) + 0.0 AS r, round((v - v * s * greatest(0, least(k3, 4 - k3, 1))) * 255, 6) + 0.0 AS g, round((v - v * s * greatest(0, least(k1, 4 - k1, 1))) * 255, 6) + 0.0 AS b FROM k""")
def _(spark, d):
    p = ad.table(spark, d, "part").select(F.col("p_partkey").alias("id"), ((F.col("p_partkey") % 100).cast("double") / 100).alias("h"), ((F.col("p_size") % 11).cast("double") / 10).alias("s"), ((F.col("p_partkey") % 17).cast("double") / 16).alias("v"))
    return geo.hsv_rgb(p).select("id", "r", "g", "b")


M = (0.9, -0.2, 1.5, 0.2, 0.9, -0.75, 0.0, 0.0, 1.0)
POINTS = "points AS (SELECT s_suppkey AS point_id, (s_suppkey % 37)::DOUBLE / 4 AS x, (s_suppkey % 23)::DOUBLE / 3 AS y FROM supplier)"


def points(spark: SparkSession, d: str) -> DataFrame:
    s = ad.table(spark, d, "supplier")
    return s.select(F.col("s_suppkey").alias("point_id"), ((F.col("s_suppkey") % 37).cast("double") / 4).alias("x"), ((F.col("s_suppkey") % 23).cast("double") / 3).alias("y"))


@query("affine_points", f"WITH {POINTS} SELECT point_id, {r('0.9 * x - 0.2 * y + 1.5')} AS x, {r('0.2 * x + 0.9 * y - 0.75')} AS y FROM points")
def _(spark, d):
    return rounded(geo.apply_affine(points(spark, d), M), "x", "y")


@query("landmarks_to_image", f"WITH {POINTS} SELECT point_id, {r('x / 0.0194 + 320')} AS x, {r('y / 0.0194 + 270')} AS y FROM points")
def _(spark, d):
    return rounded(geo.to_image_space(points(spark, d), 0.0194, (320, 270)), "x", "y")


@query("transform_regions", f"WITH {POINTS}, p AS (SELECT point_id, x / 0.0194 + 320 AS x, y / 0.0194 + 270 AS y FROM points) SELECT point_id, {r('0.9 * x - 0.2 * y + 1.5')} AS x, {r('0.2 * x + 0.9 * y - 0.75')} AS y FROM p")
def _(spark, d):
    return rounded(geo.transform_regions(points(spark, d), M, 0.0194, (320, 270)), "x", "y")


@query("similarity_fit", f"""WITH {POINTS}, p AS (SELECT x, y, 0.9 * x - 0.2 * y + 1.5 + (point_id % 3) * 0.01 AS px, 0.2 * x + 0.9 * y - 0.75 AS py FROM points),
 m AS (SELECT avg(x) AS mx, avg(y) AS my, avg(px) AS nx, avg(py) AS ny FROM p), s AS (SELECT sum((x - mx) * (px - nx) + (y - my) * (py - ny)) / sum((x - mx) ** 2 + (y - my) ** 2) AS a, sum((x - mx) * (py - ny) - (y - my) * (px - nx)) / sum((x - mx) ** 2 + (y - my) ** 2) AS b FROM p, m)
 SELECT {r('a')} AS m00, {r('-b')} AS m01, {r('nx - a * mx + b * my')} AS m02, {r('b')} AS m10, {r('a')} AS m11, {r('ny - b * mx - a * my')} AS m12 FROM s, m""")
def _(spark, d):
    p = points(spark, d)
    x, y = geo.affine(F.col("x"), F.col("y"), M)
    return rounded(geo.similarity_fit(p.select("x", "y", (x + (F.col("point_id") % 3) * 0.01).alias("px"), y.alias("py"))), "m00", "m01", "m02", "m10", "m11", "m12")


@query("xy_rot_from_affine", f"WITH {POINTS} SELECT point_id, x AS dx, y AS dy, {r('degrees(atan2(y - 3, x - 4))')} AS rot_deg FROM points")
def _(spark, d):
    return rounded(points(spark, d).select("point_id", F.col("x").alias("dx"), F.col("y").alias("dy"), geo.rotation_degrees(F.col("y") - 3, F.col("x") - 4).alias("rot_deg")), "rot_deg")


@query("warp_bilinear", f"""WITH {MOVIE}, o AS (SELECT CAST(p AS INTEGER) AS out_id, 0.9::DOUBLE * (p % 8) - 0.2::DOUBLE * (p // 8) + 1.5 AS sx, 0.2::DOUBLE * (p % 8) + 0.9::DOUBLE * (p // 8) - 0.75 AS sy FROM range(64) a(p)),
 i AS (SELECT frame_id, pixel_id, y, x, value FROM movie WHERE channel = 0), f AS (SELECT DISTINCT frame_id FROM i),
 w AS (SELECT frame_id, out_id, sum(value * (1 - abs(sx - x)) * (1 - abs(sy - y))) AS value FROM i, o WHERE abs(sx - x) < 1 AND abs(sy - y) < 1 GROUP BY ALL)
 SELECT frame_id, out_id AS pixel_id, {r('coalesce(value, 0)')} AS value FROM f CROSS JOIN o LEFT JOIN w USING (frame_id, out_id)""")
def _(spark, d):
    i = one_channel(spark, d).select("frame_id", "pixel_id", "y", "x", "value")
    return rounded(geo.warp(i, M, SIDE, SIDE).select("frame_id", "pixel_id", "value"), "value")


REGIONS = [(0, "left", [(1.0, 1.0), (4.0, 1.0), (4.0, 4.0), (1.0, 4.0)]), (0, "right", [(5.0, 1.0), (8.0, 1.0), (8.0, 4.0), (5.0, 4.0)]), (1, "left", [(1.0, 3.5), (4.5, 4.5), (2.0, 7.0)]), (1, "right", [(5.0, 4.5), (8.0, 3.5), (7.0, 7.0)])]


def region_edges(spark: SparkSession) -> DataFrame:
    rows = [(i, s, *c[k], *c[(k + 1) % len(c)]) for i, s, c in REGIONS for k in range(len(c))]
    return spark.createDataFrame(rows, "region_id int, side string, x0 double, y0 double, x1 double, y1 double")


EDGES = "edges(region_id, side, x0, y0, x1, y1) AS (VALUES " + ", ".join(f"({i}, '{s}', {c[k][0]}::DOUBLE, {c[k][1]}::DOUBLE, {c[(k + 1) % len(c)][0]}::DOUBLE, {c[(k + 1) % len(c)][1]}::DOUBLE)" for i, s, c in REGIONS for k in range(len(c))) + ")"


@query("point_in_region", f"""WITH {POINTS}, {EDGES}, e AS (SELECT *, x1 - x0 AS dx, y1 - y0 AS dy FROM points, edges), t AS (SELECT *, greatest(0, least(1, ((x - x0) * dx + (y - y0) * dy) / (dx * dx + dy * dy))) AS t, ((y0 > y) <> (y1 > y)) AND CASE WHEN dy <> 0 THEN x < dx * (y - y0) / dy + x0 END AS hit FROM e),
 g AS (SELECT point_id, region_id, side, sum(CASE WHEN hit THEN 1 ELSE 0 END) % 2 AS odd, min(sqrt((x - x0 - t * dx) ** 2 + (y - y0 - t * dy) ** 2)) AS far FROM t GROUP BY ALL)
 SELECT point_id, region_id, side FROM g WHERE odd = 1 OR far <= 0.01 QUALIFY row_number() OVER (PARTITION BY point_id ORDER BY region_id, side DESC) = 1""")
def _(spark, d):
    return geo.points_in_regions(points(spark, d), region_edges(spark))


VERTICES = [(i, k, x, y) for i, s, c in REGIONS if s == "left" for k, (x, y) in enumerate([*c, c[0]])]


@query("contour_raster", "WITH v(region_id, vertex, x, y) AS (VALUES " + ", ".join(f"({i}, {k}, {x}::DOUBLE, {y}::DOUBLE)" for i, k, x, y in VERTICES) + """), c AS (SELECT region_id, count(*) AS n FROM v GROUP BY 1),
 s AS (SELECT region_id, k * (n - 1) / 199::DOUBLE AS p, least(n - 2, CAST(floor(k * (n - 1) / 199::DOUBLE) AS INTEGER)) AS i FROM c, range(200) b(k)),
 q AS (SELECT s.region_id, a.x + (p - i) * (b.x - a.x) AS x, a.y + (p - i) * (b.y - a.y) AS y FROM s JOIN v a ON a.region_id = s.region_id AND a.vertex = i JOIN v b ON b.region_id = s.region_id AND b.vertex = i + 1)
 SELECT DISTINCT region_id, CAST(greatest(0, least(7, floor(y + 1e-9))) * 8 + greatest(0, least(7, floor(x + 1e-9))) AS INTEGER) AS pixel_id FROM q""")
def _(spark, d):
    v = spark.createDataFrame([(i, k, x + 1e-9, y + 1e-9) for i, k, x, y in VERTICES], "region_id int, vertex int, x double, y double")
    return geo.contour_pixels(v, 200, SIDE, SIDE)


PAINTED = "p AS (SELECT CAST(i AS INTEGER) AS pixel_id, i // 8 AS y, i % 8 AS x FROM range(64) a(i)), m AS (SELECT pixel_id, 0 AS region_id, 'left' AS side FROM p WHERE x < 5 AND y < 5 UNION ALL SELECT pixel_id, 0, 'right' FROM p WHERE x >= 4 AND y < 5 UNION ALL SELECT pixel_id, 1, 'left' FROM p WHERE x < 4 AND y >= 4)"


@query("atlas_paint", f"WITH {PAINTED} SELECT pixel_id, CASE WHEN side = 'left' THEN region_id + 1 ELSE -(region_id + 1) END AS area_id FROM m QUALIFY row_number() OVER (PARTITION BY pixel_id ORDER BY region_id DESC, side DESC) = 1")
def _(spark, d):
    p = ad.spatial(spark)
    of = lambda cond, i, s: p.filter(cond).select("pixel_id", F.lit(i).alias("region_id"), F.lit(s).alias("side"))
    return geo.paint_atlas(of("x < 5 and y < 5", 0, "left").unionByName(of("x >= 4 and y < 5", 0, "right")).unionByName(of("x < 4 and y >= 4", 1, "left")))


@query("top_projection", "SELECT l_suppkey % 10 AS i, l_partkey % 10 AS j, coalesce(arg_min(label, z) FILTER (label > 0), 0) AS label FROM (SELECT l_suppkey, l_partkey, l_orderkey * 10 + l_linenumber AS z, CAST(l_quantity AS INTEGER) % 5 AS label FROM lineitem QUALIFY count(*) OVER (PARTITION BY l_suppkey % 10, l_partkey % 10, l_orderkey, l_linenumber) = 1) GROUP BY ALL")
def _(spark, d):
    li = ad.table(spark, d, "lineitem").select((F.col("l_suppkey") % 10).alias("i"), (F.col("l_partkey") % 10).alias("j"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("z"), (F.col("l_quantity").cast("int") % 5).alias("label"))
    return geo.top_projection(li.withColumn("c", F.count("*").over(Window.partitionBy("i", "j", "z"))).filter("c = 1").drop("c"))


@query("structure_masks", "WITH s AS (SELECT n_nationkey AS label, max(n_regionkey + 1) AS mask FROM nation WHERE n_regionkey < 3 GROUP BY 1) SELECT l_orderkey AS i, l_linenumber AS z, l_partkey AS j, coalesce(mask, 0) AS label FROM lineitem LEFT JOIN s ON l_suppkey % 25 = s.label")
def _(spark, d):
    members = ad.table(spark, d, "nation").filter("n_regionkey < 3").select(F.col("n_regionkey").alias("structure"), F.col("n_nationkey").alias("label"))
    voxels = ad.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("i"), F.col("l_linenumber").alias("z"), F.col("l_partkey").alias("j"), (F.col("l_suppkey") % 25).alias("label"))
    return geo.structure_masks(voxels, members)


@query("projection_extent", "SELECT * FROM (VALUES ('left', -5.7::DOUBLE), ('right', 5.7::DOUBLE), ('bottom', 7.8::DOUBLE), ('top', -5.4::DOUBLE)) t(side, mm)")
def _(spark, d):
    e = geo.projection_extent(1320, 1140, (570, 540), 10, flip_y=True)
    return rounded(spark.createDataFrame(list(zip(("left", "right", "bottom", "top"), e, strict=True)), "side string, mm double"), "mm")


BLOCKS = "blocks AS (SELECT CAST((i // 5) * 4 + j // 5 AS INTEGER) AS block_id, CAST(i AS INTEGER) AS i0, CAST(least(i + 7, 18) AS INTEGER) AS i1, CAST(j AS INTEGER) AS j0, CAST(least(j + 7, 20) AS INTEGER) AS j1 FROM range(0, 18, 5) a(i), range(0, 20, 5) b(j))"


@query("overlap_blocks", f"WITH {BLOCKS} SELECT * FROM blocks")
def _(spark, d):
    return ev.overlapping_blocks(spark, 18, 20, 7, 2)


GRID = "g AS (SELECT CAST(p AS INTEGER) AS pixel_id, CAST(p // 20 AS INTEGER) AS y, CAST(p % 20 AS INTEGER) AS x FROM range(360) a(p))"


def grid(spark: SparkSession) -> DataFrame:
    return spark.range(360).select(F.col("id").cast("int").alias("pixel_id"), F.expr("int(id div 20)").alias("y"), (F.col("id") % 20).cast("int").alias("x"))


@query("block_pixels", f"WITH {BLOCKS}, {GRID} SELECT pixel_id, block_id FROM g JOIN blocks ON y >= i0 AND y < i1 AND x >= j0 AND x < j1")
def _(spark, d):
    return ev.blocks_of_pixels(grid(spark), 18, 20, 7, 2).select("pixel_id", "block_id")


@query("assemble_blocks", f"WITH {BLOCKS}, {GRID}, u AS (SELECT pixel_id, block_id, k AS component, (pixel_id * 0.5::DOUBLE + block_id) * (k + 1) AS value FROM g JOIN blocks ON y >= i0 AND y < i1 AND x >= j0 AND x < j1, (VALUES (0), (1)) c(k)) SELECT pixel_id, component, {r('sum(value) / count(DISTINCT block_id)')} AS value FROM u GROUP BY ALL")
def _(spark, d):
    b = ev.blocks_of_pixels(grid(spark), 18, 20, 7, 2).withColumn("component", F.explode(F.array(F.lit(0), F.lit(1))))
    return rounded(ev.assemble_blocks(b.withColumn("value", (F.col("pixel_id") * 0.5 + F.col("block_id")) * (F.col("component") + 1))), "value")


@query("led_channels", """WITH f AS (SELECT event_id AS frame_id, CASE WHEN event_id BETWEEN 21 AND (SELECT max(event_id) FROM events) - 18 THEN 100 + value ELSE 0 END AS intensity FROM events), l AS (SELECT frame_id FROM f, (SELECT avg(intensity) AS m FROM f) WHERE intensity - m / 2 > 0),
 e AS (SELECT max(frame_id) AS last FROM l), m AS (SELECT frame_id, CASE WHEN (last - frame_id) % 2 = 0 THEN 'signal' ELSE 'reference' END AS role FROM l, e), k AS (SELECT * FROM m WHERE frame_id >= (SELECT min(frame_id) FROM m WHERE role = 'signal')),
 r AS (SELECT role, row_number() OVER (PARTITION BY role ORDER BY frame_id) - 1 AS position, frame_id FROM k) SELECT role, position, frame_id FROM r WHERE position < (SELECT min(c) FROM (SELECT count(*) AS c FROM r GROUP BY role))""")
def _(spark, d):
    """Frames of all events, of which the first and the last are dark; half of the pulses are of each LED."""
    e = ad.table(spark, d, "events")
    n, last = e.agg(F.count("*"), F.max("event_id")).first()
    f = e.select(F.col("event_id").alias("frame_id"), F.when(F.col("event_id").between(21, last - 18), F.col("value") + 100).otherwise(0.0).alias("intensity"))
    return ev.led_channels(f, n // 2, n // 2, second_is_blue=True).withColumn("position", F.col("position").cast("long"))


@query("landmarks_json", "SELECT * FROM (VALUES ('OB_left', -1.95::DOUBLE, -3.45::DOUBLE), ('OB_center', 0::DOUBLE, -3.45::DOUBLE), ('OB_right', 1.95::DOUBLE, -3.45::DOUBLE), ('RSP_base', 0::DOUBLE, 3.2::DOUBLE)) t(name, x, y)")
def _(spark, d):
    from tessera.sources.landmarks import STANDARD, points_of, read_text

    return points_of(read_text(spark, STANDARD), "landmarks").select("name", "x", "y")
