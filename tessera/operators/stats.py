"""Statistics of movies, most of them on the factors (spatial u, temporal v) without reconstructing."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.arrays import dot, mapped, quadratic, stacked
from tessera.operators.algebra import comoments, mean_array


def components_long(temporal: DataFrame) -> DataFrame:
    """``t, frame_id, channel, component, value`` of the temporal factor."""
    return temporal.select("t", "frame_id", "channel", F.posexplode("v").alias("component", "value"))


def reconstruct(spatial: DataFrame, temporal: DataFrame, side: int = 512) -> DataFrame:
    """``t, frame_id, channel, pixel_id, value``: the product of the factors, for the frames and pixels given. Filter both first: the result is
    their product in rows.

    Blocks of about ``side`` frames and ``side`` pixels are multiplied each in a group of its own, so neither factor is sent whole to a task."""
    n_t, n_p = max(1, -(-temporal.count() // side)), max(1, -(-spatial.count() // side))
    of = lambda key, n: F.pmod(F.xxhash64(key), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    v = temporal.select("t", "frame_id", "channel", F.col("v").cast("array<double>").alias("v"), of("t", n_t).alias("ft")).withColumn("fp", every(n_p))
    u = spatial.select(F.col("pixel_id").cast("int"), F.col("u").cast("array<double>").alias("u"), of("pixel_id", n_p).alias("fp")).withColumn("ft", every(n_t))

    def work(frames: pd.DataFrame, pixels: pd.DataFrame) -> pd.DataFrame:
        if not len(frames) or not len(pixels):
            return pd.DataFrame({"t": [], "frame_id": [], "channel": [], "pixel_id": [], "value": []})
        value = stacked(frames["v"]) @ stacked(pixels["u"]).T
        each = {c: np.repeat(frames[c].to_numpy(), len(pixels)) for c in ("t", "frame_id", "channel")}
        return pd.DataFrame(each | {"pixel_id": np.tile(pixels["pixel_id"].to_numpy(), len(frames)), "value": value.ravel()})

    return v.groupBy("ft", "fp").cogroup(u.groupBy("ft", "fp")).applyInPandas(work, "t long, frame_id long, channel int, pixel_id int, value double")


def pixel_stats(spatial: DataFrame, temporal: DataFrame) -> DataFrame:
    """``pixel_id, mean, var, std`` of the reconstructed series (population variance): u.mean(v) and u^T Cov u, never the movie."""
    m = comoments(temporal, "v", "v")
    c = m.covariance(sample=False)
    both = spatial.select("pixel_id", mapped("u", lambda x: x @ m.mean_a).alias("mean"), mapped("u", lambda x: quadratic(x, c)).alias("var"))
    return both.withColumn("std", F.sqrt(F.greatest(F.lit(0.0), "var")))


def apply_pixelwise(spatial: DataFrame, temporal: DataFrame, func: Callable[[np.ndarray], np.ndarray], limit: int = 50_000_000) -> DataFrame:
    """``pixel_id, value``: any reducer of (pixels x time) arrays along axis 1, on batches of pixels.

    The temporal factor goes to the workers, as one array of doubles and after a check of its size (``limit`` numbers); a greater one is
    refused, to be reduced by a statistic with a compressed form."""
    n = temporal.count()
    rank = len(temporal.first()["v"]) if n else 0
    if n * rank > limit:
        raise ValueError(f"{n} x {rank} numbers are too many to send to the workers")
    found = temporal.select("t", F.col("v").cast("array<double>").alias("v")).toArrow().sort_by("t")["v"].combine_chunks()
    held = spatial.sparkSession.sparkContext.broadcast(found.flatten().to_numpy(zero_copy_only=False).reshape(n, rank))

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = max(1, 8_000_000 // max(1, n))  # pixels whose series are held at a time
        for b in batches:
            for k in range(0, len(b), rows):
                part = b.iloc[k : k + rows]
                yield pd.DataFrame({"pixel_id": part["pixel_id"], "value": func(stacked(part["u"]) @ held.value.T)})

    return spatial.select("pixel_id", "u").mapInPandas(work, "pixel_id int, value double")


def percentile_map(movie: DataFrame, p: float = 0.10) -> DataFrame:
    """``pixel_id, value``: the linear percentile over time."""
    return movie.groupBy("pixel_id").agg(F.percentile("value", F.lit(p)).alias("value"))


def regression_coefficients(spatial: DataFrame, signal: DataFrame, reference: DataFrame, eps: float = 1e-10) -> DataFrame:
    """``pixel_id, r``: sum(ab) / (sum(b^2) + eps) of a pixel's two channels, from two rank x rank matrices, summed in one pass."""
    pairs = signal.select("frame_id", F.col("v").alias("a")).join(reference.select("frame_id", F.col("v").alias("b")), "frame_id")
    m = comoments(pairs.select("b", F.concat("b", "a").alias("ba")), "b", "ba").products
    bb, ba = m[:, : len(m)], m[:, len(m) :]
    return spatial.select("pixel_id", mapped("u", lambda x: quadratic(x, ba) / (quadratic(x, bb) + eps)).alias("r"))


def component_covariance(temporal: DataFrame) -> DataFrame:
    """``i, j, value``: sample covariance of the components, in one pass; null with fewer than two rows."""
    c = comoments(temporal, "v", "v").covariance()
    i, j = np.indices(c.shape)
    rows = pd.DataFrame({"i": i.ravel(), "j": j.ravel(), "value": c.ravel()})
    return temporal.sparkSession.createDataFrame(rows, "i int, j int, value double").withColumn("value", F.nanvl("value", F.lit(None).cast("double")))


def seed_correlation(spatial: DataFrame, temporal: DataFrame, seed: int) -> DataFrame:
    """``pixel_id, r``: covariance with the seed pixel over the product of deviations + 0.001; null at the seed, no row if there is no such pixel."""
    c = comoments(temporal, "v", "v").covariance()
    at = spatial.filter(F.col("pixel_id") == seed).first()
    if at is None:
        return spatial.select("pixel_id", F.lit(None).cast("double").alias("r")).limit(0)
    us = np.array(at["u"], np.float64)
    own = float(np.sqrt(us @ c @ us))
    r = mapped("u", lambda x: x @ (c @ us) / (own * np.sqrt(quadratic(x, c)) + 0.001))
    return spatial.select("pixel_id", F.when(F.col("pixel_id") != seed, r).alias("r"))


def roi_timecourse(spatial: DataFrame, temporal: DataFrame, roi: DataFrame) -> DataFrame:
    """``t, value``: the mean over the region's pixels (pixel_id) as mean(u).v, by linearity."""
    mean = mean_array(spatial.join(roi.select("pixel_id").distinct(), "pixel_id", "left_semi"), "u")
    return temporal.crossJoin(F.broadcast(mean)).select("t", dot("mu", "v").alias("value"))  # one row


def gram(binned: DataFrame, held: int = 16_000_000) -> DataFrame:
    """``i, j, value`` (i <= j): sum over pixels of the product of two bins over the number of pixels.

    A block of pixels, of ``held`` numbers with all its bins, is one product of matrices; the blocks' products are added up by rows."""
    spark = binned.sparkSession
    n, bins = binned.agg(F.count_distinct("channel", "pixel_id"), F.coalesce(F.max("bin") + 1, F.lit(0))).first()
    blocks = max(1, -(-n * bins // held))

    def partial(pdf: pd.DataFrame) -> pd.DataFrame:
        at = pd.factorize(pd.MultiIndex.from_frame(pdf[["channel", "pixel_id"]]))[0]
        x = np.zeros((bins, at.max() + 1))
        x[pdf["bin"].to_numpy(), at] = pdf["value"]
        return pd.DataFrame({"i": np.arange(bins), "row": list(x @ x.T)})

    def whole(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"i": pdf["i"].iloc[:1], "row": [stacked(pdf["row"]).sum(0)]})

    if not n:
        return spark.createDataFrame([], "i long, j long, value double")
    parts = binned.withColumn("block", F.pmod(F.xxhash64("channel", "pixel_id"), F.lit(blocks))).groupBy("block").applyInPandas(partial, "i int, row array<double>")
    rows = parts.groupBy("i").applyInPandas(whole, "i int, row array<double>")
    return rows.select(F.col("i").cast("long"), F.posexplode("row").alias("j", "value")).filter("i <= j").select("i", F.col("j").cast("long"), (F.col("value") / n).alias("value"))


def argmax_map(movie: DataFrame) -> DataFrame:
    """``pixel_id, frame_id, peak, mean``: the first frame of the greatest value."""
    best = F.max(F.struct(F.col("value").alias("v"), (-F.col("frame_id")).alias("f")))
    return movie.groupBy("pixel_id").agg(best.alias("b"), F.avg("value").alias("mean")).select("pixel_id", (-F.col("b.f")).alias("frame_id"), F.col("b.v").alias("peak"), "mean")


def spatial_roughness(components: DataFrame) -> DataFrame:
    """``component, value``: the mean absolute difference of neighbours over the mean absolute value; (component, y, x, value)."""
    down, right = Window.partitionBy("component", "x").orderBy("y"), Window.partitionBy("component", "y").orderBy("x")
    d = components.withColumn("dy", F.abs(F.col("value") - F.lag("value").over(down))).withColumn("dx", F.abs(F.col("value") - F.lag("value").over(right)))
    total = F.coalesce(F.sum("dy"), F.lit(0.0)) + F.coalesce(F.sum("dx"), F.lit(0.0))
    return d.groupBy("component").agg((total / (F.count("dy") + F.count("dx")) / F.avg(F.abs("value"))).alias("value"))


def temporal_roughness(components: DataFrame) -> DataFrame:
    """``component, value``: mean |v(t-1) + v(t+1) - 2 v(t)| over mean |v|; (component, t, value)."""
    w = Window.partitionBy("component").orderBy("t")
    d = components.withColumn("d2", F.abs(F.lag("value").over(w) + F.lead("value").over(w) - 2 * F.col("value")))
    return d.groupBy("component").agg((F.avg("d2") / F.avg(F.abs("value"))).alias("value"))


def normalise(components: DataFrame, norm: int = 2) -> DataFrame:
    """Each component over its L1 or L2 norm; a zero component stays zero."""
    size = components.groupBy("component").agg((F.sqrt(F.sum(F.col("value") ** 2)) if norm == 2 else F.sum(F.abs("value"))).alias("size"))
    return components.join(size, "component").withColumn("value", F.when(F.col("size") > 0, F.col("value") / F.col("size")).otherwise(F.col("value"))).drop("size")


def std_projection(movie: DataFrame, n_frames: int | None = 1000, seed: int = 0) -> DataFrame:
    """``pixel_id, value``: the deviation over at most ``n_frames`` frames, those of the smallest seeded hash; over all frames with None."""
    if n_frames is None:
        return movie.groupBy("pixel_id").agg(F.stddev_pop("value").alias("value"))
    ids = movie.select("frame_id").distinct().orderBy(F.xxhash64(F.lit(seed), "frame_id")).limit(n_frames)
    return movie.join(F.broadcast(ids), "frame_id").groupBy("pixel_id").agg(F.stddev_pop("value").alias("value"))


def above_percentile(image: DataFrame, p: float = 0.6) -> DataFrame:
    """``pixel_id, keep``."""
    return image.crossJoin(F.broadcast(image.agg(F.percentile("value", F.lit(p)).alias("p")))).select("pixel_id", (F.col("value") > F.col("p")).alias("keep"))  # one row


def label_centres(labels: DataFrame) -> DataFrame:
    """``label, area, y, x``: area and centroid of each label (label, y, x)."""
    return labels.groupBy("label").agg(F.count("*").alias("area"), F.avg("y").alias("y"), F.avg("x").alias("x"))


def peak_pixel(image: DataFrame) -> DataFrame:
    """``pixel_id, value`` of the greatest value, the first of equals."""
    return image.agg(F.max(F.struct("value", (-F.col("pixel_id")).alias("m"))).alias("b")).select((-F.col("b.m")).alias("pixel_id"), F.col("b.value").alias("value"))
