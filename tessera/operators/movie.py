"""A movie as its factors, and the preprocessing that makes them."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.arrays import stacked
from tessera.operators import factor, geometry, registration, stats
from tessera.operators.algebra import comoments
from tessera.operators.frames import reset_border
from tessera.sources import raw


@dataclass(frozen=True)
class FactoredMovie:
    """movie = u . v, evaluated without reconstructing wherever the question allows. ``spatial``: pixel_id, y, x, u; ``temporal``: t, frame_id, channel, v."""

    spatial: DataFrame
    temporal: DataFrame
    rank: int
    height: int
    width: int

    def frames(self, first: int, last: int) -> DataFrame:
        return stats.reconstruct(self.spatial, self.temporal.filter(F.col("t").between(first, last)))

    def pixel_stats(self) -> DataFrame:
        return stats.pixel_stats(self.spatial, self.temporal)

    def timecourse(self, roi: DataFrame) -> DataFrame:
        return stats.roi_timecourse(self.spatial, self.temporal, roi)

    def correlation(self, y: int, x: int) -> DataFrame | None:
        """Correlation with a seed pixel; None outside the image."""
        return stats.seed_correlation(self.spatial, self.temporal, y * self.width + x) if 0 <= y < self.height and 0 <= x < self.width else None

    def apply(self, func: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
        return stats.apply_pixelwise(self.spatial, self.temporal, func)

    def warped(self, m: tuple[float, ...]) -> FactoredMovie:
        """The spatial factor warped component by component, after its border is reset."""
        long = reset_border(self.spatial, self.height, self.width).select("pixel_id", "y", "x", F.posexplode("u").alias("component", "value"))
        w = geometry.warp(long, m, self.height, self.width)
        u = w.groupBy("pixel_id", "y", "x").agg(F.transform(F.array_sort(F.collect_list(F.struct("component", "value"))), lambda s: s["value"]).alias("u"))
        return replace(self, spatial=u)


def preprocess(frames: DataFrame, height: int, width: int, k: int = 200, fs: float = 30.0, mode: str | None = "2d", functional: int = 0, mask: np.ndarray | None = None, out: str | None = None, chunk: int = 512) -> tuple[FactoredMovie, factor.Corrected | None]:
    """Register, factorise, and, of a movie of two channels, correct: the whole of a recording's preparation.

    With ``out`` the products are saved there on the way: the registered movie as raw files, from which the rest goes on, the shifts and
    rotations, the mean frames, the mask, and the factors, as .npy arrays."""
    if mode:
        registered = registration.motion_correct(frames, height, width, mode)
        if out:
            registered = registered.withColumn("h", F.lit(height)).withColumn("w", F.lit(width)).persist(StorageLevel.MEMORY_AND_DISK)
            raw.write_raw(registered.select("frame_id", "channel", "h", "w", "pixels"), f"{out}/motioncorrect", chunk, base="motioncorrect")
            n, c = registered.agg(F.count_distinct("frame_id"), F.max("channel") + 1).first()
            moved = registered.select(F.struct("frame_id", "channel").alias("at"), F.array("dy", "dx").alias("shift"), "rot_deg")
            raw.write_npy(moved, f"{out}/motion_correction_shifts.npy", "at", "shift", (n, c, 2))
            raw.write_npy(moved, f"{out}/motion_correction_rotation.npy", "at", "rot_deg", (n, c))
            registered.unpersist()
            frames = raw.read_raw(frames.sparkSession, f"{out}/motioncorrect").select("frame_id", "channel", F.col("pixels").cast("array<double>").alias("pixels"))
        else:
            frames = registered.select("frame_id", "channel", "pixels").persist(StorageLevel.MEMORY_AND_DISK)  # read by all that follows
    spatial, temporal = factor.approximate_svd(frames, k, mask=mask)
    spatial = spatial.withColumn("y", F.expr(f"int(pixel_id div {width})")).withColumn("x", (F.col("pixel_id") % width).cast("int"))
    rank = len(spatial.first()["u"])
    movie = FactoredMovie(spatial, temporal, rank, height, width)
    two = (frames.agg(F.max("channel")).first()[0] or 0) == 1
    corrected = factor.hemodynamic_correction(spatial, temporal, fs, functional=functional) if two else None
    if out:
        means = factor.baseline_frames(frames)
        raw.write_npy(means, f"{out}/frames_average.npy", "channel", "f0", (means.count(), height, width))
        if mask is not None:
            raw.write_array(f"{out}/mask.npy", np.asarray(mask))
        save_products(movie, corrected, out)
    return movie, corrected


def save_products(movie: FactoredMovie, corrected: factor.Corrected | None, out: str) -> None:
    """U.npy (height, width, rank) and SVT.npy (rank, time), and of a corrected movie SVTcorr.npy (rank, frames), rcoeffs.npy (height, width) and T.npy."""
    raw.write_npy(movie.spatial, f"{out}/U.npy", "pixel_id", "u", (movie.height, movie.width, movie.rank))
    raw.write_npy(movie.temporal, f"{out}/SVT.npy", "t", "v", (movie.rank, movie.temporal.count()), columns_first=True)
    if corrected is not None:
        by_time = corrected.temporal.groupBy("t").agg(F.transform(F.array_sort(F.collect_list(F.struct("component", "value"))), lambda s: s["value"]).alias("v"))
        raw.write_npy(by_time, f"{out}/SVTcorr.npy", "t", "v", (movie.rank, by_time.count()), columns_first=True)
        every = movie.spatial.select("pixel_id").join(corrected.coefficients, "pixel_id", "left")
        raw.write_npy(every, f"{out}/rcoeffs.npy", "pixel_id", "r", (movie.height, movie.width))
        raw.write_array(f"{out}/T.npy", corrected.matrix)


def area_correlations(spatial: DataFrame, temporal: DataFrame, atlas: DataFrame, keep: int = 5) -> DataFrame:
    """``a, b, r``: the first canonical correlation of each pair of areas (pixel_id, area_id), from the ``keep`` leading directions of each area.

    Each area is reduced to its leading directions, ``keep`` arrays of the factors' rank, in a task of its own; these, as few as an atlas has
    areas, are compared on the driver."""
    c = np.nan_to_num(comoments(temporal, "v", "v").covariance())
    w, q = np.linalg.eigh(c)
    root = np.sqrt(np.maximum(w, 0))[:, None] * q.T

    def leading(pdf: pd.DataFrame) -> pd.DataFrame:
        _, s, v = np.linalg.svd(stacked(pdf["u"]) @ root, full_matrices=False)
        found = v[: min(keep, int((s > 1e-10).sum()))] if len(c) else np.zeros((0, 0))
        return pd.DataFrame({"area_id": [int(pdf["area_id"].iloc[0])] * max(1, len(found)), "k": range(max(1, len(found))), "base": list(found) or [None]})

    spark = spatial.sparkSession
    base: dict[int, list] = {}
    if len(c):
        areas = spatial.join(atlas.filter("area_id <> 0"), "pixel_id").select(F.col("area_id").cast("int"), "u")
        for r in areas.groupBy("area_id").applyInPandas(leading, "area_id int, k int, base array<double>").orderBy("area_id", "k").collect():
            base.setdefault(r["area_id"], []).extend([] if r["base"] is None else [r["base"]])
    else:
        base = {r["area_id"]: [] for r in atlas.filter("area_id <> 0").join(spatial, "pixel_id").select("area_id").distinct().collect()}
    found = [(a, b, float(np.linalg.svd(np.array(x) @ np.array(y).T, compute_uv=False)[0]) if x and y else 0.0) for a, x in base.items() for b, y in base.items() if a < b]
    return spark.createDataFrame(found, "a int, b int, r double")


def match_sessions(reference: DataFrame, other: DataFrame, points: DataFrame, mask: DataFrame, height: int, width: int) -> tuple[tuple[float, ...], DataFrame, DataFrame]:
    """(matrix, points, mask) that bring one session to another: a rigid transform between the mean frames (channel 0), landmarks through it, the
    mask (pixel_id, keep) through its inverse."""
    a, b = registration.collected(reference, height, width)[0], registration.collected(other, height, width)[0]
    dy, dx, rot = registration.ecc(a, b)
    c, s = float(np.cos(np.radians(rot))), float(np.sin(np.radians(rot)))
    cy, cx = (height - 1) / 2, (width - 1) / 2
    m = (c, -s, cx - c * cx + s * cy + dx, s, c, cy - s * cx - c * cy + dy, 0.0, 0.0, 1.0)
    inverse = tuple(np.linalg.inv(np.array(m).reshape(3, 3)).ravel().tolist())
    image = mask.select("pixel_id", F.expr(f"int(pixel_id div {width})").alias("y"), (F.col("pixel_id") % width).cast("int").alias("x"), F.col("keep").cast("double").alias("value"))
    moved = geometry.warp(image, inverse, height, width).select("pixel_id", (F.col("value") >= 0.5).alias("keep"))
    return m, geometry.apply_affine(points, m), moved
