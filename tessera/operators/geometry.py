"""Planar transforms, landmarks, warping, regions of an atlas, rasters, colours."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.arrays import unit
from tessera.operators import events

IDENTITY = (1.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 1.0)


def affine(x: Column, y: Column, m: tuple[float, ...] | None) -> tuple[Column, Column]:
    """The point mapped by a 3x3 matrix, row by row; no matrix is the identity."""
    a, b, c, d, e, f = (m or IDENTITY)[:6]
    return F.lit(float(a)) * x + F.lit(float(b)) * y + F.lit(float(c)), F.lit(float(d)) * x + F.lit(float(e)) * y + F.lit(float(f))


def apply_affine(points: DataFrame, m: tuple[float, ...] | None) -> DataFrame:
    x, y = affine(F.col("x"), F.col("y"), m)
    return points.withColumns({"x": x, "y": y})


def to_image_space(points: DataFrame, resolution: float, bregma: tuple[float, float]) -> DataFrame:
    """Millimetres to pixels: x / resolution + bregma."""
    return points.withColumns({"x": F.col("x") / resolution + bregma[0], "y": F.col("y") / resolution + bregma[1]})


def transform_regions(contours: DataFrame, m: tuple[float, ...] | None, resolution: float, bregma: tuple[float, float]) -> DataFrame:
    """Contours or centres (x, y) in image space, then mapped."""
    return apply_affine(to_image_space(contours, resolution, bregma), m)


def similarity_fit(pairs: DataFrame) -> DataFrame:
    """One row ``m00, m01, m02, m10, m11, m12``: least squares rotation, uniform scale and shift of (x, y) to (px, py), from sums."""
    s = pairs.agg(F.avg("x").alias("mx"), F.avg("y").alias("my"), F.avg("px").alias("nx"), F.avg("py").alias("ny"), F.avg(F.col("x") * F.col("px")).alias("xx"), F.avg(F.col("y") * F.col("py")).alias("yy"), F.avg(F.col("x") * F.col("py")).alias("xy"), F.avg(F.col("y") * F.col("px")).alias("yx"), F.avg(F.col("x") * F.col("x") + F.col("y") * F.col("y")).alias("q"))
    d = F.col("q") - F.col("mx") ** 2 - F.col("my") ** 2
    a = (F.col("xx") + F.col("yy") - F.col("mx") * F.col("nx") - F.col("my") * F.col("ny")) / d
    b = (F.col("xy") - F.col("yx") - F.col("mx") * F.col("ny") + F.col("my") * F.col("nx")) / d
    ab = s.select("*", a.alias("a"), b.alias("b"))
    a, b = F.col("a"), F.col("b")
    return ab.select(a.alias("m00"), (-b).alias("m01"), (F.col("nx") - a * F.col("mx") + b * F.col("my")).alias("m02"), b.alias("m10"), a.alias("m11"), (F.col("ny") - b * F.col("mx") - a * F.col("my")).alias("m12"))


def rotation_degrees(m10: Column, m00: Column) -> Column:
    return F.degrees(F.atan2(m10, m00))


def warp(image: DataFrame, m: tuple[float, ...], height: int, width: int) -> DataFrame:
    """``pixel_id, y, x, value``: out(x, y) is the image at M(x, y), bilinear, zero outside. Other key columns of the image are kept.

    Each output pixel asks for its four neighbours by an equi-join on the pixel number: the grid is a row a pixel."""
    spark = image.sparkSession
    grid = spark.range(height * width).select(F.col("id").cast("int").alias("out_id"), F.expr(f"int(id div {width})").alias("oy"), (F.col("id") % width).cast("int").alias("ox"))
    sx, sy = affine(F.col("ox").cast("double"), F.col("oy").cast("double"), m)
    near = grid.select("*", sx.alias("sx"), sy.alias("sy")).select("*", F.explode(F.array(*[F.struct((F.floor("sy") + i).alias("y"), (F.floor("sx") + j).alias("x")) for i in (0, 1) for j in (0, 1)])).alias("n"))
    w = (1 - F.abs(F.col("sx") - F.col("n.x"))) * (1 - F.abs(F.col("sy") - F.col("n.y")))
    inside = (F.col("n.x").between(0, width - 1)) & (F.col("n.y").between(0, height - 1))
    asks = near.filter(inside & (w > 0)).select("out_id", (F.col("n.y") * width + F.col("n.x")).cast("int").alias("pixel_id"), w.alias("w"))
    keys = [c for c in image.columns if c not in ("pixel_id", "y", "x", "value")]
    got = image.join(asks, "pixel_id").groupBy(*keys, "out_id").agg(F.sum(F.col("value") * F.col("w")).alias("value"))
    if keys:
        every = image.select(*keys).distinct().crossJoin(grid)  # the result's own size
        out = every.join(got, [*keys, "out_id"], "left")
    else:
        out = grid.join(got, "out_id", "left")
    return out.select(*keys, F.col("out_id").alias("pixel_id"), F.col("oy").alias("y"), F.col("ox").alias("x"), F.coalesce("value", F.lit(0.0)).alias("value"))


def points_in_regions(points: DataFrame, edges: DataFrame, slack: float = 0.01, most: int = 1_000_000) -> DataFrame:
    """``point_id, region_id, side``: the first region, by number, whose contour the point is within or at most ``slack`` beyond; of a region's sides
    the right one wins. Points in none are left out.

    ``edges`` (region_id, side, x0, y0, x1, y1) are an atlas's: over ``most`` they are refused. They go to the workers, where a batch of points
    meets one contour after the other, so points are neither multiplied nor shuffled."""
    n = edges.count()
    if n > most:
        raise ValueError(f"{n} edges are no atlas's")
    rows = edges.select("region_id", "side", *[F.col(c).cast("double") for c in ("x0", "y0", "x1", "y1")]).collect()
    contours: dict[tuple, list] = {}
    for r in rows:
        contours.setdefault((r[0], r[1] != "right", r[1]), []).append(tuple(r)[2:])
    held = points.sparkSession.sparkContext.broadcast([(k[0], k[2], np.array(v).T) for k, v in sorted(contours.items())])

    def inside(x: np.ndarray, y: np.ndarray, c: np.ndarray) -> np.ndarray:
        odd, far = np.zeros(len(x), bool), np.full(len(x), np.inf)
        for x0, y0, x1, y1 in c.T:
            dx, dy = x1 - x0, y1 - y0
            if dy:
                odd ^= ((y0 > y) != (y1 > y)) & (x < dx * (y - y0) / dy + x0)
            t = np.clip(((x - x0) * dx + (y - y0) * dy) / (dx * dx + dy * dy), 0, 1) if dx or dy else 0.0
            far = np.minimum(far, np.hypot(x - x0 - t * dx, y - y0 - t * dy))
        return odd | (far <= slack)

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            x, y = b["x"].to_numpy(np.float64), b["y"].to_numpy(np.float64)
            found = np.full(len(b), -1)
            for k, (_, _, c) in enumerate(held.value):
                open_ = np.flatnonzero(found < 0)
                found[open_[inside(x[open_], y[open_], c)]] = k
            at = found[found >= 0]
            yield pd.DataFrame({"point_id": b["point_id"][found >= 0], "region_id": [held.value[k][0] for k in at], "side": [held.value[k][1] for k in at]})

    kinds = {f.name: f.dataType.simpleString() for f in [*points.schema, *edges.schema]}
    return points.select("point_id", F.col("x").cast("double"), F.col("y").cast("double")).mapInPandas(work, f"point_id {kinds['point_id']}, region_id {kinds['region_id']}, side string")


def contour_pixels(vertices: DataFrame, samples: int, height: int, width: int) -> DataFrame:
    """``region_id, pixel_id`` that a contour (region_id, vertex, x, y) passes: resampled linearly by vertex number, cut to the image."""
    w = Window.partitionBy("region_id").orderBy("vertex")
    v = vertices.withColumn("nx", F.lead("x").over(w)).withColumn("ny", F.lead("y").over(w)).withColumn("n", F.count("*").over(Window.partitionBy("region_id")))
    s = v.filter("n > 1").withColumn("k", F.explode(F.sequence(F.ceil(F.col("vertex") * (samples - 1) / (F.col("n") - 1)).cast("int"), F.least(F.lit(samples - 1), F.floor((F.col("vertex") + 1) * (samples - 1) / (F.col("n") - 1)).cast("int")))))
    f = F.col("k") * (F.col("n") - 1) / F.lit(float(samples - 1)) - F.col("vertex")
    x = F.col("x") + F.when(F.col("nx").isNull(), 0.0).otherwise(f * (F.col("nx") - F.col("x")))
    y = F.col("y") + F.when(F.col("ny").isNull(), 0.0).otherwise(f * (F.col("ny") - F.col("y")))
    hold = lambda c, n: F.greatest(F.lit(0), F.least(F.lit(n - 1), F.floor(c).cast("int")))
    return s.select("region_id", (hold(y, height) * width + hold(x, width)).cast("int").alias("pixel_id")).distinct()


def paint_atlas(masks: DataFrame) -> DataFrame:
    """``pixel_id, area_id``: later regions, and of a region the right side, paint over earlier ones; left areas are region + 1, right ones negative."""
    label = F.when(F.col("side") == "left", F.col("region_id") + 1).otherwise(-(F.col("region_id") + 1))
    order = F.col("region_id") * 2 + F.when(F.col("side") == "left", 0).otherwise(1)
    return masks.groupBy("pixel_id").agg(F.max_by(label, order).cast("int").alias("area_id"))


def top_projection(volume: DataFrame) -> DataFrame:
    """``i, j, label``: the first positive label along the depth z; 0 without one."""
    return volume.groupBy("i", "j").agg(F.coalesce(F.min(F.when(F.col("label") > 0, F.struct("z", "label")))["label"], F.lit(0)).alias("label"))


def structure_masks(voxels: DataFrame, members: DataFrame) -> DataFrame:
    """``i, z, j, label``: voxels as the number of the last structure (structure, label) that has their label, plus one; 0 in none."""
    return voxels.join(members.groupBy("label").agg((F.max("structure") + 1).alias("mask")), "label", "left").select("i", "z", "j", F.coalesce("mask", F.lit(0)).alias("label"))


def projection_extent(height: int, width: int, reference: tuple[float, float], resolution: float, flip_y: bool = False) -> tuple[float, float, float, float]:
    """(left, right, bottom, top) in millimetres of a projection whose reference is at a pixel."""
    s = resolution / 1000
    x, y = (-reference[0] * s, (width - reference[0]) * s), (-reference[1] * s, (height - reference[1]) * s)
    return (*x, *(y[::-1] if flip_y else y))


def phase_hsv(maps: DataFrame, value_p: float = 0.98, saturation_p: float = 0.90) -> DataFrame:
    """``pixel_id, h, s, v`` of (pixel_id, mag, phase): phase / 2 pi, mag^0.3 and mag over their percentiles, in 0..1."""
    p = maps.agg(F.percentile("mag", F.lit(value_p)).alias("pv"), F.percentile(F.col("mag") ** 0.3, F.lit(saturation_p)).alias("ps"))
    return maps.crossJoin(F.broadcast(p)).select("pixel_id", unit(F.col("phase") / (2 * math.pi)).alias("h"), unit(F.col("mag") ** 0.3 / F.col("ps")).alias("s"), unit(F.col("mag") / F.col("pv")).alias("v"))  # one row


def argmax_hsv(maps: DataFrame, n_frames: int, value_p: float = 0.98, saturation_p: float = 0.90) -> DataFrame:
    """``pixel_id, h, s, v`` of (pixel_id, frame_id, peak, mean): the frame of the greatest value over the number of frames, the peak over the mean,
    and the peak, over their percentiles, in 0..1."""
    p = maps.agg(F.percentile("peak", F.lit(value_p)).alias("pv"), F.percentile(F.col("peak") - F.col("mean"), F.lit(saturation_p)).alias("ps"))
    return maps.crossJoin(F.broadcast(p)).select("pixel_id", unit(F.col("frame_id") / n_frames).alias("h"), unit((F.col("peak") - F.col("mean")) / F.col("ps")).alias("s"), unit(F.col("peak") / F.col("pv")).alias("v"))  # one row


def projection(name: str = "std") -> Callable[[Column], Column]:
    """An aggregate over a pixel's frames, by name; any other function from a column to an aggregate does as well."""
    return {"std": F.stddev_pop, "mean": F.avg, "max": F.max, "min": F.min, "median": F.median, "var": F.var_pop}[name]


def combined_hsv(stacks: DataFrame, project: Callable[[Column], Column] = F.stddev_pop, value_p: float = 0.98, saturation_p: float = 0.98) -> DataFrame:
    """``pixel_id, h, s, v`` of several stacks (stack, frame_id, pixel_id, value), numbered from 0: each is projected over its frames, and the
    first Fourier component along the stacks gives the phase (h) and the magnitude (s and v, over its percentiles), in 0..1."""
    each = stacks.groupBy("stack", "pixel_id").agg(project(F.col("value")).alias("value"))
    m = events.dft_bin(each, 1, ("pixel_id",), at="stack")
    p = m.agg(F.percentile("mag", F.lit(value_p)).alias("pv"), F.percentile("mag", F.lit(saturation_p)).alias("ps"))
    return m.crossJoin(F.broadcast(p)).select("pixel_id", unit(F.col("phase") / (2 * math.pi)).alias("h"), unit(F.col("mag") / F.col("ps")).alias("s"), unit(F.col("mag") / F.col("pv")).alias("v"))  # one row


def hsv_rgb(hsv: DataFrame) -> DataFrame:
    """``r, g, b`` in 0..255 beside h, s, v in 0..1."""
    k = lambda n: (F.lit(float(n)) + F.col("h") * 6) % 6
    c = lambda n: F.round((F.col("v") - F.col("v") * F.col("s") * F.greatest(F.lit(0.0), F.least(k(n), 4 - k(n), F.lit(1.0)))) * 255, 6)
    return hsv.withColumns({"r": c(5), "g": c(3), "b": c(1)})
