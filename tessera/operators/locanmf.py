"""Localised non-negative factorisation: components tied to the areas of an atlas, by hierarchical alternating least squares on the factors."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.arrays import mapped
from tessera.operators.algebra import comoments


def hals(u: np.ndarray, v: np.ndarray, areas: list[np.ndarray], ranks: list[int], penalty: np.ndarray, steps: int, nonnegative: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(A: pixels x components, C: components x time, area of each component) of u v, A non-negative, each component drawn to its area."""
    home = np.repeat(np.arange(len(areas)), ranks)
    a = np.zeros((len(u), len(home)))
    rng = np.random.default_rng(0)
    for k, r in enumerate(home):
        a[areas[r], k] = np.abs(u[areas[r]] @ rng.standard_normal(u.shape[1])) + 1e-6
    outside = np.ones_like(a)
    for k, r in enumerate(home):
        outside[areas[r], k] = 0
    vv = v @ v.T
    c = np.linalg.lstsq(a, u, rcond=None)[0] @ v
    for _ in range(steps):
        cc, cv = c @ c.T, c @ v.T
        for k in range(a.shape[1]):
            grad = u @ cv[k] - a @ cc[:, k] + a[:, k] * cc[k, k]
            a[:, k] = np.maximum(0, (grad - penalty[home[k]] * outside[:, k]) / max(cc[k, k], 1e-12))
        size = np.maximum(a.max(0), 1e-12)
        a, c = a / size, c * size[:, None]
        aa, au = a.T @ a, a.T @ u
        for k in range(a.shape[1]):
            c[k] += (au[k] @ v - aa[k] @ c) / max(aa[k, k], 1e-12)
            if nonnegative:
                c[k] = np.maximum(0, c[k])
    return a, c, home


def locanmf(spatial: DataFrame, temporal: DataFrame, atlas: DataFrame, rank: int, min_rank: int = 1, max_rank: int = 10, min_pixels: int = 100, locality: float = 70.0, r2: float = 0.99, steps: int = 30, nonnegative: bool = False, limit: int = 200_000_000) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(``pixel_id, a``; ``component, t, value``; ``component, area_id``) of the factors within the atlas (pixel_id, area_id).

    The temporal factor is reduced to rank x rank by a QR of it, so only spatial weights, rank a pixel, reach the driver: refused over ``limit``
    numbers. Ranks of areas grow until each area's share of variance is explained; penalties grow until components keep ``locality`` percent of
    their weight in their area."""
    rows = spatial.join(atlas.filter(F.col("area_id") != 0), "pixel_id").select("pixel_id", "u", "area_id").orderBy("pixel_id")
    if rows.count() * rank > limit:
        raise ValueError("the spatial factor is too large for one machine")
    pdf = rows.toPandas()
    u = np.stack(pdf["u"].to_list())
    w, q = np.linalg.eigh(comoments(temporal, "v", "v").products)
    root = np.sqrt(np.maximum(w, 0))[:, None] * q.T  # v in its own row space: the same Gram matrix, rank x rank
    ids = [i for i, n in pdf["area_id"].value_counts().sort_index().items() if n >= min_pixels]
    areas = [np.flatnonzero(pdf["area_id"].to_numpy() == i) for i in ids]
    ranks, penalty = [min_rank] * len(ids), np.zeros(len(ids))
    full = u @ root
    while True:
        for _ in range(12):
            a, c, home = hals(u, root, areas, ranks, penalty, steps, nonnegative)
            share = np.array([100 * (a[areas[h], k] ** 2).sum() / max((a[:, k] ** 2).sum(), 1e-12) for k, h in enumerate(home)])
            loose = {h for k, h in enumerate(home) if share[k] < locality}
            if not loose:
                break
            for h in loose:
                penalty[h] = max(2 * penalty[h], 1e-3 * float(np.abs(full).max()))
        rest = full - a @ c
        poor = [k for k, p in enumerate(areas) if ranks[k] < max_rank and 1 - (rest[p] ** 2).sum() / max((full[p] ** 2).sum(), 1e-12) < r2]
        if not poor:
            break
        for k in poor:
            ranks[k] += 1
    spark = spatial.sparkSession
    back = c @ np.linalg.pinv(root)  # components x rank: c = back v
    series = temporal.select("t", F.posexplode(mapped("v", lambda x: x @ back.T, "array<double>")).alias("component", "value"))
    return (
        spark.createDataFrame(pd.DataFrame({"pixel_id": pdf["pixel_id"], "a": a.tolist()}), "pixel_id int, a array<double>"),
        series.select("component", "t", "value"),
        spark.createDataFrame([(k, int(ids[h])) for k, h in enumerate(home)], "component int, area_id int"),
    )
