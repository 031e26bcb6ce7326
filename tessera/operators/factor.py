"""Low-rank factors of movies, global and by blocks, and the correction of one channel by the other."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.arrays import mapped, stacked
from tessera.operators import events, signals, stats
from tessera.operators.algebra import comoments
from tessera.operators.frames import EPS, as_of, bin_size


def frame_dff(frames: DataFrame, baseline: DataFrame, divide: bool = True) -> DataFrame:
    """dF/F in the frame layout: each frame's pixels against its channel's (and trial's) baseline array ``f0``.

    A baseline without trials is a frame for each channel, a bound that the camera sets, so it is broadcast; one with trials has a row for
    each trial, and the movie is dealt out by trial."""
    keys = [k for k in ("trial_id", "channel") if k in baseline.columns]
    baseline = baseline if "trial_id" in keys else F.broadcast(baseline)
    f = F.transform("f0", lambda v: v + EPS)
    rel = F.zip_with("pixels", f, lambda x, m: (x - m) / m if divide else x - m)
    return frames.join(baseline, keys).withColumn("pixels", rel).drop("f0")


def baseline_frames(frames: DataFrame) -> DataFrame:
    """``channel, f0``: the mean frame as an array. A row a channel."""
    means = frames.select("channel", F.posexplode("pixels").alias("p", "v")).groupBy("channel", "p").agg(F.avg("v").alias("v"))
    return means.groupBy("channel").agg(F.transform(F.array_sort(F.collect_list(F.struct("p", "v"))), lambda s: s["v"]).alias("f0"))


#: Numbers of a block of pixels with all its bins, and of a factor that is sent to the workers whole.
HELD, SENT = 16_000_000, 32_000_000
#: Bins or pixels whose products with each other are a matrix for the driver (32 MB).
WHOLE = 2048
#: Frames and pixels of a piece where the factor is too large to be sent.
PIECE_FRAMES, PIECE_PIXELS = 2048, 8192


def summed(pdf: pd.DataFrame) -> np.ndarray:
    return np.stack(pdf["total"].to_list()).sum(0)


def gathered(parts: DataFrame, n: int, m: int) -> np.ndarray:
    """The n x m matrix whose rows (bin, total) come in parts that add up; rows without parts are zero."""

    def added(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"bin": pdf["bin"].iloc[:1], "total": [summed(pdf)]})

    out = np.zeros((n, m))
    for batch in parts.groupBy("bin").applyInPandas(added, "bin long, total array<double>").toArrow().to_batches():
        out[batch["bin"].to_numpy()] = batch["total"].flatten().to_numpy(zero_copy_only=False).reshape(-1, m)
    return out


def leading_vectors(multiply: Callable[[np.ndarray], np.ndarray], n: int, k: int, tol: float = 1e-8) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` greatest eigenvalues of a symmetric matrix of ``n`` rows, none negative, and their vectors (n, k), from its products with some 1.25 k
    columns at a time: block Lanczos with restarts, until no residual exceeds ``tol`` of the greatest eigenvalue. The published algorithm rounds
    the matrix itself to float32, by 6e-8 of it. Holds some ten times n x k numbers."""
    wide = min(n, k + max(20, k // 4))
    basis = np.linalg.qr(np.random.default_rng(0).standard_normal((n, wide)))[0]
    image = multiply(basis)
    while True:
        inner = basis.T @ image
        values, mix = np.linalg.eigh((inner + inner.T) / 2)
        values, mix = values[::-1], mix[:, ::-1]
        q = basis @ mix[:, :wide]
        rest = image @ mix[:, :wide] - q * values[:wide]
        limit = tol * max(float(values[0]), 0.0)
        if basis.shape[1] >= n or (np.sqrt((rest[:, :k] ** 2).sum(0)) <= limit).all():
            return values[:k], q[:, :k]
        if basis.shape[1] + wide > 4 * wide:
            basis, image = basis @ mix[:, : 2 * wide], image @ mix[:, : 2 * wide]
        for _ in range(2):
            rest -= basis @ (basis.T @ rest)
        new, size, _ = np.linalg.svd(rest, full_matrices=False)
        new = new[:, size > 1e-3 * limit][:, : n - basis.shape[1]]
        new = np.linalg.qr(new - basis @ (basis.T @ new))[0]
        basis, image = np.hstack([basis, new]), np.hstack([image, multiply(new)])


def approximate_svd(frames: DataFrame, k: int = 200, per_bin: int = 15, max_bins: int = 5000, mask: np.ndarray | None = None, divide: bool = True, trials: DataFrame | None = None, compat: bool = False) -> tuple[DataFrame, DataFrame]:
    """(spatial ``pixel_id, u``; temporal ``t, frame_id, channel, v``) of a movie in the frame layout.

    Bins of dF/F (at most ``max_bins`` of each channel) give unit components, and every frame is projected on them. Where there are no more pixels
    than bins, and at most ``WHOLE``, the components are the leading vectors of the pixels' products over the bins. Else bins are kept by blocks
    of pixels and combined into components block by block, by the leading vectors of the bins' products over the pixels: of a matrix on the
    driver for at most ``WHOLE`` bins of all channels, and for more without that matrix, by its products with a few columns. With ``trials`` (trial_id, onset_frame) each frame uses its trial's baseline. ``compat`` has the published algorithm's edges: the last bin
    lacks its last frame, the movie's last frame is zero, and with trials so are the frames before the first onset."""
    n, channels, px = frames.agg(F.coalesce(F.max("frame_id") + 1, F.lit(0)), F.coalesce(F.max("channel") + 1, F.lit(1)), F.coalesce(F.max(F.size("pixels")), F.lit(0))).first()
    if trials is not None:
        marked = as_of(frames, trials, "frame_id", "onset_frame", ["trial_id"], first=True)
        base = marked.select("trial_id", "channel", F.posexplode("pixels").alias("p", "v")).groupBy("trial_id", "channel", "p").agg(F.avg("v").alias("v"))
        base = base.groupBy("trial_id", "channel").agg(F.transform(F.array_sort(F.collect_list(F.struct("p", "v"))), lambda s: s["v"]).alias("f0"))
        rel = frame_dff(marked, base, divide).drop("trial_id")
    else:
        rel = frame_dff(frames, baseline_frames(frames), divide)
    per_bin, bins = bin_size(n, k, per_bin, max_bins)
    last, bins = bins * per_bin - int(compat), bins * channels  # a channel's bins are rows of their own
    by_pixel = px <= min(bins, WHOLE)
    width = max(1, px if by_pixel else min(px, HELD // max(1, bins)))
    keep = np.ones(px) if mask is None else mask.ravel().astype(np.float64)
    held = frames.sparkSession.sparkContext.broadcast(keep)  # a frame

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                x = stacked(b["pixels"]) * held.value
                at, inverse = np.unique(b["bin"].to_numpy(), return_inverse=True)
                total = np.zeros((len(at), px))
                np.add.at(total, inverse, x)
                count = np.bincount(inverse)
                for first in range(0, px, width):
                    yield pd.DataFrame({"block": first // width, "bin": at, "total": list(total[:, first : first + width]), "n": count})

    def mean(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"block": pdf["block"].iloc[:1], "bin": pdf["bin"].iloc[:1], "total": [summed(pdf) / pdf["n"].sum()]})

    def of_pixels(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c = None
        for b in batches:
            if len(b):
                x = stacked(b["total"])
                c = x.T @ x / px + (0 if c is None else c)
        if c is not None:
            yield pd.DataFrame({"bin": np.arange(px), "total": list(c)})

    def of_bins(pdf: pd.DataFrame) -> pd.DataFrame:
        x = np.zeros((bins, len(pdf["total"].iloc[0])))
        x[pdf["bin"].to_numpy()] = stacked(pdf["total"])
        return pd.DataFrame({"bin": np.arange(bins), "total": list(x @ x.T / px)})

    def times(q: np.ndarray) -> np.ndarray:
        sent = frames.sparkSession.sparkContext.broadcast(q)

        def multiply(pdf: pd.DataFrame) -> pd.DataFrame:
            x, at = stacked(pdf["total"]), pdf["bin"].to_numpy()
            return pd.DataFrame({"bin": at, "total": list(x @ (x.T @ sent.value[at]) / px)})

        out = gathered(binned.groupBy("block").applyInPandas(multiply, parts), *q.shape)
        sent.destroy()
        return out

    binned = rel.filter(F.col("frame_id") < last).select((F.expr(f"frame_id div {per_bin}") * channels + F.col("channel")).alias("bin"), "pixels").mapInPandas(partial, "block int, bin long, total array<double>, n long")
    binned = binned.groupBy("block", "bin").applyInPandas(mean, "block int, bin long, total array<double>")
    if bins > WHOLE and not by_pixel:  # read many times, block by block
        binned = binned.repartition("block").sortWithinPartitions("block")
    parts = "bin long, total array<double>"
    binned = binned.persist(StorageLevel.MEMORY_AND_DISK)
    if by_pixel:
        size, vectors = np.linalg.eigh(gathered(binned.select("total").mapInPandas(of_pixels, parts), px, px))
    elif bins <= WHOLE:
        size, vectors = np.linalg.eigh(gathered(binned.groupBy("block").applyInPandas(of_bins, parts), bins, bins))
    else:
        size, vectors = leading_vectors(times, bins, min(k, bins))
    first = np.argsort(-size)[:k]
    norm = np.sqrt(np.maximum(size[first], 0) * px)  # of vectors.T @ bins, as its square is the eigenvalue
    sound = norm > 1e-12 * max(float(norm.max(initial=0)), 1e-300)
    mix = np.where(sound[:, None], vectors[:, first].T / np.where(sound, 1 if by_pixel else norm, 1)[:, None], 0)

    def components(pdf: pd.DataFrame) -> pd.DataFrame:
        x = np.zeros((bins, len(pdf["total"].iloc[0])))
        x[pdf["bin"].to_numpy()] = stacked(pdf["total"])
        return pd.DataFrame({"pixel_id": int(pdf["block"].iloc[0]) * width + np.arange(x.shape[1]), "u": list((mix @ x).T)})

    def own(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"pixel_id": b["id"].astype(np.int32), "u": list((mix * keep).T[b["id"]])})

    of = "pixel_id int, u array<double>"
    spatial = frames.sparkSession.range(px).mapInPandas(own, of) if by_pixel else binned.groupBy("block").applyInPandas(components, of)
    spatial = spatial.persist(StorageLevel.MEMORY_AND_DISK)
    v = projected(rel, spatial, px, len(mix))
    if compat:
        start = 0 if trials is None else trials.agg(F.min("onset_frame")).first()[0] or 0
        v = v.withColumn("v", F.when(F.col("frame_id").between(start, n - 2), F.col("v")).otherwise(F.transform("v", lambda x: F.lit(0.0))))
    return spatial, v.select((F.col("frame_id") * channels + F.col("channel")).alias("t"), "frame_id", "channel", "v")


def projected(rel: DataFrame, spatial: DataFrame, px: int, k: int, sent: int = SENT) -> DataFrame:
    """``frame_id, channel, v``: each frame (pixels) times the components (pixel_id, u) of all its ``px`` pixels.

    Components of ``sent`` numbers at most go to the workers, and frames are multiplied where they stand; larger ones, and the frames, are dealt
    out in pieces, whose products are added up for each frame."""
    schema = "frame_id long, channel int, v array<double>"
    rel = rel.select(F.col("frame_id").cast("long"), F.col("channel").cast("int"), "pixels")
    if px * k <= sent:
        table = spatial.toArrow().sort_by("pixel_id")
        u = np.concatenate([x.flatten().to_numpy(zero_copy_only=False) for x in table["u"].chunks] or [np.zeros(0)]).reshape(table.num_rows, k)
        held = rel.sparkSession.sparkContext.broadcast(u)

        def project(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                if len(b):
                    yield pd.DataFrame({"frame_id": b["frame_id"], "channel": b["channel"], "v": list(stacked(b["pixels"]) @ held.value)})

        return rel.mapInPandas(project, schema)
    chunks = rel.agg(F.coalesce(F.max("frame_id") + 1, F.lit(0))).first()[0] // PIECE_FRAMES + 1

    def pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for k in range(0, len(b), 64):
                part = b.iloc[k : k + 64]
                x = stacked(part["pixels"])
                for first in range(0, px, PIECE_PIXELS):
                    yield pd.DataFrame({"block": first // PIECE_PIXELS, "chunk": part["frame_id"] // PIECE_FRAMES, "frame_id": part["frame_id"], "channel": part["channel"], "pixels": list(x[:, first : first + PIECE_PIXELS])})

    def multiply(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return pd.DataFrame({"frame_id": [], "channel": [], "v": []})
        return pd.DataFrame({"frame_id": a["frame_id"], "channel": a["channel"], "v": list(stacked(a["pixels"]) @ stacked(b.sort_values("pixel_id")["u"]))})

    def added(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"frame_id": pdf["frame_id"].iloc[:1], "channel": pdf["channel"].iloc[:1], "v": [stacked(pdf["v"]).sum(0)]})

    cut = rel.mapInPandas(pieces, "block int, chunk long, frame_id long, channel int, pixels array<double>")
    u = spatial.select("pixel_id", "u", F.floor(F.col("pixel_id") / PIECE_PIXELS).cast("int").alias("block"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(chunks - 1).cast("long"))).alias("chunk"))
    return cut.groupBy("block", "chunk").cogroup(u.groupBy("block", "chunk")).applyInPandas(multiply, schema).groupBy("frame_id", "channel").applyInPandas(added, schema)


def blockwise_svd(rel: DataFrame, height: int, width: int, k: int = 200, block_k: int = 20, size: int = 120, overlap: int = 8) -> tuple[DataFrame, DataFrame, np.ndarray]:
    """(spatial ``pixel_id, component, value``; temporal ``t, component, value``; singular values) of dF/F pixels (t, pixel_id, y, x, value).

    Tiles are reduced by a deterministic SVD each, in its own task; the tiles' temporal components, tiles x ``block_k`` numbers for each t, meet
    in a second one by their products, a matrix of that many rows and columns, which is all that reaches the driver; spatial components are
    put together by the mean over overlapping tiles. Frames that a tile lacks count as zero."""
    tiled = events.blocks_of_pixels(rel, height, width, size, overlap)

    def reduce(pdf: pd.DataFrame) -> pd.DataFrame:
        m = pdf.pivot(index="pixel_id", columns="t", values="value").sort_index().fillna(0.0)
        u, s, v = np.linalg.svd(m.to_numpy(), full_matrices=False)
        n = min(block_k, len(s))
        block = int(pdf["block_id"].iloc[0])
        parts = [pd.DataFrame({"block_id": block, "kind": "u", "at": m.index, "component": c, "value": u[:, c]}) for c in range(n)]
        return pd.concat(parts + [pd.DataFrame({"block_id": block, "kind": "v", "at": m.columns, "component": c, "value": s[c] * v[c]}) for c in range(n)])

    parts = tiled.groupBy("block_id").applyInPandas(reduce, "block_id int, kind string, at long, component int, value double").persist(StorageLevel.MEMORY_AND_DISK)
    v = parts.filter("kind = 'v'").select("block_id", "component", F.col("at").alias("t"), "value")
    rows = [(r["block_id"], r["component"]) for r in v.select("block_id", "component").distinct().orderBy("block_id", "component").collect()]  # tiles x block_k
    spark = rel.sparkSession
    numbered = spark.createDataFrame([(b, c, i) for i, (b, c) in enumerate(rows)], "block_id int, component int, row int")
    series = v.join(F.broadcast(numbered), ["block_id", "component"]).groupBy("t").agg(F.map_from_entries(F.collect_list(F.struct("row", "value"))).alias("m"))
    series = series.select("t", F.transform(F.sequence(F.lit(0), F.lit(len(rows) - 1)), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0.0))).alias("v")).persist(StorageLevel.MEMORY_AND_DISK)
    squares, vectors = np.linalg.eigh(comoments(series, "v", "v").products)
    n = min(k, len(rows))
    first = np.argsort(-squares)[:n]
    s, left = np.sqrt(np.maximum(squares[first], 0)), vectors[:, first]
    mixed = spark.createDataFrame([(b, c, list(map(float, left[i]))) for i, (b, c) in enumerate(rows)], "block_id int, component int, w array<double>")
    block_u = parts.filter("kind = 'u'").select("block_id", "component", F.col("at").cast("int").alias("pixel_id"), "value").join(F.broadcast(mixed), ["block_id", "component"])  # a row for each tile's component
    per_block = block_u.select("block_id", "pixel_id", F.posexplode(F.transform("w", lambda w: w * F.col("value"))).alias("component", "value")).groupBy("block_id", "pixel_id", "component").agg(F.sum("value").alias("value"))
    temporal = series.select("t", F.posexplode(mapped("v", lambda x: x @ left, "array<double>")).alias("component", "value"))
    return events.assemble_blocks(per_block), temporal.select("t", "component", "value"), s


def noise_roughness(spark: SparkSession, height: int, width: int, length: int, blocks: int = 100, components: int = 1, seed: int = 0) -> DataFrame:
    """``block, component, spatial, temporal``: how rough the leading components of pure noise are, by the measures of ``stats.spatial_roughness`` and
    ``stats.temporal_roughness``. Components of a movie that are as rough hold no signal: a percentile of these is the threshold."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for block in b["id"]:
                e = np.random.default_rng([seed, int(block)]).standard_normal((height * width, length))
                u, _, v = np.linalg.svd(e, full_matrices=False)
                for k in range(min(components, u.shape[1])):
                    im, series = u[:, k].reshape(height, width), v[k]
                    steps = np.concatenate([np.abs(np.diff(im, axis=0)).ravel(), np.abs(np.diff(im, axis=1)).ravel()])
                    bends = np.abs(series[:-2] + series[2:] - 2 * series[1:-1])
                    yield pd.DataFrame({"block": [block], "component": [k], "spatial": [steps.mean() / np.abs(im).mean()], "temporal": [bends.mean() / np.abs(series).mean()]})

    return spark.range(blocks).mapInPandas(work, "block long, component int, spatial double, temporal double")


def noise_thresholds(roughness: DataFrame, confidence: float = 0.99) -> DataFrame:
    """One row, ``spatial, temporal``: what all but the ``confidence`` of noise components exceed."""
    return roughness.agg(*[F.percentile(c, F.lit(1 - confidence)).alias(c) for c in ("spatial", "temporal")])


def correction_matrix(spatial: DataFrame, coefficients: DataFrame) -> np.ndarray:
    """T = pinv(U^T U) U^T diag(r) U from two rank x rank sums over pixels, made in one pass."""
    weight = F.coalesce(F.nanvl("r", F.lit(EPS)), F.lit(EPS))
    joined = spatial.join(coefficients, "pixel_id").select("u", F.concat("u", F.transform("u", lambda x: x * weight)).alias("both"))
    m = comoments(joined, "u", "both").products
    return np.linalg.pinv(m[:, : len(m)]) @ m[:, len(m) :]


@dataclass
class Corrected:
    temporal: DataFrame
    coefficients: DataFrame
    matrix: np.ndarray


def hemodynamic_correction(spatial: DataFrame, temporal: DataFrame, fs: float = 30.0, low: float = 14.0, high: float = 0.1, functional: int = 0, filters: bool = True) -> Corrected:
    """The signal channel without what the reference channel explains: high-pass both, low-pass the reference where ``low`` is under fs / 2,
    take means off, regress by pixel through the origin, project the pixels' coefficients on the components, subtract, take means off."""
    long = stats.components_long(temporal)
    one = lambda c: long.filter(F.col("channel") == c).select("component", F.col("frame_id").alias("t"), "value")
    a, b = one(functional), one(1 - functional)
    if filters:
        a, b = signals.highpass(a, high, fs), signals.highpass(b, high, fs)
        if low < fs / 2:
            b = signals.lowpass(b, low, fs)

    def centred(series: DataFrame) -> DataFrame:
        mean = series.groupBy("component").agg(F.avg("value").alias("m"))
        return series.join(F.broadcast(mean), "component").select("component", "t", (F.col("value") - F.col("m")).alias("value"))  # a row a component

    def arrays(series: DataFrame) -> DataFrame:
        return series.groupBy("t").agg(F.transform(F.array_sort(F.collect_list(F.struct("component", "value"))), lambda s: s["value"]).alias("v")).select(F.col("t").alias("frame_id"), "v")

    a, b = centred(a).persist(StorageLevel.MEMORY_AND_DISK), centred(b).persist(StorageLevel.MEMORY_AND_DISK)
    va, vb = arrays(a), arrays(b)
    r = stats.regression_coefficients(spatial, va, vb)
    m = correction_matrix(spatial, r)
    moved = vb.select("frame_id", F.posexplode(mapped("v", lambda x: x @ m.T, "array<double>")).alias("component", "moved"))
    rest = a.withColumnRenamed("t", "frame_id").join(moved, ["frame_id", "component"]).select("component", F.col("frame_id").alias("t"), (F.col("value") - F.col("moved")).alias("value"))
    return Corrected(centred(rest), r, m)
