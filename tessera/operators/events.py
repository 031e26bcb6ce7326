"""Events in analog traces, trials, windows around events, chunks, and phases of periodic stimulation."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def ttl_edges(series: DataFrame, key: str = "channel", at: str = "sample") -> DataFrame:
    """``key, at, edge`` (1 rising, -1 falling): a median of three against glitches (zeros beyond the ends), then differences greater than half of
    the trace's greatest absolute difference; an edge is at the sample after it."""
    w = Window.partitionBy(key).orderBy(at)
    a, b, c = F.lag("value", 1, 0.0).over(w), F.col("value"), F.lead("value", 1, 0.0).over(w)
    d = series.withColumn("m", F.greatest(F.least(a, b), F.least(F.greatest(a, b), c))).withColumn("d", F.col("m") - F.lag("m").over(w))
    d = d.withColumn("half", F.max(F.abs("d")).over(Window.partitionBy(key)) / 2)
    return d.filter(F.abs("d") > F.col("half")).select(key, at, F.when(F.col("d") > 0, 1).otherwise(-1).alias("edge"))


def event_windows(movie: DataFrame, events: DataFrame, before: int, after: int, at: str = "frame_id") -> DataFrame:
    """The rows of each event's whole window with ``lag`` in -before..after-1, by an equi-join on exploded frames; incomplete windows are dropped."""
    ends = movie.agg(F.min(at).alias("lo"), F.max(at).alias("hi"))
    whole = events.crossJoin(F.broadcast(ends)).filter((F.col("onset_frame") - before >= F.col("lo")) & (F.col("onset_frame") + after - 1 <= F.col("hi")))  # one row
    frames = whole.select("trial_id", "onset_frame", F.explode(F.sequence(F.col("onset_frame") - before, F.col("onset_frame") + after - 1)).alias(at))
    return movie.join(frames.withColumn("lag", (F.col(at) - F.col("onset_frame")).cast("int")), at)


def triggered_average(series: DataFrame, events: DataFrame, before: int, after: int, keys: tuple[str, ...]) -> DataFrame:
    """``keys, lag, value``: the mean over events at each lag."""
    return event_windows(series, events, before, after).groupBy(*keys, "lag").agg(F.avg("value").alias("value"))


def trial_baseline(movie: DataFrame, trials: DataFrame, n: int) -> DataFrame:
    """``trial_id, channel, pixel_id, f0``: the mean of the first ``n`` frames from each onset, of as many as there are."""
    frames = trials.select("trial_id", F.explode(F.sequence(F.col("onset_frame"), F.col("onset_frame") + n - 1)).alias("frame_id"))
    return movie.join(frames, "frame_id").groupBy("trial_id", "channel", "pixel_id").agg(F.avg("value").alias("f0"))


def repeat_fold(series: DataFrame, period: int, keys: tuple[str, ...], onset: int = 0) -> DataFrame:
    """``keys, phase, value``: the mean over repeats of ``period`` samples."""
    return series.groupBy(*keys, F.pmod(F.col("frame_id") - onset, F.lit(period)).alias("phase")).agg(F.avg("value").alias("value"))


def dft_bin(series: DataFrame, k: int, keys: tuple[str, ...], at: str = "frame_id") -> DataFrame:
    """``keys, re, im, mag, phase`` of DFT bin ``k``: mag = 2|X|/T, phase = -angle(X) modulo 2 pi. Linear, so it may be taken of factors first."""
    n = series.groupBy(*keys).agg(F.count("*").alias("_n"))
    w = F.lit(2 * math.pi * k) * F.col(at) / F.col("_n")
    x = series.join(n, list(keys)).groupBy(*keys).agg(F.sum(F.col("value") * F.cos(w)).alias("re"), (-F.sum(F.col("value") * F.sin(w))).alias("im"), F.max("_n").alias("_n"))
    phase = F.atan2(-F.col("im"), F.col("re"))
    return x.select(*keys, "re", "im", (F.lit(2.0) * F.sqrt(F.col("re") ** 2 + F.col("im") ** 2) / F.col("_n")).alias("mag"), F.when(phase < 0, phase + 2 * math.pi).otherwise(phase).alias("phase"))


def gradient(image: DataFrame) -> DataFrame:
    """``pixel_id, y, x, gy, gx``: central differences, one-sided at the edges."""

    def along(axis: str, other: str):
        w = Window.partitionBy(other).orderBy(axis)
        a, b, v = F.lag("value").over(w), F.lead("value").over(w), F.col("value")
        return F.when(a.isNull(), b - v).when(b.isNull(), v - a).otherwise((b - a) / 2)

    return image.select("pixel_id", "y", "x", along("y", "x").alias("gy"), along("x", "y").alias("gx"))


def sign_map(first: DataFrame, second: DataFrame) -> DataFrame:
    """``pixel_id, sign``: the sine of the angle between the gradients of two phase maps."""
    a = gradient(first).select("pixel_id", F.atan2("gx", "gy").alias("a"))
    b = gradient(second).select("pixel_id", F.atan2("gx", "gy").alias("b"))
    return a.join(b, "pixel_id").select("pixel_id", F.sin(F.col("a") - F.col("b")).alias("sign"))


def visual_degrees(phase: DataFrame, start: float, stop: float) -> DataFrame:
    """Phases scaled from their own range to start .. start + |stop - start|."""
    ends = phase.agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    return phase.crossJoin(F.broadcast(ends)).withColumn("value", (F.col("value") - F.col("lo")) / (F.col("hi") - F.col("lo")) * abs(stop - start) + start).drop("lo", "hi")  # one row


def chunk_ranges(spark: SparkSession, n: int, size: int = 512, least: int = 16) -> DataFrame:
    """``chunk, first, last`` (last excluded): chunks of ``size``; a tail under ``least`` joins the chunk before it, and fewer frames than that
    in all give no chunk."""
    starts = spark.range(0, n, size).select(F.col("id").alias("first")).filter(F.lit(n) - F.col("first") >= least)
    w = Window.orderBy("first")  # a row a chunk
    return starts.select((F.row_number().over(w) - 1).cast("int").alias("chunk"), "first", F.coalesce(F.lead("first").over(w), F.lit(n).cast("long")).alias("last"))


def overlapping_blocks(spark: SparkSession, height: int, width: int, size: int = 128, overlap: int = 16) -> DataFrame:
    """``block_id, i0, i1, j0, j1``: tiles at steps of size - overlap, cut at the edges."""
    step = size - overlap
    i = spark.range(0, height, step).select(F.col("id").cast("int").alias("i0"))
    j = spark.range(0, width, step).select(F.col("id").cast("int").alias("j0"))
    across = -(-width // step)
    return i.crossJoin(j).select((F.col("i0") / step * across + F.col("j0") / step).cast("int").alias("block_id"), "i0", F.least(F.col("i0") + size, F.lit(height)).alias("i1"), "j0", F.least(F.col("j0") + size, F.lit(width)).alias("j1"))  # the tiles of a plan


def blocks_of_pixels(pixels: DataFrame, height: int, width: int, size: int, overlap: int) -> DataFrame:
    """Each pixel with every tile it is in: the tiles are computed from its place, so nothing is joined."""
    step = size - overlap
    near = lambda c, n: F.filter(F.transform(F.sequence(F.lit(0), F.lit((size - 1) // step)), lambda k: F.floor(F.col(c) / step).cast("int") - k), lambda t: (t >= 0) & (F.col(c) < t * step + size) & (t * step < n))
    across = -(-width // step)
    out = pixels.withColumn("_i", F.explode(near("y", height))).withColumn("_j", F.explode(near("x", width)))
    return out.withColumn("block_id", (F.col("_i") * across + F.col("_j")).cast("int")).drop("_i", "_j")


def assemble_blocks(block_u: DataFrame) -> DataFrame:
    """``pixel_id, component, value``: tiles' components added up over the number of tiles at the pixel."""
    return block_u.groupBy("pixel_id", "component").agg((F.sum("value") / F.count_distinct("block_id")).alias("value"))


def file_offsets(files: DataFrame) -> DataFrame:
    """``first_frame`` of each file (file_idx, n_frames): the frames of the files before it. A row a file."""
    w = Window.orderBy("file_idx").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return files.withColumn("first_frame", F.sum("n_frames").over(w) - F.col("n_frames"))


def led_channels(frames: DataFrame, n_first: int, n_second: int, second_is_blue: bool) -> DataFrame:
    """``role, position, frame_id`` of alternating LED frames (frame_id, intensity): role signal or reference.

    Frames at most half as bright as the mean are dark and dropped. The last lit frame tells the parity of its LED; with far fewer pulses of
    one LED than half the frames the recording has one channel. Lists are trimmed so that the signal comes first and both are equally long."""
    mean = frames.agg(F.avg("intensity").alias("mean"), F.count("*").alias("n"))
    lit = frames.crossJoin(F.broadcast(mean)).filter(F.col("intensity") - F.col("mean") / 2 > 0)  # one row
    single = (F.least(F.lit(n_first), F.lit(n_second)) < F.col("n") / 2 - 20)
    end = lit.agg(F.max("frame_id").alias("last"))
    is_last = F.pmod(F.col("frame_id") - F.col("last"), F.lit(2)) == 0
    signal_last = F.lit(second_is_blue)
    role = F.when(single, "signal").when(is_last == signal_last, "signal").otherwise("reference")
    marked = lit.crossJoin(F.broadcast(end)).select("frame_id", role.alias("role"))  # one row
    start = marked.filter("role = 'signal'").agg(F.min("frame_id").alias("start"))
    kept = marked.crossJoin(F.broadcast(start)).filter(F.col("frame_id") >= F.col("start"))  # one row
    ranked = kept.withColumn("position", F.row_number().over(Window.partitionBy("role").orderBy("frame_id")) - 1)
    sizes = ranked.groupBy("role").agg(F.count("*").alias("c")).agg(F.min("c").alias("shortest"))
    return ranked.crossJoin(F.broadcast(sizes)).filter(F.col("position") < F.col("shortest")).select("role", "position", "frame_id")  # one row
