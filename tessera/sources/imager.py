"""Recordings of a dual-LED imager: frame files and analog files paired by number, made into an interleaved movie with its trials."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.operators import events
from tessera.sources import raw, store

#: Analog channels of the two LEDs and the stimulus, and the image row that tells lit frames from dark ones.
FIRST_LED, SECOND_LED, STIMULUS, PROBE_ROW = 0, 1, 2, 100


@dataclass
class Recording:
    """``frames`` (frame_id, channel, h, w, pixels); ``trials`` (trial_id, onset_frame, stim_frame); ``baseline`` (trial_id, channel, pixel_id, f0)."""

    frames: DataFrame
    trials: DataFrame
    baseline: DataFrame


def probe(frames: DataFrame, row: int = PROBE_ROW) -> DataFrame:
    """``number, frame_id, intensity``: the mean of one image row (the last where there are fewer)."""
    start = F.least(F.lit(row), F.col("h") - 1) * F.col("w")
    line = F.slice("pixels", start + 1, F.col("w"))
    return frames.select("number", "frame_id", (F.aggregate(line, F.lit(0.0), lambda s, v: s + v) / F.col("w")).alias("intensity"))


def split_roles(frames: DataFrame, analog: DataFrame) -> DataFrame:
    """``number, frame_id, role, position`` of the lit frames of each file, the LED of the last pulse deciding which is which."""
    edges = events.ttl_edges(analog.withColumn("channel", F.struct("number", "analog_channel")).withColumn("value", F.col("value").cast("double")))
    pulses = edges.filter("edge = 1").groupBy(F.col("channel.number").alias("number")).agg(
        F.count(F.when(F.col("channel.analog_channel") == FIRST_LED, 1)).alias("n1"), F.count(F.when(F.col("channel.analog_channel") == SECOND_LED, 1)).alias("n2"),
        F.max(F.when(F.col("channel.analog_channel") == FIRST_LED, F.col("sample"))).alias("last1"), F.max(F.when(F.col("channel.analog_channel") == SECOND_LED, F.col("sample"))).alias("last2"),
    )
    p = probe(frames)
    mean = p.groupBy("number").agg(F.avg("intensity").alias("mean"), F.count("*").alias("n"))
    lit = p.join(mean, "number").filter(F.col("intensity") > F.col("mean") / 2)
    last = lit.groupBy("number").agg(F.max("frame_id").alias("last")).join(pulses, "number")
    single = F.least("n1", "n2") < F.col("n") / 2 - 20
    even = F.pmod(F.col("last") - F.col("frame_id"), F.lit(2)) == 0
    role = F.when(single | (even == (F.col("last1") > F.col("last2"))), "signal").otherwise("reference")
    marked = lit.join(last, "number").select("number", "frame_id", role.alias("role"))
    start = marked.filter("role = 'signal'").groupBy("number").agg(F.min("frame_id").alias("start"))
    kept = marked.join(start, "number").filter("frame_id >= start")
    ranked = kept.withColumn("position", F.row_number().over(Window.partitionBy("number", "role").orderBy("frame_id")) - 1)
    short = ranked.groupBy("number", "role").agg(F.count("*").alias("c")).groupBy("number").agg(F.min("c").alias("c"), F.count("*").alias("roles"))
    return ranked.join(short, "number").filter("position < c").select("number", "frame_id", "role", "position")


def read_recording(spark: SparkSession, frame_files: list[str], analog_path: str, n_baseline: int = 30, decoder=None) -> Recording:
    """Frame files, one a trial, and their analog files: an interleaved movie of signal and reference frames over all trials.

    Raw files are read by one reader, however many there are; TIFF and, with a ``decoder``, video files each by their pages."""
    files = sorted(frame_files, key=raw.natural)
    if all(p.lower().endswith((".dat", ".bin")) for p in files):
        parts = raw.read_files(spark, files).filter("channel = 0")
    else:
        pages = raw.tiff_pages if files[0].lower().endswith((".tif", ".tiff")) else decoder
        parts = numbered_pages(spark, files, pages)
    roles = split_roles(parts, raw.read_analog(spark, analog_path).select("number", "analog_channel", "sample", "value"))
    sizes = roles.filter("role = 'signal'").groupBy("number").agg(F.count("*").alias("n_frames")).withColumn("file_idx", F.col("number"))
    offsets = events.file_offsets(sizes).select("number", "first_frame")
    placed = parts.join(roles, ["number", "frame_id"]).join(F.broadcast(offsets), "number")  # a row a file
    movie = placed.select((F.col("first_frame") + F.col("position")).alias("frame_id"), F.when(F.col("role") == "signal", 0).otherwise(1).alias("channel"), "h", "w", "pixels")
    trials = offsets.select(F.col("number").cast("int").alias("trial_id"), F.col("first_frame").alias("onset_frame"), F.col("first_frame").alias("stim_frame"))
    long = movie.select("frame_id", "channel", F.posexplode("pixels").alias("pixel_id", "value"))
    return Recording(movie, trials, events.trial_baseline(long, trials, n_baseline))


def numbered_pages(spark: SparkSession, files: list[str], pages) -> DataFrame:
    """``frame_id, channel, h, w, pixels, number``: the images of each file, counted within it."""
    if pages is None:
        raise NotImplementedError("video needs a decoder: a function from a file's bytes to its images")

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for p, content in zip(b["path"], b["content"], strict=True):
                number = raw.natural(p)[0]
                for k, page in enumerate(pages(content)):
                    yield pd.DataFrame({"frame_id": [k], "channel": [0], "h": [page.shape[0]], "w": [page.shape[1]], "pixels": [page.astype(np.float32).ravel()], "number": [number[-1] if number else 0]})

    return spark.read.format("binaryFile").load(files).select("path", "content").mapInPandas(work, f"{raw.SCHEMA}, number bigint")


def read_folder(spark: SparkSession, path: str, decoder=None, n_baseline: int = 30) -> Recording:
    """A recording's folder: its analog files, and its frame files, raw before TIFF before video."""
    frames = raw.frame_files(path) or store.listed(path, "*.tif", "*.tiff") or store.listed(path, *raw.VIDEO)
    if not frames:
        raise FileNotFoundError(f"no frame files in {path}")
    return read_recording(spark, frames, f"{path.rstrip('/')}/Analog*.dat", n_baseline, decoder)


def write_recording(recording: Recording, path: str, chunk: int = 512, dtype: str = "uint16") -> None:
    """The interleaved movie as raw files; its trials (trial, onset, stimulus) and the trials' mean frames as .npy arrays beside it."""
    raw.write_raw(recording.frames, path, chunk, dtype=dtype)
    trials = recording.trials.select("trial_id", F.array(*[F.col(c).cast("double") for c in ("trial_id", "onset_frame", "stim_frame")]).alias("row"))
    raw.write_npy(trials, f"{path}/trial_onsets.npy", "trial_id", "row", (recording.trials.count(), 3), dtype="int64")
    h, w = recording.frames.select("h", "w").first()
    base = recording.baseline.select(F.struct("trial_id", "channel", "pixel_id").alias("at"), "f0")
    n = recording.baseline.agg(F.count_distinct("trial_id"), F.count_distinct("channel")).first()
    raw.write_npy(base, f"{path}/frames_average.npy", "at", "f0", (*n, h, w))
