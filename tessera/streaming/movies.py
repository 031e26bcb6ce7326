"""Streams of frames and of analog samples with Structured Streaming."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout


def frame_files(spark: SparkSession, path: str, schema: str, per_trigger: int = 1) -> DataFrame:
    """New Parquet files of frames as they arrive."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(path)


def timed(frames: DataFrame, at: str) -> DataFrame:
    """``frames`` with ``at`` as a timestamp that a watermark can be put on: one without a zone is taken in the session's."""
    return frames.withColumn(at, F.col(at).cast("timestamp"))


def binned_stream(frames: DataFrame, at: str = "ts", bin_size: str = "1 minute", late: str = "1 minute", keys: tuple[str, ...] = ("channel", "pixel_id")) -> DataFrame:
    """Means of tumbling windows, closed by a watermark."""
    w = F.window(at, bin_size)
    return timed(frames, at).withWatermark(at, late).groupBy(w, *keys).agg(F.avg("value").alias("value"), F.count("*").alias("n"))


def trial_sessions(events: DataFrame, at: str = "ts", gap: str = "30 seconds", late: str = "1 minute", key: str = "user_id") -> DataFrame:
    """Trials as sessions of events without a gap."""
    return timed(events, at).withWatermark(at, late).groupBy(F.session_window(at, gap), key).agg(F.count("*").alias("n"))


def ttl_edges_stream(samples: DataFrame, threshold: float, key: str = "channel") -> DataFrame:
    """``key, sample, edge`` of a stream of (key, sample, value): a median of three, then steps over a fixed threshold. The state of a key is its
    last two samples and the last median, so a batch joins on to the one before; samples of a key must come in order between batches."""

    def work(k: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        before, last, number, m_last = state.get if state.exists else (0.0, None, -1, None)  # sample before last, last sample, its number, its predecessor's median
        new = pd.concat(list(batches)).sort_values("sample")
        value, at = new["value"].to_numpy(np.float64), new["sample"].to_numpy(np.int64)
        seen = np.concatenate([[before] if last is None else [before, last], value])  # each sample but the newest has its median when the next arrives
        numbers = at if last is None else np.concatenate([[number], at])
        m = np.median(np.stack([seen[:-2], seen[1:-1], seen[2:]]), axis=0) if len(seen) > 2 else np.zeros(0)
        step = np.diff(np.concatenate([[np.nan if m_last is None else m_last], m]))
        edge = np.flatnonzero(np.abs(step) > threshold)  # the first median of all has none before it
        if len(value):
            state.update((float(seen[-2]), float(value[-1]), int(at[-1]), float(m[-1]) if len(m) else m_last))
        yield pd.DataFrame({key: [k[0]] * len(edge), "sample": numbers[edge], "edge": np.where(step[edge] > 0, 1, -1)})

    return samples.select(key, "sample", "value").groupBy(key).applyInPandasWithState(work, f"{key} int, sample long, edge int", "before double, last double, number long, m_last double", "append", GroupStateTimeout.NoTimeout)


def projected_frames(frames: DataFrame, u: np.ndarray, f0: np.ndarray) -> DataFrame:
    """``frame_id, channel, v``: frames, of a stream or a table, as dF/F on the components ``u`` (components x pixels); ``f0`` (channels x pixels)."""
    held = frames.sparkSession.sparkContext.broadcast((u, f0))

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        w, m = held.value
        for b in batches:
            if len(b):
                x = np.stack(b["pixels"].to_list()).astype(np.float64)
                base = m[b["channel"].to_numpy()]
                yield pd.DataFrame({"frame_id": b["frame_id"], "channel": b["channel"], "v": list(((x - base) / (base + 1e-10)) @ w.T)})

    return frames.select("frame_id", "channel", "pixels").mapInPandas(work, "frame_id long, channel int, v array<double>")


def project_stream(frames: DataFrame, u: np.ndarray, f0: np.ndarray, out: str, checkpoint: str):
    """Each batch of frames as dF/F projected on the components, appended as Parquet: the factor grows as frames arrive."""
    return projected_frames(frames, u, f0).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").start()


def job_states(events: DataFrame) -> DataFrame:
    """``job, state`` of transfer jobs from their events (job, at, event): the furthest state reached; a restart takes a transfer in flight back."""
    order = {"pending_transfer": 0, "in_transfer": 1, "uploaded": 2, "submitted": 3, "fetching_results": 4, "got_results": 5}
    rank = F.create_map(*[x for k, v in order.items() for x in (F.lit(k), F.lit(v))])
    names = F.create_map(*[x for k, v in order.items() for x in (F.lit(v), F.lit(k))])
    back = F.create_map(F.lit(1), F.lit(0), F.lit(4), F.lit(3))
    latest = events.groupBy("job").agg(F.max_by("event", "at").alias("event"), F.max(F.struct(F.element_at(rank, F.col("event")).alias("r")))["r"].alias("r"))
    r = F.when(F.col("event") == "restart", F.coalesce(F.element_at(back, F.col("r")), F.col("r"))).otherwise(F.col("r"))
    return latest.select("job", F.element_at(names, r).alias("state"))


def log_lines(spark: SparkSession, path: str, per_trigger: int = 100) -> DataFrame:
    """``file, line`` of job logs as they arrive: each file that appears in a folder, line by line. What a job appends goes to a new file."""
    rows = spark.readStream.schema("value string").option("maxFilesPerTrigger", per_trigger).text(path)
    return rows.select(F.col("_metadata.file_name").alias("file"), F.col("value").alias("line"))
