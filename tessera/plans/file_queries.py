"""Sources, sinks and streams on the driver's tables: what is written to files is read back, and must be the rows that SQL finds in the tables."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

import numpy as np
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from tessera.operators import frames as fr
from tessera.plans.queries import MEAN_MAP, r, rounded
from tessera.plans.registry import query
from tessera.sources import adapters as ad
from tessera.sources import raw
from tessera.sources.adapters import MOVIE, SIDE, SPATIAL
from tessera.streaming import movies


def scratch(spark: SparkSession) -> str:
    """A new folder that all executors share: in the one that spark.checkpoint.dir names, or on the only machine there is."""
    sc = spark.sparkContext
    shared = sc.getConf().get("spark.checkpoint.dir")
    if not shared and not re.fullmatch(r"local(\[.*\])?", sc.master):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if not shared:
        shared = tempfile.mkdtemp(prefix="tessera-files-")
        atexit.register(shutil.rmtree, shared, True)
    return f"{shared.rstrip('/')}/{uuid.uuid4().hex}"


def sized(spark: SparkSession, d: str):
    return ad.frames(spark, d).select("frame_id", "channel", F.lit(SIDE).alias("h"), F.lit(SIDE).alias("w"), "pixels")


STORED = f"WITH {MOVIE} SELECT frame_id, channel, pixel_id, greatest(0, least(65535, floor(value)))::DOUBLE AS value FROM movie"


@query("raw_round_trip", STORED)
def _(spark, d):
    """The movie as raw files of 16-bit numbers, a few hundred frames each, read back as one."""
    at = scratch(spark)
    raw.write_raw(sized(spark, d), at, chunk=200)
    return ad.long_layout(raw.read_movie(spark, at), SIDE).select("frame_id", "channel", "pixel_id", F.col("value").cast("double").alias("value"))


@query("raw_frame_range", f"{STORED} WHERE frame_id >= 40 AND frame_id < 60 AND channel = 1")
def _(spark, d):
    """A range of frames, pruned before anything is read."""
    at = scratch(spark)
    raw.write_raw(sized(spark, d), at, chunk=64)
    some = raw.read_raw(spark, at, blocksize=16).filter("frame_id >= 40 and frame_id < 60 and channel = 1")
    return ad.long_layout(some, SIDE).select("frame_id", "channel", "pixel_id", F.col("value").cast("double").alias("value"))


@query("tiff_round_trip", STORED)
def _(spark, d):
    at = scratch(spark)
    raw.write_tiffs(sized(spark, d), at, chunk=200)
    return ad.long_layout(raw.read_movie(spark, at), SIDE).select("frame_id", "channel", "pixel_id", F.col("value").cast("double").alias("value"))


@query("npy_round_trip", f"WITH {MOVIE} SELECT (frame_id * 2 + channel) * 64 + pixel_id AS position, {r('value')} AS value FROM movie")
def _(spark, d):
    """The frames as one array of frames x pixels."""
    at = f"{scratch(spark)}/frames.npy"
    rows = sized(spark, d).select((F.col("frame_id") * 2 + F.col("channel")).alias("t"), "pixels")
    raw.write_npy(rows, at, "t", "pixels", (rows.count(), SIDE * SIDE), dtype="float64")
    return rounded(raw.read_npy(spark, at).select("position", "value"), "value")


def ended(writer, name: str, at: str):
    """Run a stream over all that there is, and the rows that it has written as Parquet."""
    q = writer.queryName(f"{name}_{uuid.uuid4().hex}").option("checkpointLocation", f"{at}/checkpoint").trigger(availableNow=True).format("parquet").option("path", f"{at}/out").start()
    q.awaitTermination()
    if q.exception() is not None:
        raise q.exception()


@query("stream_time_bins", "WITH w AS (SELECT event_type, time_bucket(INTERVAL 1 HOUR, ts) AS start, value, max(ts) OVER () AS newest FROM events) SELECT event_type, strftime(start, '%Y-%m-%d %H:%M:%S') AS start, round(avg(value), 6) + 0.0 AS value, count(*) AS n FROM w WHERE start + INTERVAL 1 HOUR <= newest - INTERVAL 1 MINUTE GROUP BY event_type, start")
def _(spark, d):
    """Hourly means of the events as a stream: the windows that the watermark has closed, once all events are in."""
    at = scratch(spark)
    events = ad.table(spark, d, "events")
    events.write.parquet(f"{at}/in")  # a stream of files reads folders only
    rows = movies.frame_files(spark, f"{at}/in", events.schema, per_trigger=100)
    done = movies.binned_stream(rows, bin_size="1 hour", keys=("event_type",))
    ended(done.select("event_type", F.date_format("window.start", "yyyy-MM-dd HH:mm:ss").alias("start"), "value", "n").writeStream.outputMode("append"), "bins", at)
    return rounded(spark.read.parquet(f"{at}/out"), "value")


@query("stream_projection", f"""WITH {MOVIE}, {MEAN_MAP}, {SPATIAL}, u AS (SELECT k, pixel_id, u FROM spatial WHERE k < 5), x AS (SELECT frame_id, channel, pixel_id, (value - f0) / (f0 + 1e-10) AS value FROM movie JOIN f0 USING (channel, pixel_id))
 SELECT frame_id, channel, k AS component, {r('sum(u * value)')} AS value FROM x JOIN u USING (pixel_id) GROUP BY ALL""")
def _(spark, d):
    """Frames as a stream of files, each batch projected on five components as it arrives."""
    at = scratch(spark)
    ad.frames(spark, d).write.parquet(f"{at}/in")
    f0 = {(x["channel"], x["pixel_id"]): x["f0"] for x in fr.mean_map(ad.movie(spark, d)).collect()}  # a frame a channel
    base = np.array([[f0[c, p] for p in range(SIDE * SIDE)] for c in (0, 1)]) if f0 else np.zeros((2, SIDE * SIDE))
    u = np.array([x["u"][:5] for x in ad.spatial(spark).orderBy("pixel_id").collect()]).T
    rows = spark.readStream.schema("frame_id long, channel int, pixels array<double>").parquet(f"{at}/in")
    ended(movies.projected_frames(rows, u, base).writeStream.outputMode("append"), "projection", at)
    return rounded(spark.read.parquet(f"{at}/out").select("frame_id", "channel", F.posexplode("v").alias("component", "value")), "value")
