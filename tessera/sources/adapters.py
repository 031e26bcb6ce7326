"""The driver's tables read as image time series, and the SQL of the same views."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Side of the square frames that the vectors are read as, components of the factor views, frames of a trial.
SIDE, RANK, TRIAL = 8, 64, 25
STEP = math.pi / SIDE**2


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``frame_id, channel, pixels``: one row for each frame and channel, flattened row by row."""
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.expr("vec_id div 2").alias("frame_id"), F.expr("int(vec_id % 2)").alias("channel"), F.transform("embedding", lambda v: F.lit(1000.0) + F.lit(100.0) * v.cast("double")).alias("pixels"))


def movie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``frame_id, channel, pixel_id, y, x, value``: the long layout."""
    return long_layout(frames(spark, sf_dir), SIDE)


def long_layout(rows: DataFrame, width: int) -> DataFrame:
    """Frames as one row for each pixel."""
    each = rows.select(*[c for c in rows.columns if c != "pixels"], F.posexplode("pixels").alias("pixel_id", "value"))
    return each.withColumn("y", F.expr(f"pixel_id div {width}").cast("int")).withColumn("x", (F.col("pixel_id") % width).cast("int"))


def frame_layout(pixels: DataFrame) -> DataFrame:
    """Pixels as one row for each frame and channel."""
    sorted_pixels = F.array_sort(F.collect_list(F.struct("pixel_id", "value")))
    return pixels.groupBy("frame_id", "channel").agg(F.transform(sorted_pixels, lambda s: s["value"]).alias("pixels"))


def temporal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``t, frame_id, channel, v``: RANK temporal components, channels interleaved in time."""
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").alias("t"), F.expr("vec_id div 2").alias("frame_id"), F.expr("int(vec_id % 2)").alias("channel"), F.transform(F.slice("embedding", 1, RANK), lambda v: v.cast("double")).alias("v"))


def spatial(spark: SparkSession) -> DataFrame:
    """``pixel_id, y, x, u``: RANK spatial components of a SIDE x SIDE frame, cosines that are orthogonal over its pixels."""
    p = spark.range(SIDE * SIDE).select(F.col("id").cast("int").alias("pixel_id"))
    u = F.array(*[F.cos(F.lit(STEP) * k * (F.col("pixel_id").cast("double") + 0.5)) for k in range(RANK)])
    return p.select("pixel_id", F.expr(f"int(pixel_id div {SIDE})").alias("y"), (F.col("pixel_id") % SIDE).cast("int").alias("x"), u.alias("u"))


def trials(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``trial_id, onset_frame, stim_frame``: an onset every TRIAL frames, from the fifth frame on."""
    e = table(spark, sf_dir, "embeddings").select(F.expr("vec_id div 2").alias("f")).distinct()
    on = e.filter(F.col("f") % TRIAL == 5)
    return on.select(F.expr(f"int(f div {TRIAL})").alias("trial_id"), F.col("f").alias("onset_frame"), (F.col("f") + 3).alias("stim_frame"))


def series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``channel, sample, value``: analog traces, one for each hundredth of the users of events, sampled in event order."""
    e = table(spark, sf_dir, "events")
    return e.select((F.col("user_id") % 100).cast("int").alias("channel"), F.col("event_id").alias("sample"), "value")


def pixel_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``frame_id, pixel_id, value``: a large irregular pixel load from lineitem."""
    li = table(spark, sf_dir, "lineitem")
    return li.select(F.datediff("l_shipdate", F.lit("1992-01-01")).cast("long").alias("frame_id"), (F.col("l_partkey") % 4096).cast("int").alias("pixel_id"), F.col("l_extendedprice").alias("value"))


MOVIE = f"""movie AS (SELECT vec_id // 2 AS frame_id, CAST(vec_id % 2 AS INTEGER) AS channel, CAST(p AS INTEGER) AS pixel_id, CAST(p // {SIDE} AS INTEGER) AS y,
 CAST(p % {SIDE} AS INTEGER) AS x, 1000.0::DOUBLE + 100.0::DOUBLE * v::DOUBLE AS value FROM (SELECT vec_id, unnest(range(len(embedding))) AS p, unnest(embedding) AS v FROM embeddings))"""
SPATIAL = f"spatial AS (SELECT CAST(p AS INTEGER) AS pixel_id, CAST(p // {SIDE} AS INTEGER) AS y, CAST(p % {SIDE} AS INTEGER) AS x, CAST(k AS INTEGER) AS k, cos({STEP}::DOUBLE * k * (p::DOUBLE + 0.5::DOUBLE)) AS u FROM range({SIDE * SIDE}) a(p), range({RANK}) b(k))"
TEMPORAL = f"temporal AS (SELECT vec_id AS t, vec_id // 2 AS frame_id, CAST(vec_id % 2 AS INTEGER) AS channel, CAST(k AS INTEGER) AS k, embedding[k + 1]::DOUBLE AS v FROM embeddings, range({RANK}) b(k))"
RECONSTRUCTED = f"{SPATIAL}, {TEMPORAL}, full_movie AS (SELECT t, frame_id, channel, pixel_id, any_value(y) AS y, any_value(x) AS x, sum(u * v) AS value FROM spatial JOIN temporal USING (k) GROUP BY t, frame_id, channel, pixel_id)"
TRIALS = f"trials AS (SELECT DISTINCT CAST((vec_id // 2) // {TRIAL} AS INTEGER) AS trial_id, vec_id // 2 AS onset_frame, vec_id // 2 + 3 AS stim_frame FROM embeddings WHERE (vec_id // 2) % {TRIAL} = 5)"
SERIES = "series AS (SELECT CAST(user_id % 100 AS INTEGER) AS channel, event_id AS sample, value FROM events)"
