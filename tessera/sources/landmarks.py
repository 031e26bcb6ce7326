"""Landmark files: JSON with points of the atlas and of the image, and the transform between them."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

POINTS = "struct<color:array<string>,name:array<string>,x:array<double>,y:array<double>>"
SCHEMA = f"resolution double, bregma_offset array<bigint>, landmarks {POINTS}, landmarks_im {POINTS}, landmarks_match {POINTS}, transform array<array<double>>, transform_inverse array<array<double>>, transform_type string"
#: Fixed values of the format: the landmarks of the dorsal cortex in millimetres, the scale and the place of bregma in an image.
STANDARD = json.dumps({"resolution": 0.0194, "bregma_offset": [320, 270], "landmarks": {"name": ["OB_left", "OB_center", "OB_right", "RSP_base"], "x": [-1.95, 0.0, 1.95, 0.0], "y": [-3.45, -3.45, -3.45, 3.2], "color": ["#fc9d03", "#0367fc", "#fc9d03", "#fc4103"]}})


def read_landmarks(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SCHEMA).json(path, multiLine=True)


def read_text(spark: SparkSession, text: str) -> DataFrame:
    return spark.createDataFrame([(text,)], "t string").select(F.from_json("t", SCHEMA).alias("j")).select("j.*")


def points_of(landmarks: DataFrame, which: str) -> DataFrame:
    """``name, x, y, color`` of one set of points."""
    z = F.arrays_zip(F.col(f"{which}.name").alias("name"), F.col(f"{which}.x").alias("x"), F.col(f"{which}.y").alias("y"), F.col(f"{which}.color").alias("color"))
    return landmarks.select(F.explode(z).alias("p")).select("p.name", "p.x", "p.y", "p.color")


def write_landmarks(landmarks: DataFrame, path: str) -> None:
    """The same fields as JSON, both directions of the transform and its type among them."""
    landmarks.coalesce(1).write.mode("overwrite").json(path)  # one row
