"""Atlases: areas flattened from a label volume, their contours, and the raster that a landmarks transform puts on an image.

An atlas is one image with a few dozen areas, so these work on whole images, one an area."""

from __future__ import annotations

import gzip
import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.operators import geometry, morphology
from tessera.sources import raw, store

REGION_SCHEMA = "acronym string, name string, reference array<int>, resolution double, label int, allen_id bigint, allen_rgb array<int>, left_center array<double>, right_center array<double>, left_x array<double>, left_y array<double>, right_x array<double>, right_y array<double>"


def contours_of(regions: DataFrame) -> DataFrame:
    """``region_id, side, vertex, x, y`` of regions (region_id, left_x, left_y, right_x, right_y)."""
    side = lambda s: regions.select("region_id", F.lit(s).alias("side"), F.posexplode(F.arrays_zip(F.col(f"{s}_x").alias("x"), F.col(f"{s}_y").alias("y"))).alias("vertex", "p")).select("region_id", "side", "vertex", "p.x", "p.y")
    return side("left").unionByName(side("right"))


def region_masks(contours: DataFrame, height: int, width: int) -> DataFrame:
    """``region_id, side, pixel_id`` of the filled contours (region_id, side, vertex, x, y), one group a contour."""

    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("vertex")
        m = morphology.contour_mask(pdf["y"].to_numpy(float), pdf["x"].to_numpy(float), height, width)
        at = np.flatnonzero(m)
        return pd.DataFrame({"region_id": int(pdf["region_id"].iloc[0]), "side": pdf["side"].iloc[0], "pixel_id": at})

    return contours.groupBy("region_id", "side").applyInPandas(work, "region_id int, side string, pixel_id int")


def atlas_of(regions: DataFrame, height: int = 540, width: int = 640, m: tuple[float, ...] | None = None, resolution: float = 1.0, bregma: tuple[float, float] = (0.0, 0.0)) -> DataFrame:
    """``pixel_id, area_id``: regions' contours put into image space by the landmarks' scale, place and transform, filled and painted in order."""
    placed = geometry.transform_regions(contours_of(regions), m, resolution, bregma)
    return geometry.paint_atlas(region_masks(placed, height, width))


def area_names(regions: DataFrame) -> DataFrame:
    """``area_id, name``: positive and left, negative and right."""
    left = regions.select((F.col("region_id") + 1).alias("area_id"), F.concat("acronym", F.lit("_left")).alias("name"))
    return left.unionByName(regions.select((-F.col("region_id") - 1).alias("area_id"), F.concat("acronym", F.lit("_right")).alias("name")))


def flatten_areas(projection: DataFrame, height: int, width: int, reference: tuple[float, float], resolution: float) -> DataFrame:
    """``label, left_x, left_y, right_x, right_y, left_center, right_center`` in millimetres from a top projection (i, j, label).

    Of each label's left half the largest connected region counts; its outline is mirrored to the right."""
    half = projection.filter((F.col("j") < width // 2) & (F.col("label") > 0))
    s = resolution / 1000

    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        m = np.zeros((height, width), int)
        m[pdf["i"], pdf["j"]] = 1
        m = morphology.largest_regions(m) > 0
        edge = morphology.outline(m)
        y, x = np.nonzero(m)
        mm = lambda v, k: ((np.asarray(v, float) - reference[k]) * s)
        lx, ly = mm(edge[:, 1], 0), mm(edge[:, 0], 1)
        c = [float(mm(x.mean(), 0)), float(mm(y.mean(), 1))]
        return pd.DataFrame({"label": [int(pdf["label"].iloc[0])], "left_x": [lx], "left_y": [ly], "right_x": [-lx], "right_y": [ly], "left_center": [c], "right_center": [[-c[0], c[1]]]})

    return half.groupBy("label").applyInPandas(work, "label int, left_x array<double>, left_y array<double>, right_x array<double>, right_y array<double>, left_center array<double>, right_center array<double>")


def projection_outline(projection: DataFrame, height: int, width: int, reference: tuple[float, float], resolution: float, closing: int = 10) -> DataFrame:
    """``vertex, x, y`` in millimetres: the outline of all that is labelled, closed over gaps, filled and widened."""
    one = projection.filter("label > 0").agg(F.collect_list("i").alias("i"), F.collect_list("j").alias("j"))  # one image

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for i, j in zip(b["i"], b["j"], strict=True):
                m = np.zeros((height + 2 * closing, width + 2 * closing), bool)
                m[np.asarray(i, int) + closing, np.asarray(j, int) + closing] = True
                for _ in range(closing // 2):
                    m = morphology.dilate(m)
                m = morphology.fill_holes(m)
                for _ in range(closing // 2):
                    m = morphology.erode(m)
                e = morphology.outline(morphology.dilate(m)) - closing
                yield pd.DataFrame({"vertex": np.arange(len(e)), "x": (e[:, 1] - reference[0]) * resolution / 1000, "y": (e[:, 0] - reference[1]) * resolution / 1000})

    return one.mapInPandas(work, "vertex int, x double, y double")


def reference_regions(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The regions of a reference, from ``<name>_ccf_labels.json``, in file order as ``region_id``."""
    rows = spark.read.schema(REGION_SCHEMA).json(f"{folder}/{name}_ccf_labels.json", multiLine=True).withColumn("k", F.monotonically_increasing_id())
    return rows.withColumn("region_id", (F.row_number().over(Window.orderBy("k")) - 1).cast("int")).drop("k")  # a row a region


def load_reference(spark: SparkSession, folder: str, name: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(regions; projection ``i, j, label``; outline ``vertex, x, y``) of a reference's three files."""
    grid = raw.read_npy(spark, f"{folder}/{name}_projection.npy")
    projection = grid.select(F.expr("position div shape[1]").cast("int").alias("i"), (F.col("position") % F.col("shape")[1]).cast("int").alias("j"), F.col("value").cast("int").alias("label"))
    line = raw.read_npy(spark, f"{folder}/{name}_outline.npy")
    outline = line.groupBy(F.expr("position div 2").cast("int").alias("vertex")).agg(F.max(F.when(F.col("position") % 2 == 0, F.col("value"))).alias("x"), F.max(F.when(F.col("position") % 2 == 1, F.col("value"))).alias("y"))
    return reference_regions(spark, folder, name), projection, outline


def save_reference(regions: DataFrame, projection: DataFrame, outline: DataFrame, folder: str, name: str) -> None:
    """The three files of a reference: regions in the order of ``region_id`` as one JSON array, projection and outline as .npy. An atlas has a few
    dozen regions."""
    fields = [c for c in regions.columns if c != "region_id"]
    rows = [json.loads(r["j"]) for r in regions.select("region_id", F.to_json(F.struct(*fields)).alias("j")).orderBy("region_id").collect()]
    with store.Replacing(f"{folder}/{name}_ccf_labels.json") as f:
        f.write(json.dumps(rows).encode())
    h, w = projection.agg(F.max("i") + 1, F.max("j") + 1).first()
    raw.write_npy(projection.select(F.struct("i", "j").alias("at"), "label"), f"{folder}/{name}_projection.npy", "at", "label", (h, w), dtype="int32")
    raw.write_npy(outline.select("vertex", F.array("x", "y").alias("p")), f"{folder}/{name}_outline.npy", "vertex", "p", (outline.count(), 2), dtype="float64")


def read_volume(spark: SparkSession, path: str) -> DataFrame:
    """``i, z, j, label`` of an annotation volume: a .npy array of three axes, or an NRRD file with raw or gzip encoding."""
    if path.endswith(".npy"):
        cells = raw.read_npy(spark, path)
    else:
        def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                for content in b["content"]:
                    x = nrrd(content)
                    for k in range(0, x.size, 1 << 20):
                        part = x.ravel()[k : k + (1 << 20)]
                        yield pd.DataFrame({"shape": [list(x.shape)] * len(part), "position": np.arange(k, k + len(part)), "value": part.astype(np.float64)})

        cells = spark.read.format("binaryFile").load(path).select("content").mapInPandas(work, "shape array<long>, position long, value double")
    return cells.select(F.expr("position div (shape[1] * shape[2])").cast("int").alias("i"), F.expr("(position div shape[2]) % shape[1]").cast("int").alias("z"), F.expr("position % shape[2]").cast("int").alias("j"), F.col("value").cast("long").alias("label"))


def nrrd(content: bytes) -> np.ndarray:
    """The array of an NRRD file: axes from the fastest on, as the format has them."""
    head, body = content.split(b"\n\n", 1)
    fields = dict(x.split(": ", 1) for x in head.decode("ascii", "replace").splitlines()[1:] if ": " in x and not x.startswith("#"))
    kinds = {"uchar": "u1", "uint8": "u1", "short": "i2", "int16": "i2", "ushort": "u2", "uint16": "u2", "unsigned short": "u2", "int": "i4", "int32": "i4", "uint": "u4", "uint32": "u4", "unsigned int": "u4", "float": "f4", "double": "f8"}
    raw_bytes = {"raw": lambda x: x, "gzip": gzip.decompress, "gz": gzip.decompress}[fields["encoding"].strip()](body)
    kind = np.dtype(kinds[fields["type"].strip()]).newbyteorder(">" if fields.get("endian", "little").strip() == "big" else "<")
    return np.frombuffer(raw_bytes, kind).reshape([int(n) for n in fields["sizes"].split()], order="F")
