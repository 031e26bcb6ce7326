"""What raw movie file names say: ``_<channels>_<height>_<width>_<dtype>[_<number>].<bin or dat>``."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DTYPES = ("uint8", "int8", "uint16", "int16", "uint32", "int32", "float32", "float64")


def parse_name(name: str) -> tuple[int, int, int, str, list[int]]:
    """(channels, height, width, dtype, numbers after it): the left-most token that is a type counts, and the last three numbers before it."""
    tokens = re.sub(r"\.[^.]*$", "", name.rsplit("/", 1)[-1]).split("_")
    at = next((k for k, t in enumerate(tokens) if t in DTYPES), None)
    if at is None:
        raise ValueError(f"no type in {name}")
    numbers = [int(t) for t in tokens[:at] if t.isdigit()]
    if len(numbers) < 3:
        raise ValueError(f"no shape in {name}")
    return (*numbers[-3:], tokens[at], [int(t) for t in tokens[at + 1 :] if t.isdigit()])


def parsed_names(files: DataFrame, name: str = "name") -> DataFrame:
    """``channels, height, width, dtype, number`` beside each file name, with built-in functions; null where the name says nothing."""
    pattern = rf"_(\d+)_(\d+)_(\d+)_({'|'.join(DTYPES)})(?:_(\d+))?\.[^./]*$"
    got = lambda k: F.nullif(F.regexp_extract(name, pattern, k), F.lit(""))
    return files.select("*", got(1).cast("int").alias("channels"), got(2).cast("int").alias("height"), got(3).cast("int").alias("width"), got(4).alias("dtype"), got(5).cast("int").alias("number"))
