"""Functions of array columns: products by element, and maps of whole batches as matrices."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: str, b: str) -> Column:
    """The sum of the products of two arrays' elements, within the JVM."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0).cast("double"), lambda s, x: s + x)


def unit(c: Column) -> Column:
    """Held to 0..1."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))


def stacked(arrays: pd.Series) -> np.ndarray:
    return np.stack(arrays.to_list()).astype(np.float64)


def mapped(column: str | Column, f: Callable[[np.ndarray], np.ndarray], kind: str = "double") -> Column:
    """``f`` of the rows x rank matrix of an array column, a batch at a time: a number for each row, or an array with ``kind`` array<double>."""

    @F.pandas_udf(kind)
    def work(arrays: pd.Series) -> pd.Series:
        out = f(stacked(arrays)) if len(arrays) else np.zeros(0)
        return pd.Series(list(out) if out.ndim > 1 else out)

    return work(column)


def quadratic(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """x^T C x of each row."""
    return ((x @ c) * x).sum(1)
