"""Products of array columns at any rank, summed over rows in one pass as matrix products of Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.arrays import stacked


@dataclass(frozen=True)
class Comoments:
    """Of ``n`` rows with arrays a and b: their means, and ``c``, the sum of the outer products of their deviations. rank(a) x rank(b) numbers."""

    n: int
    mean_a: np.ndarray
    mean_b: np.ndarray
    c: np.ndarray

    @property
    def products(self) -> np.ndarray:
        """The sum of the outer products of the arrays themselves."""
        return self.c + self.n * np.outer(self.mean_a, self.mean_b)

    def covariance(self, sample: bool = True) -> np.ndarray:
        """NaN where there are too few rows."""
        rows = self.n - 1 if sample else self.n
        return self.c / rows if rows > 0 else np.full_like(self.c, np.nan)


def comoments(rows: DataFrame, a: str, b: str) -> Comoments:
    """One pass over ``rows``; rows with a null array are left out.

    A partition gives a matrix, dealt out by its rows, so that what is added up for one row of the result is a vector for each partition,
    whatever the rank and the number of rows. Deviations are taken from each partition's own means, which keeps large means from cancelling."""
    schema = "i int, n long, ma double, mb array<double>, c array<double>"

    def merged(n: np.ndarray, ma: np.ndarray, mb: np.ndarray, c: np.ndarray) -> tuple[int, np.ndarray, np.ndarray, np.ndarray]:
        """Of parts along the first axis: ma (parts, rows), mb (parts, columns), c (parts, rows, columns)."""
        total = int(n.sum())
        mean_a, mean_b = n @ ma / total, n @ mb / total
        return total, mean_a, mean_b, c.sum(0) + (n[:, None] * (ma - mean_a)).T @ (mb - mean_b)

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        state = None
        for batch in batches:
            if len(batch):
                x, y = stacked(batch["a"]), stacked(batch["b"])
                own = (len(x), x.mean(0), y.mean(0), (x - x.mean(0)).T @ (y - y.mean(0)))
                state = own if state is None else merged(*(np.stack([s, o]) for s, o in zip(state, own, strict=True)))
        if state is not None:
            n, ma, mb, c = state
            yield pd.DataFrame({"i": np.arange(len(ma)), "n": n, "ma": ma, "mb": [mb] * len(ma), "c": list(c)})

    def whole(pdf: pd.DataFrame) -> pd.DataFrame:
        n, ma, mb, c = merged(pdf["n"].to_numpy(np.float64), pdf["ma"].to_numpy()[:, None], stacked(pdf["mb"]), stacked(pdf["c"])[:, None, :])
        return pd.DataFrame({"i": pdf["i"].iloc[:1], "n": n, "ma": ma, "mb": [mb], "c": [c[0]]})

    pairs = rows.select(F.col(a).cast("array<double>").alias("a"), F.col(b).cast("array<double>").alias("b")).filter("a is not null and b is not null")
    got = pairs.mapInPandas(partial, schema).groupBy("i").applyInPandas(whole, schema).orderBy("i").collect()  # a row for each component
    if not got:
        return Comoments(0, np.zeros(0), np.zeros(0), np.zeros((0, 0)))
    return Comoments(int(got[0]["n"]), np.array([r["ma"] for r in got]), np.array(got[0]["mb"]), np.array([r["c"] for r in got]))


def mean_array(rows: DataFrame, column: str) -> DataFrame:
    """One row, ``mu``: the mean array of a column."""
    each = rows.select(F.posexplode(column).alias("k", "v")).groupBy("k").agg(F.avg("v").alias("v"))
    return each.agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "v"))), lambda s: s["v"]).alias("mu"))
