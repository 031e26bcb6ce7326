"""Zero-phase filtering of component series: a sequential recursion, so one Arrow group a component."""

from __future__ import annotations

import functools
import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame


def butter2(cut: float, fs: float, high: bool) -> tuple[np.ndarray, np.ndarray]:
    """Second-order Butterworth coefficients (b, a) by the bilinear transform."""
    k = math.tan(math.pi * cut / fs)
    n = 1 / (1 + math.sqrt(2) * k + k * k)
    b = n * np.array([1.0, -2.0, 1.0]) if high else n * k * k * np.array([1.0, 2.0, 1.0])
    return b, np.array([1.0, 2 * n * (k * k - 1), n * (1 - math.sqrt(2) * k + k * k)])


@functools.lru_cache(maxsize=32)
def block_response(b: tuple[float, ...], a: tuple[float, ...], n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """What a block of n samples and the state before it give: outputs by samples (n, n) and by state (2, n), the state after it by samples (n, 2)
    and by state (2, 2). Each row is the answer to one unit sample or unit state."""
    x = np.eye(n + 2, n)
    z0, z1 = np.zeros(n + 2), np.zeros(n + 2)
    z0[n], z1[n + 1] = 1, 1
    out = np.empty((n + 2, n))
    for k in range(n):
        v = x[:, k].copy()
        v[n:] = 0
        out[:, k] = b[0] * v + z0
        z0, z1 = b[1] * v - a[1] * out[:, k] + z1, b[2] * v - a[2] * out[:, k]
    after = np.stack([z0, z1], 1)
    return out[:n], out[n:], after[:n], after[n:]


def recursion(b: np.ndarray, a: np.ndarray, x: np.ndarray, block: int = 256) -> np.ndarray:
    """The filter run once over the last axis, from the steady state of the first sample. The recursion is linear, so it goes on from block to block
    by four matrices, all series at once."""
    # the state of a constant input of one: z = A z + B
    m = np.array([[1 + a[1], -1.0], [a[2], 1.0]])
    z = np.linalg.solve(m, np.array([b[1] - a[1] * b[0], b[2] - a[2] * b[0]]))
    state = x[..., :1] * z
    out = np.empty(x.shape)
    for k in range(0, x.shape[-1], block):
        v = x[..., k : k + block]
        by_sample, by_state, next_sample, next_state = block_response(tuple(map(float, b)), tuple(map(float, a)), v.shape[-1])
        out[..., k : k + block] = v @ by_sample + state @ by_state
        state = v @ next_sample + state @ next_state
    return out


def filtfilt(x: np.ndarray, cut: float, fs: float, high: bool, pad: int = 50) -> np.ndarray:
    """Forward and backward over the last axis, with ``pad`` samples of odd extension at each end; longer series than that are needed."""
    if x.shape[-1] <= pad:
        raise ValueError(f"a series of {x.shape[-1]} samples is too short for {pad} of padding")
    b, a = butter2(cut, fs, high)
    left = 2 * x[..., :1] - x[..., pad:0:-1]
    right = 2 * x[..., -1:] - x[..., -2 : -pad - 2 : -1]
    y = recursion(b, a, np.concatenate([left, x, right], -1))
    return recursion(b, a, y[..., ::-1])[..., ::-1][..., pad:-pad]


def filtered(series: DataFrame, cut: float, fs: float, high: bool, key: str = "component") -> DataFrame:
    """``key, t, value``: each series (key, t, value) filtered; a group is one component, of which there are as many as the rank."""

    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("t")
        return pd.DataFrame({key: pdf[key], "t": pdf["t"], "value": filtfilt(pdf["value"].to_numpy(np.float64), cut, fs, high)})

    return series.select(key, "t", "value").groupBy(key).applyInPandas(work, f"{key} int, t long, value double")


def lowpass(series: DataFrame, cut: float = 7.5, fs: float = 30.0) -> DataFrame:
    return filtered(series, cut, fs, high=False)


def highpass(series: DataFrame, cut: float = 3.0, fs: float = 30.0) -> DataFrame:
    return filtered(series, cut, fs, high=True)
