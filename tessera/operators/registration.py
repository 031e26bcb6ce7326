"""Motion registration: frames are registered where they stand, against a broadcast template of one frame a channel."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.arrays import stacked


def sampled(im: np.ndarray, y: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The image at (y, x), bilinear; zero outside."""
    h, w = im.shape
    y0, x0 = np.floor(y).astype(int), np.floor(x).astype(int)
    fy, fx = y - y0, x - x0
    out = np.zeros(y.shape)
    for i in (0, 1):
        for j in (0, 1):
            ok = (y0 + i >= 0) & (y0 + i < h) & (x0 + j >= 0) & (x0 + j < w)
            out[ok] += ((fy if i else 1 - fy) * (fx if j else 1 - fx))[ok] * im[(y0 + i)[ok], (x0 + j)[ok]]
    return out


def shift_image(im: np.ndarray, dy: float, dx: float, rot_deg: float = 0.0) -> np.ndarray:
    """out(y, x) = im at (y + dy, x + dx), turned about the centre, bilinear; zero outside."""
    h, w = im.shape
    y, x = np.mgrid[0:h, 0:w].astype(np.float64)
    if rot_deg:
        c, s = np.cos(np.radians(rot_deg)), np.sin(np.radians(rot_deg))
        cy, cx = (h - 1) / 2, (w - 1) / 2
        y, x = cy + s * (x - cx) + c * (y - cy), cx + c * (x - cx) - s * (y - cy)
    return sampled(im, y + dy, x + dx)


def warp_image(im: np.ndarray, m: np.ndarray) -> np.ndarray:
    """out(x, y) = im at M (x, y, 1), bilinear; zero outside."""
    h, w = im.shape
    y, x = np.mgrid[0:h, 0:w].astype(np.float64)
    at = np.tensordot(m, np.stack([x, y, np.ones_like(x)]), 1)
    return sampled(im, at[1] / at[2], at[0] / at[2])


def shift_images(stack: np.ndarray, dy: np.ndarray, dx: np.ndarray) -> np.ndarray:
    """Each image (n, h, w) by its own shift, as ``shift_image`` does without a turn."""
    _, h, w = stack.shape
    y, x = np.arange(h) + dy[:, None], np.arange(w) + dx[:, None]
    y0, x0 = np.floor(y).astype(int), np.floor(x).astype(int)
    fy, fx = y - y0, x - x0
    out, each = np.zeros(stack.shape), np.arange(len(stack))[:, None, None]
    for i in (0, 1):
        for j in (0, 1):
            yi, xj = y0 + i, x0 + j
            ok = ((yi >= 0) & (yi < h))[:, :, None] & ((xj >= 0) & (xj < w))[:, None, :]
            weight = (fy if i else 1 - fy)[:, :, None] * (fx if j else 1 - fx)[:, None, :]
            out += np.where(ok, weight * stack[each, np.clip(yi, 0, h - 1)[:, :, None], np.clip(xj, 0, w - 1)[:, None, :]], 0)
    return out


def phase_shifts(template: np.ndarray, stack: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(dy, dx) by which each image's content (n, h, w) is moved against the template: the peak of the phase correlation, by the weighted centre of
    its neighbourhood."""
    n, h, w = stack.shape
    win = np.outer(np.hanning(h), np.hanning(w))
    f = np.fft.fft2((stack - stack.mean((1, 2), keepdims=True)) * win) * np.conj(np.fft.fft2((template - template.mean()) * win))
    r = np.fft.ifft2(f / np.maximum(np.abs(f), 1e-12)).real
    py, px = np.divmod(r.reshape(n, -1).argmax(1), w)
    near_by = np.arange(-1, 2)
    ys, xs = (py[:, None] + near_by) % h, (px[:, None] + near_by) % w
    near = np.maximum(r[np.arange(n)[:, None, None], ys[:, :, None], xs[:, None, :]], 0)
    near = near - near.min((1, 2), keepdims=True)
    total = np.maximum(near.sum((1, 2)), 1e-12)
    dy, dx = py + near.sum(2) @ near_by / total, px + near.sum(1) @ near_by / total
    return dy - h * (dy > h / 2), dx - w * (dx > w / 2)


def phase_shift(template: np.ndarray, im: np.ndarray) -> tuple[float, float]:
    """``phase_shifts`` of one image."""
    dy, dx = phase_shifts(template, im[None])
    return float(dy[0]), float(dx[0])


def ecc(template: np.ndarray, im: np.ndarray, steps: int = 100, eps: float = 1e-6) -> tuple[float, float, float]:
    """(dy, dx, rotation in degrees) that registers the image to the template: Gauss-Newton on the enhanced correlation of windowed images."""
    h, w = template.shape
    win = np.outer(np.hanning(h), np.hanning(w))
    t = (template - (template * win).sum() / win.sum()) * win
    t = t / max(float(np.sqrt((t * t).sum())), 1e-12)
    dy, dx = phase_shift(template, im)
    rot, last = 0.0, -1.0
    y, x = np.mgrid[0:h, 0:w] - np.array([(h - 1) / 2, (w - 1) / 2])[:, None, None]
    for _ in range(steps):
        m = shift_image(im, dy, dx, rot)
        gy, gx = np.gradient(m)
        m = (m - (m * win).sum() / win.sum()) * win
        norm = max(float(np.sqrt((m * m).sum())), 1e-12)
        rho = float((m * t).sum()) / norm
        if abs(rho - last) < eps:
            break
        last = rho
        jac = np.stack([(gy * win).ravel(), (gx * win).ravel(), ((gy * x - gx * y) * win).ravel() * np.pi / 180], 1)
        step = np.linalg.lstsq(jac, (t * norm / max(rho, 1e-6) - m).ravel(), rcond=None)[0]
        dy, dx, rot = dy + step[0], dx + step[1], rot + step[2]
    return float(dy), float(dx), float(rot)


def ecc_matrix(template: np.ndarray, im: np.ndarray, model: str = "affine", steps: int = 100, eps: float = 1e-6) -> np.ndarray:
    """The 3 x 3 matrix, ``affine`` or ``homography``, by which ``warp_image`` brings the image to the template: Gauss-Newton on the enhanced
    correlation of windowed images, in coordinates of -1 to 1 about the centre, from the phase correlation's shift on. The best step counts."""
    h, w = template.shape
    win = np.outer(np.hanning(h), np.hanning(w))
    t = (template - (template * win).sum() / win.sum()) * win
    t = t / max(float(np.sqrt((t * t).sum())), 1e-12)
    scale, cy, cx = max(h, w) / 2, (h - 1) / 2, (w - 1) / 2
    to_unit = np.array([[1 / scale, 0, -cx / scale], [0, 1 / scale, -cy / scale], [0, 0, 1.0]])
    back = np.linalg.inv(to_unit)
    y, x = (np.mgrid[0:h, 0:w] - np.array([cy, cx])[:, None, None]) / scale
    one = np.ones_like(x)
    dy, dx = phase_shift(template, im)
    m = np.array([[1, 0, dx / scale], [0, 1, dy / scale], [0, 0, 1.0]])
    best, best_rho, last = m, -1.0, -1.0
    grad = np.gradient(im.astype(np.float64))
    for _ in range(steps):
        at = np.tensordot(m, np.stack([x, y, one]), 1)
        d = at[2]
        px, py = at[0] / d, at[1] / d
        iy, ix = py * scale + cy, px * scale + cx
        v = sampled(im, iy, ix)
        gy, gx = sampled(grad[0], iy, ix) * scale * win / d, sampled(grad[1], iy, ix) * scale * win / d
        v = (v - (v * win).sum() / win.sum()) * win
        norm = max(float(np.sqrt((v * v).sum())), 1e-12)
        rho = float((v * t).sum()) / norm
        if rho > best_rho:
            best, best_rho = m, rho
        if abs(rho - last) < eps:
            break
        last = rho
        parts = [gx * x, gx * y, gx, gy * x, gy * y, gy]
        if model == "homography":
            fall = -(gx * px + gy * py)
            parts += [fall * x, fall * y]
        step = np.linalg.lstsq(np.stack([p.ravel() for p in parts], 1), (t * norm / max(rho, 1e-6) - v).ravel(), rcond=None)[0]
        m = m + np.append(step, np.zeros(9 - len(step))).reshape(3, 3)
    found = back @ best @ to_unit
    return found / found[2, 2]


MODES = ("2d", "ecc", "affine", "homography")


def register_frames(frames: DataFrame, templates: dict[int, np.ndarray], height: int, width: int, mode: str = "2d", top: float = 65535.0) -> DataFrame:
    """The frames registered to their channel's template, held to 0..top, with ``dy, dx, rot_deg`` of each: in the modes 2d (shifts) and ecc (shifts
    and a turn) those of the transform; in the modes affine and homography the centre's shift and the turn of the x axis."""
    if mode not in MODES:
        raise ValueError(f"no mode {mode}")
    held = frames.sparkSession.sparkContext.broadcast(templates)  # a frame a channel

    def one(template: np.ndarray, im: np.ndarray) -> tuple[np.ndarray, float, float, float]:
        if mode == "ecc":
            dy, dx, rot = ecc(template, im)
            return shift_image(im, dy, dx, rot), dy, dx, rot
        m = ecc_matrix(template, im, mode)
        x, y = (width - 1) / 2, (height - 1) / 2
        at = m @ np.array([x, y, 1.0])
        return warp_image(im, m), float(at[1] / at[2] - y), float(at[0] / at[2] - x), float(np.degrees(np.arctan2(m[1, 0], m[0, 0])))

    def part(c: int, b: pd.DataFrame) -> pd.DataFrame:
        """Frames of one channel."""
        stack = stacked(b["pixels"]).reshape(-1, height, width)
        if mode == "2d":
            dy, dx = phase_shifts(held.value[c], stack)
            moved, rot = shift_images(stack, dy, dx), 0.0
        else:
            moved, dy, dx, rot = map(np.array, zip(*(one(held.value[c], im) for im in stack), strict=True))
        return pd.DataFrame({"frame_id": b["frame_id"], "channel": c, "pixels": list(np.clip(moved, 0, top).reshape(len(b), -1)), "dy": dy, "dx": dx, "rot_deg": rot})

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = max(1, 1_000_000 // max(1, height * width))  # frames moved at a time
        for b in batches:
            for c, own in b.groupby("channel"):
                for k in range(0, len(own), rows):
                    yield part(c, own.iloc[k : k + rows])

    return frames.select("frame_id", "channel", "pixels").mapInPandas(work, "frame_id long, channel int, pixels array<double>, dy double, dx double, rot_deg double")


def collected(frames: DataFrame, height: int, width: int) -> dict[int, np.ndarray]:
    """The mean frame of each channel. Rows as many as channels."""
    means = frames.select("channel", F.posexplode("pixels").alias("p", "v")).groupBy("channel", "p").agg(F.avg("v").alias("v"))
    rows = means.groupBy("channel").agg(F.transform(F.array_sort(F.collect_list(F.struct("p", "v"))), lambda s: s["v"]).alias("m")).collect()
    return {r["channel"]: np.array(r["m"]).reshape(height, width) for r in rows}


def motion_correct(frames: DataFrame, height: int, width: int, mode: str = "2d", n_reference: int = 60) -> DataFrame:
    """Frames registered to a template: frames n_reference .. 2 n_reference - 1 (the last as many of a shorter movie), by their order within each
    channel, registered to the first of them, and averaged."""
    near = F.lit(False)
    for (c,) in frames.select("channel").distinct().collect():
        ids = [r[0] for r in frames.filter(F.col("channel") == c).select("frame_id").distinct().orderBy("frame_id").limit(2 * n_reference).collect()]
        near = near | ((F.col("channel") == c) & F.col("frame_id").isin(ids[-n_reference:]))
    start = frames.filter(near)
    frame = start.groupBy("channel").agg(F.min_by("pixels", "frame_id").alias("pixels"))  # a row a channel
    first = {r["channel"]: np.array(r["pixels"]).reshape(height, width) for r in frame.collect()}
    template = collected(register_frames(start, first, height, width, mode), height, width)
    return register_frames(frames, template, height, width, mode)
