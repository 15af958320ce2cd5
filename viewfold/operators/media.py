"""What needs pixels: change scores, motion maps and masks, over raw frames as binary columns.

Frames are (frame_id, width, height, rgb) with 3 bytes a pixel. Scores between neighbours need
the frame before, which a lag brings to the row; all else is one Arrow batch at a time.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W


# fixed values: brightness of 8-bit pixels as (R 4899 + G 9617 + B 1868 + 8192) >> 14, hue in 0..179
LUMA_WEIGHTS, LUMA_SHIFT = (4899, 9617, 1868), 14


def to_hsv(rgb: np.ndarray) -> np.ndarray:
    """Hue in 0..179, saturation and value in 0..255, of an (n, 3) array of RGB bytes, in whole
    numbers as the usual 8-bit conversion gives them."""
    r, g, b = rgb.astype(np.int64).T
    top = np.maximum(np.maximum(r, g), b)
    span = top - np.minimum(np.minimum(r, g), b)
    by_top = np.where(top > 0, np.rint((255 << 12) / np.maximum(top, 1)), 0).astype(np.int64)
    by_span = np.where(span > 0, np.rint((180 << 12) / np.maximum(6 * span, 1)), 0).astype(np.int64)
    h = np.where(top == r, g - b, np.where(top == g, b - r + 2 * span, r - g + 4 * span))
    h = (h * by_span + 2048) >> 12
    return np.stack([np.where(h < 0, h + 180, h), (span * by_top + 2048) >> 12, top], axis=1)


def luma(rgb: np.ndarray) -> np.ndarray:
    """Brightness in 0..255 of an (n, 3) array of RGB bytes."""
    return (rgb.astype(np.int64) @ np.array(LUMA_WEIGHTS) + (1 << LUMA_SHIFT - 1)) >> LUMA_SHIFT


def _shares(n: int, m: int) -> np.ndarray:
    """(m, n): how much of each of ``n`` cells lies in each of ``m`` larger ones, as a mean."""
    edge = np.arange(m + 1) * (n / m)
    low, high = np.maximum(edge[:-1, None], np.arange(n)), np.minimum(edge[1:, None], np.arange(1, n + 1))
    return np.clip(high - low, 0, None) * (m / n)


def _small(rgb: bytes, w: int, h: int, limit: int) -> np.ndarray:
    """Pixels as (n, 3); where the longer side is over 1.5 times ``limit`` the picture is scaled to
    it, each new pixel being the mean over its area."""
    x = np.frombuffer(rgb, dtype=np.uint8).reshape(h, w, 3)
    if max(w, h) > 1.5 * limit:
        k = limit / max(w, h)
        across, down = _shares(w, max(1, int(w * k))), _shares(h, max(1, int(h * k)))
        x = np.clip(np.rint(np.einsum("ij,jkc,lk->ilc", down, x.astype(float), across, optimize=True)), 0, 255)
    return x.reshape(-1, 3)


def change_scores(frames: DataFrame, luma_only: bool = False, limit: int = 240, key: str | None = None) -> DataFrame:
    """(n, score): mean absolute difference to the frame before, over hue, saturation and value or
    brightness alone; 0 for the first frame, and where the size changes."""
    if limit < 16:
        raise ValueError("limit must be 16 or more")
    over = (W.partitionBy(key) if key else W.partitionBy(F.lit(0))).orderBy("frame_id")
    both = frames.withColumns({"__b": F.lag("rgb").over(over), "__bw": F.lag("width").over(over), "__bh": F.lag("height").over(over)})

    def score(w, h, now, bw, bh, before) -> float:
        if before is None or (bw, bh) != (w, h):
            return 0.0
        a, b = (_small(x, w, h, limit) for x in (now, before))
        if luma_only:
            return float(np.abs(luma(a) - luma(b)).mean())
        return float(np.abs(to_hsv(a) - to_hsv(b)).mean(axis=0).sum() / 3)

    @F.arrow_udf("double")
    def run(w: pa.Array, h: pa.Array, now: pa.Array, bw: pa.Array, bh: pa.Array, before: pa.Array) -> pa.Array:
        return pa.array([score(*(c[k].as_py() for c in (w, h, now, bw, bh, before))) for k in range(len(w))], pa.float64())

    n = F.row_number().over(over).cast("long")
    return both.select(*([key] if key else []), n.alias("n"), run("width", "height", "rgb", "__bw", "__bh", "__b").alias("score"))


def _blur(x: np.ndarray, k: int = 5) -> np.ndarray:
    """Binomial smoothing along both axes with reflected borders."""
    w = np.array([1.0])
    for _ in range(k - 1):
        w = np.convolve(w, [0.5, 0.5])
    for axis in (0, 1):
        pad = [(k // 2, k // 2) if a == axis else (0, 0) for a in (0, 1)]
        x = np.apply_along_axis(lambda v: np.convolve(v, w, "valid"), axis, np.pad(x, pad, mode="reflect"))
    return x


def motion_map(now: np.ndarray, before: np.ndarray, threshold: float = 50.0) -> np.ndarray:
    """Pixels whose smoothed brightness changed by more than ``threshold``, spread by one pixel."""
    hit = np.abs(_blur(luma(now.reshape(-1, 3)).reshape(now.shape[:2])) - _blur(luma(before.reshape(-1, 3)).reshape(before.shape[:2]))) > threshold
    out = np.pad(hit, 1)
    grown = np.zeros_like(hit)
    for dy in range(3):
        for dx in range(3):
            grown |= out[dy : dy + hit.shape[0], dx : dx + hit.shape[1]]
    return grown


def motion_pixels(frames: DataFrame, look_back: int = 1, threshold: float = 50.0, key: str | None = None) -> DataFrame:
    """(frame_id, x, y) of pixels that changed against the frame ``look_back`` before."""
    over = (W.partitionBy(key) if key else W.partitionBy(F.lit(0))).orderBy("frame_id")
    both = frames.withColumn("before", F.lag("rgb", look_back).over(over)).where("before is not null")

    @F.arrow_udf("array<struct<x:int,y:int>>")
    def run(w: pa.Array, h: pa.Array, now: pa.Array, before: pa.Array) -> pa.Array:
        xs, ys, ends = [], [], [0]
        for k in range(len(w)):
            shape = (h[k].as_py(), w[k].as_py(), 3)
            a, b = (np.frombuffer(c[k].as_buffer(), dtype=np.uint8).reshape(shape) for c in (now, before))
            y, x = np.nonzero(motion_map(a, b, threshold))
            xs.append(x)
            ys.append(y)
            ends.append(ends[-1] + len(x))
        flat = [pa.array(np.concatenate([np.zeros(0, dtype=np.int64), *c]), pa.int32()) for c in (xs, ys)]
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(flat, ["x", "y"]))

    return both.select(*([key] if key else []), "frame_id", F.inline(run("width", "height", "rgb", "before")))


def rle_mask(mask: np.ndarray) -> list[int]:
    """Run lengths down the columns, starting with zeros."""
    flat = mask.astype(bool).ravel(order="F")
    edges = np.flatnonzero(np.diff(np.concatenate([[False], flat, [not flat[-1] if len(flat) else False]])))
    return np.diff(np.concatenate([[0], edges])).astype(int).tolist() if len(flat) else []


def mask_rle(x_min: Column, y_min: Column, w: Column, h: Column, data: Column, width: int, height: int) -> Column:
    """A box-sized bitmap (a byte a pixel) pasted into the frame, as run lengths."""

    @F.arrow_udf("array<int>")
    def run(xs: pa.Array, ys: pa.Array, ws: pa.Array, hs: pa.Array, data: pa.Array) -> pa.Array:
        out = []
        for x, y, w, h, d in zip(*(c.to_pylist() for c in (xs, ys, ws, hs, data))):
            full = np.zeros((height, width), dtype=bool)
            part = np.frombuffer(d, dtype=np.uint8).reshape(h, w) > 0
            y0, x0, y1, x1 = max(y, 0), max(x, 0), min(y + h, height), min(x + w, width)
            if y1 > y0 and x1 > x0:
                full[y0:y1, x0:x1] = part[y0 - y : y1 - y, x0 - x : x1 - x]
            out.append(rle_mask(full))
        return pa.array(out, pa.list_(pa.int32()))

    return run(x_min, y_min, w, h, data)
