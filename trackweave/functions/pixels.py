"""Pixel arithmetic of crops, in NumPy over Arrow batches: sharpness, colour signature, input of an embedding network.

A crop is (height, width, pixels): rows of blue, green, red bytes, as Spark's image source gives them. Each row is computed alone, so that nothing is shuffled and
memory is one batch. A crop whose bytes do not fill height x width x 3, and a null or empty one, has null for a result.
Resizing is linear between the four nearest pixels, centres at half, and rounds to whole numbers; a library that works in fixed point may differ by one.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# fixed values: weights of blue, green and red in grey, in thousandths
GREY = np.array([114, 587, 299])
# fixed values: mean and deviation of red, green and blue that embedding networks expect
MEAN = np.array([0.485, 0.456, 0.406])
DEVIATION = np.array([0.229, 0.224, 0.225])
# fixed values: linear red, green, blue to XYZ over the white point D65
XYZ = np.array([[0.412453, 0.357580, 0.180423], [0.212671, 0.715160, 0.072169], [0.019334, 0.119193, 0.950227]])
WHITE = np.array([0.950456, 1.0, 1.088754])
# fixed values: sizes (height, width) of a colour signature's and a network's input, bins of each channel
SIGNATURE, NETWORK, BINS = (128, 64), (256, 128), 8


def image(height: int | None, width: int | None, pixels: bytes | None) -> np.ndarray | None:
    if pixels is None or not height or not width or min(height, width) < 0 or len(pixels) != height * width * 3:
        return None
    return np.frombuffer(pixels, np.uint8).reshape(int(height), int(width), 3)


def grey(img: np.ndarray) -> np.ndarray:
    return (img.astype(np.int64) @ GREY + 500) // 1000


def sharpness_of(img: np.ndarray) -> float:
    """Variance over pixels of the Laplacian of grey; beyond the border the picture is mirrored about its outermost pixels."""
    g = grey(img)
    p = np.pad(g, 1, mode="reflect")
    return float((p[:-2, 1:-1] + p[2:, 1:-1] + p[1:-1, :-2] + p[1:-1, 2:] - 4 * g).var())


def resized(img: np.ndarray, height: int, width: int) -> np.ndarray:
    def places(old: int, new: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        at = np.clip((np.arange(new) + 0.5) * old / new - 0.5, 0, old - 1)
        low = np.floor(at).astype(int)
        return low, np.minimum(low + 1, old - 1), at - low

    if img.shape[:2] == (height, width):
        return img
    (y0, y1, fy), (x0, x1, fx) = places(img.shape[0], height), places(img.shape[1], width)
    fx, fy, img = fx[None, :, None], fy[:, None, None], img.astype(float)
    rows = img[y0] * (1 - fy) + img[y1] * fy
    return np.floor(rows[:, x0] * (1 - fx) + rows[:, x1] * fx + 0.5).astype(np.uint8)


def lab(img: np.ndarray) -> np.ndarray:
    """Lightness scaled to 0..255, a and b moved up by 128, all rounded."""
    rgb = img[..., ::-1] / 255.0
    linear = np.where(rgb > 0.04045, ((rgb + 0.055) / 1.055) ** 2.4, rgb / 12.92)
    xyz = linear @ XYZ.T / WHITE
    f = np.where(xyz > 0.008856, np.cbrt(xyz), 7.787 * xyz + 16 / 116)
    y = xyz[..., 1]
    light = np.where(y > 0.008856, 116 * f[..., 1] - 16, 903.3 * y)
    out = np.stack([light * 255 / 100, 500 * (f[..., 0] - f[..., 1]) + 128, 200 * (f[..., 1] - f[..., 2]) + 128], -1)
    return np.clip(np.floor(out + 0.5), 0, 255).astype(np.int64)


def signature_of(img: np.ndarray, size: tuple[int, int] | None = SIGNATURE) -> tuple[list[float], list[float]]:
    """Histograms of the upper and the lower half over BINS x BINS x BINS cells of lightness, a and b, each of sum 1."""
    cells = lab(resized(img, *size) if size else img) * BINS // 256
    cells = (cells[..., 0] * BINS + cells[..., 1]) * BINS + cells[..., 2]
    cut, halves = cells.shape[0] // 2, []
    for part in (cells[:cut], cells[cut:]):
        counts = np.bincount(part.ravel(), minlength=BINS**3).astype(float)
        halves.append((counts / max(counts.sum(), 1.0)).tolist())
    return halves[0], halves[1]


def network_input_of(img: np.ndarray, size: tuple[int, int] | None = NETWORK) -> list[float]:
    """Channel after channel (red, green, blue), rows in turn: centred and scaled."""
    rgb = (resized(img, *size) if size else img)[..., ::-1] / 255.0
    return ((rgb - MEAN) / DEVIATION).transpose(2, 0, 1).astype(np.float32).ravel().tolist()


def _each(kind: T.DataType, of: Callable[[np.ndarray], object]) -> Callable[..., Column]:
    @F.pandas_udf(kind)
    def run(height: pd.Series, width: pd.Series, pixels: pd.Series) -> pd.Series:
        found = (image(None if pd.isna(h) else int(h), None if pd.isna(w) else int(w), p) for h, w, p in zip(height, width, pixels, strict=True))
        return pd.Series([None if i is None else of(i) for i in found], dtype=object)

    return run


def sharpness(height: Column, width: Column, pixels: Column) -> Column:
    return _each(T.DoubleType(), sharpness_of)(height, width, pixels)


def color_signature(height: Column, width: Column, pixels: Column, size: tuple[int, int] | None = SIGNATURE) -> Column:
    """Two arrays, of the upper and the lower half; size None: as large as the crop is."""
    return _each(T.ArrayType(T.ArrayType(T.DoubleType())), lambda i: list(signature_of(i, size)))(height, width, pixels)


def network_input(height: Column, width: Column, pixels: Column, size: tuple[int, int] | None = NETWORK) -> Column:
    return _each(T.ArrayType(T.FloatType()), lambda i: network_input_of(i, size))(height, width, pixels)
