"""Pixel operations on decoded images, arrays of height x width x channels, for use in model batches."""

from __future__ import annotations

import numpy as np


def crop(pixels: np.ndarray, box) -> np.ndarray:
    """The part inside a box; right and bottom ends are open."""
    x1, y1, x2, y2 = (int(v) for v in box)
    return pixels[y1:y2, x1:x2]


def rescaled(pixels: np.ndarray, factor: float = 1 / 255) -> np.ndarray:
    return np.asarray(pixels, dtype=np.float32) * np.float32(factor)


def squared(pixels: np.ndarray, value: float = 0.5) -> np.ndarray:
    """Padded below and to the right to a square."""
    h, w = pixels.shape[:2]
    side = max(h, w)
    return np.pad(pixels, ((0, side - h), (0, side - w), (0, 0)), constant_values=value)


def _blurred(x: np.ndarray, sigma: float, axis: int) -> np.ndarray:
    """Gaussian blur along one axis out to four sigmas, ends mirrored without their edge pixel."""
    reach = int(4 * sigma + 0.5)
    if not reach:
        return x
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    kernel /= kernel.sum()
    n = x.shape[axis]
    at = np.arange(-reach, n + reach)
    period = max(1, 2 * (n - 1))
    at = np.abs((at + n - 1) % period - (n - 1)) if n > 1 else np.zeros_like(at)
    wide = np.take(x, at, axis=axis)
    return sum(k * np.take(wide, np.arange(j, j + n), axis=axis) for j, k in enumerate(kernel))


def resized(pixels: np.ndarray, height: int = 960, width: int = 960) -> np.ndarray:
    """Linear interpolation between pixel centres after a blur against aliasing; values stay in the input's range."""
    x = np.asarray(pixels, dtype=np.float64)
    low, high = x.min(initial=np.inf), x.max(initial=-np.inf)
    for axis, size in ((0, height), (1, width)):
        factor = x.shape[axis] / size
        x = _blurred(x, max(0.0, (factor - 1) / 2), axis)
        at = np.clip((np.arange(size) + 0.5) * factor - 0.5, 0, x.shape[axis] - 1)
        floor = np.floor(at).astype(int)
        share = (at - floor).reshape([-1 if k == axis else 1 for k in range(x.ndim)])
        above = np.minimum(floor + 1, x.shape[axis] - 1)
        x = np.take(x, floor, axis=axis) * (1 - share) + np.take(x, above, axis=axis) * share
    return np.clip(x, low, high).astype(np.float32)


def normalised(pixels: np.ndarray, mean, std) -> np.ndarray:
    mean, std = (np.asarray(v, dtype=np.float32) for v in (mean, std))
    if mean.size not in (1, pixels.shape[-1]) or std.size not in (1, pixels.shape[-1]):
        raise ValueError("mean and std need one value, or one for each channel")
    return (pixels - mean) / std


def detector_input(pixels: np.ndarray, mean, std, side: int = 960) -> np.ndarray:
    """Rescaled, squared, resized and normalised, in that order."""
    if pixels.ndim != 3:
        raise ValueError("an image has height, width and channels")
    return normalised(resized(squared(rescaled(pixels)), side, side), mean, std)
