"""One log-polar resampling, and what features and criteria take from it."""

from __future__ import annotations

from functools import lru_cache

import numpy as np

ANGLES = 180
#: Angle pairs of the Fourier-Mellin feature, and the first of their rows.
PAIRS, FIRST = 45, 2


@lru_cache(32)
def samples(height: int, width: int, radii: int, centred: bool, angles: int = ANGLES) -> np.ndarray:
    """(angles, radii): the pixel, row-major, nearest to each place of the grid; -1 outside.

    Radii grow by a constant factor from 1 to the half diagonal of a square of side `radii`; the middle is (width / 2, height / 2), or the first pixel.
    """
    factor = radii / (np.log(radii) - np.log(2) / 2)
    r = np.exp(np.arange(radii) / factor)
    t = 2 * np.pi * np.arange(angles) / angles
    cy, cx = (height // 2, width // 2) if centred else (0, 0)
    y = np.rint(np.round(cy + np.sin(t)[:, None] * r, 9)).astype(int)
    x = np.rint(np.round(cx + np.cos(t)[:, None] * r, 9)).astype(int)
    inside = (y >= 0) & (y < height) & (x >= 0) & (x < width)
    return np.where(inside, y * width + x, -1)


def log_polar(stack: np.ndarray, radii: int, centred: bool) -> np.ndarray:
    """(n, angles, radii) of a stack of n rasters by nearest samples; 0 outside."""
    at = samples(*stack.shape[1:], radii, centred)
    flat = stack.reshape(len(stack), -1)
    return np.where(at >= 0, flat[:, np.maximum(at, 0)], 0.0)


def profiles(stack: np.ndarray, radii: int = 8) -> np.ndarray:
    """(n, radii): sums over all angles around the middle."""
    return log_polar(stack, radii, True).sum(axis=1)


def profile_correlation(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of each pair of two stacks, the cosine between the Fourier magnitudes of their profiles; 0 where one has none."""
    p, q = (np.abs(np.fft.rfft(profiles(s), axis=1)) for s in (a, b))
    size = np.sqrt((p * p).sum(axis=1) * (q * q).sum(axis=1))
    return np.where(size > 0, (p * q).sum(axis=1) / np.where(size > 0, size, 1), 0.0)


def fourier_mellin(block: np.ndarray, radii: int | None = None, centred: bool = False) -> np.ndarray:
    """PAIRS sums of logarithms along rays of the half spectrum's magnitude and along the rays half a turn on; zeros count as one."""
    half = np.abs(np.fft.fft2(block))[:, : block.shape[1] // 2 + 1]
    rays = np.abs(log_polar(half[None], radii or max(3, block.shape[0] // 2), centred)[0])
    rays = np.log(np.where(rays > 1e-9, rays, 1.0)).sum(axis=1)
    return rays[FIRST : FIRST + PAIRS] + rays[FIRST + 2 * PAIRS : FIRST + 3 * PAIRS]
