"""Keypoints of one raster: extrema of a scale space of differences of Gaussians, their orientations, and histograms of gradients around them."""

from __future__ import annotations

from typing import NamedTuple

import numpy as np

INTERVALS, BASE_SIGMA, INPUT_SIGMA = 3, 1.6, 0.5
#: Bins of the orientation histogram; cells a side and bins of a cell of the descriptor, and a cell's side by the scale.
ORIENTATIONS, CELLS, CELL_BINS, CELL_SIDE = 36, 4, 8, 3.0


class Keypoint(NamedTuple):
    y: float
    x: float
    scale: float
    octave: int
    theta: float  # radians, from 0 to 2 pi
    vec: np.ndarray  # 128 values of length 1


def gaussian(image: np.ndarray, sigma: float) -> np.ndarray:
    """Blurred along both axes; the border is mirrored."""
    radius = max(1, int(np.ceil(4 * sigma)))
    k = np.exp(-(np.arange(-radius, radius + 1) ** 2) / (2 * sigma**2))
    k /= k.sum()
    out = image
    for axis in (0, 1):
        width = [(radius, radius) if a == axis else (0, 0) for a in (0, 1)]
        out = np.lib.stride_tricks.sliding_window_view(np.pad(out, width, mode="symmetric"), 2 * radius + 1, axis=axis) @ k
    return out


def pyramid(image: np.ndarray, least_side: int = 16) -> list[np.ndarray]:
    """(INTERVALS + 3, height, width) blurred images an octave; each octave starts at twice the blur of the one before, every other pixel of it."""
    sigmas = BASE_SIGMA * 2.0 ** (np.arange(INTERVALS + 3) / INTERVALS)
    base, out = gaussian(image.astype(float) / 255, np.sqrt(BASE_SIGMA**2 - INPUT_SIGMA**2)), []
    while min(base.shape) >= least_side:
        levels = [base]
        for low, high in zip(sigmas, sigmas[1:], strict=False):
            levels.append(gaussian(levels[-1], np.sqrt(high**2 - low**2)))
        out.append(np.array(levels))
        base = levels[INTERVALS][::2, ::2]
    return out


def extrema(dog: np.ndarray, least: float) -> np.ndarray:
    """(level, y, x) of values that none of their 26 neighbours exceeds, or none falls short of, and that are at least so large; none at a border."""
    middle = dog[1:-1, 1:-1, 1:-1]
    shape = middle.shape
    around = [dog[i : i + shape[0], j : j + shape[1], k : k + shape[2]] for i in range(3) for j in range(3) for k in range(3) if (i, j, k) != (1, 1, 1)]
    top, low = np.maximum.reduce(around), np.minimum.reduce(around)
    return np.argwhere((np.abs(middle) >= least) & ((middle >= top) | (middle <= low))) + 1


def refine(dog: np.ndarray, at: np.ndarray, contrast: float, edge: float, moves: int = 5) -> np.ndarray:
    """(level, y, x) below a pixel, of the parabola through each extremum's neighbours, those moved to a neighbour as often as need be; of low contrast and of edges go."""
    at, offset = at.copy(), np.zeros(at.shape)
    value = np.zeros(len(at))
    active = np.ones(len(at), bool)
    good = np.ones(len(at), bool)
    curve = np.zeros((len(at), 3, 3))
    for _ in range(moves):
        i = np.flatnonzero(active & good)
        if not len(i):
            break
        s, y, x = at[i].T
        d = lambda a, b, c: dog[s + a, y + b, x + c]  # noqa: B023, E731
        g = np.stack((d(1, 0, 0) - d(-1, 0, 0), d(0, 1, 0) - d(0, -1, 0), d(0, 0, 1) - d(0, 0, -1)), axis=1) / 2
        h = np.empty((len(i), 3, 3))
        units = np.eye(3, dtype=int)
        for p in range(3):
            h[:, p, p] = d(*units[p]) + d(*-units[p]) - 2 * d(0, 0, 0)
            for q in range(p):
                h[:, p, q] = h[:, q, p] = (d(*(units[p] + units[q])) + d(*(-units[p] - units[q])) - d(*(units[p] - units[q])) - d(*(units[q] - units[p]))) / 4
        solid = np.abs(np.linalg.det(h)) > 1e-18
        step = np.zeros((len(i), 3))
        step[solid] = -np.linalg.solve(h[solid], g[solid][:, :, None])[:, :, 0]
        good[i[~solid]] = False
        curve[i], offset[i], value[i] = h, step, d(0, 0, 0) + (g * step).sum(axis=1) / 2
        far = np.abs(step) > 0.6
        active[i] = far.any(axis=1)
        moved = at[i] + np.sign(step).astype(int) * far
        inside = ((moved >= 1) & (moved <= np.array(dog.shape) - 2)).all(axis=1)
        good[i[~inside]] = False
        take = inside & far.any(axis=1)
        at[i[take]] = moved[take]
    trace, det = curve[:, 1, 1] + curve[:, 2, 2], curve[:, 1, 1] * curve[:, 2, 2] - curve[:, 1, 2] ** 2
    good &= ~active & (np.abs(value) >= contrast) & (det > 0) & (trace**2 * edge < (edge + 1) ** 2 * det)
    return np.unique(np.round((at + offset)[good], 6), axis=0)


def gradients(levels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lengths and angles of the central differences of each level, of pixels with neighbours on all sides: the first is that of pixel (1, 1)."""
    gy = (levels[:, 2:, 1:-1] - levels[:, :-2, 1:-1]) / 2
    gx = (levels[:, 1:-1, 2:] - levels[:, 1:-1, :-2]) / 2
    return np.hypot(gy, gx), np.arctan2(gy, gx)


def _windows(slopes: tuple[np.ndarray, np.ndarray], at: np.ndarray, y: np.ndarray, x: np.ndarray, radius: np.ndarray) -> tuple[np.ndarray, ...]:
    """(number of the place, dy, dx, gradient length, its angle) of pixels around places of levels `at`, place by place, row by row."""
    height, width = slopes[0].shape[1:]
    cy, cx = np.round(y).astype(int), np.round(x).astype(int)
    y0, y1 = np.maximum(1, cy - radius), np.minimum(height, cy + radius)
    x0, x1 = np.maximum(1, cx - radius), np.minimum(width, cx + radius)
    wide = np.maximum(0, x1 - x0 + 1)
    n = np.maximum(0, y1 - y0 + 1) * wide
    who = np.repeat(np.arange(len(y)), n)
    down, right = np.divmod(np.arange(len(who)) - np.repeat(np.cumsum(n) - n, n), wide[who])
    py, px = y0[who] + down, x0[who] + right
    return who, py - y[who], px - x[who], *(v[at[who], py - 1, px - 1] for v in slopes)


#: Pixels of windows that are worked on at once.
PIXELS = 1 << 18


def _parts(radius: np.ndarray) -> list[np.ndarray]:
    """Places, in order, a part at a time: each part's windows have about PIXELS pixels at most."""
    return [p for p in np.split(np.arange(len(radius)), np.flatnonzero(np.diff(np.cumsum((2 * radius + 1) ** 2) // PIXELS)) + 1) if len(p)]


def all_orientations(slopes: tuple[np.ndarray, np.ndarray], at: np.ndarray, y: np.ndarray, x: np.ndarray, sigma: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number of the place, angle): angles whose share of the gradients around is at least 0.8 of the greatest, by place and angle."""
    radius = np.round(4.5 * sigma).astype(int)
    found = []
    for part in _parts(radius):
        who, dy, dx, length, angle = _windows(slopes, at[part], y[part], x[part], radius[part])
        weight = length * np.exp(-(dy**2 + dx**2) / (2 * (1.5 * sigma[part][who]) ** 2))
        bins = np.round(angle * ORIENTATIONS / (2 * np.pi)).astype(int) % ORIENTATIONS
        h = np.bincount(who * ORIENTATIONS + bins, weights=weight, minlength=len(part) * ORIENTATIONS).reshape(-1, ORIENTATIONS)
        for _ in range(2):
            h = (np.roll(h, 1, axis=1) + 2 * h + np.roll(h, -1, axis=1)) / 4
        left, right = np.roll(h, 1, axis=1), np.roll(h, -1, axis=1)
        place, peak = np.nonzero((h > left) & (h > right) & (h >= 0.8 * h.max(axis=1, keepdims=True)))
        bend = (left - right)[place, peak] / (2 * (left - 2 * h + right)[place, peak])
        theta = (peak + bend) * 2 * np.pi / ORIENTATIONS % (2 * np.pi)
        order = np.lexsort((theta, place))
        found.append((part[place[order]], theta[order]))
    return tuple(np.concatenate(v) for v in zip(*found, strict=True)) if found else (np.zeros(0, int), np.zeros(0))


def orientations(level: np.ndarray, y: float, x: float, sigma: float) -> list[float]:
    """Angles whose share of the gradients around is at least 0.8 of the greatest."""
    return all_orientations(gradients(level[None]), np.zeros(1, int), *(np.array([float(v)]) for v in (y, x, sigma)))[1].tolist()


def all_descriptors(slopes: tuple[np.ndarray, np.ndarray], at: np.ndarray, y: np.ndarray, x: np.ndarray, sigma: np.ndarray, theta: np.ndarray) -> np.ndarray:
    """(places, 128): histograms of gradient angles against theta, in cells of a square turned by it; each gradient is dealt to the cells and bins next to it."""
    side = CELL_SIDE * sigma
    radius = np.ceil(side * np.sqrt(2) * (CELLS + 1) / 2).astype(int)
    out = np.zeros((len(y), CELLS * CELLS * CELL_BINS))
    for part in _parts(radius):
        who, dy, dx, length, angle = _windows(slopes, at[part], y[part], x[part], radius[part])
        c, s, width = np.cos(theta[part])[who], np.sin(theta[part])[who], side[part][who]
        v, u = (-s * dx + c * dy) / width, (c * dx + s * dy) / width
        inside = (np.abs(v) < CELLS / 2 + 1) & (np.abs(u) < CELLS / 2 + 1)  # about half of the pixels
        who, v, u, length, angle = (a[inside] for a in (who, v, u, length, angle))
        weight = length * np.exp(-(u**2 + v**2) / (2 * (CELLS / 2) ** 2))
        b = (angle - theta[part][who]) % (2 * np.pi) * CELL_BINS / (2 * np.pi)
        v, u = v + CELLS / 2 - 0.5, u + CELLS / 2 - 0.5
        inside = (v > -1) & (v < CELLS) & (u > -1) & (u < CELLS)
        who, v, u, b, weight = who[inside], v[inside], u[inside], b[inside], weight[inside]
        v0, u0, b0 = np.floor(v).astype(int), np.floor(u).astype(int), np.floor(b).astype(int)
        shares, bins = [], []
        for i in (0, 1):
            for j in (0, 1):
                for k in (0, 1):
                    shares.append(weight * (np.abs(1 - i - (v - v0)) * np.abs(1 - j - (u - u0)) * np.abs(1 - k - (b - b0))))
                    bins.append(((who * (CELLS + 2) + v0 + i + 1) * (CELLS + 2) + u0 + j + 1) * CELL_BINS + (b0 + k) % CELL_BINS)
        h = np.bincount(np.concatenate(bins), weights=np.concatenate(shares), minlength=len(part) * (CELLS + 2) ** 2 * CELL_BINS)
        out[part] = h.reshape(-1, CELLS + 2, CELLS + 2, CELL_BINS)[:, 1:-1, 1:-1].reshape(len(part), -1)
    for n, vec in enumerate(out):
        for most in (0.2, np.inf):
            size = np.linalg.norm(vec)
            vec = np.minimum(vec / size if size > 0 else vec, most)
        out[n] = vec
    return out


def descriptor(level: np.ndarray, y: float, x: float, sigma: float, theta: float) -> np.ndarray:
    """The histograms of one place."""
    return all_descriptors(gradients(level[None]), np.zeros(1, int), *(np.array([float(v)]) for v in (y, x, sigma, theta)))[0]


def keypoints(image: np.ndarray, contrast: float = 0.04, edge: float = 10.0) -> list[Keypoint]:
    """Keypoints by octave, level, y, x and angle; values of the image are 0 to 255. An octave's windows are worked on together."""
    out = []
    for octave, levels in enumerate(pyramid(image)):
        dog = np.diff(levels, axis=0)
        s, y, x = refine(dog, extrema(dog, 0.5 * contrast / INTERVALS), contrast / INTERVALS, edge).T
        sigma = BASE_SIGMA * 2.0 ** (s / INTERVALS)
        at = np.clip(np.round(s).astype(int), 0, len(levels) - 1)
        slopes = gradients(levels)
        i, theta = all_orientations(slopes, at, y, x, sigma)
        vecs = all_descriptors(slopes, at[i], y[i], x[i], sigma[i], theta)
        places = zip((y[i] * 2**octave).tolist(), (x[i] * 2**octave).tolist(), (sigma[i] * 2**octave).tolist(), theta.tolist(), vecs, strict=True)
        out += [Keypoint(py, px, scale, octave, turn, vec) for py, px, scale, turn, vec in places]
    return out
