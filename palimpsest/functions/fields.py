"""Dense descriptors of one raster, and the field of each place's nearest descriptor elsewhere in it."""

from __future__ import annotations

from functools import lru_cache
from math import factorial

import numpy as np

#: Sectors of a ring, by its number times two and one: a quarter turn maps the samples onto themselves.
SECTORS = 4


def cubic(x: np.ndarray) -> np.ndarray:
    """Bicubic weight of a sample x away."""
    x = np.abs(x)
    return np.where(x <= 1, 1.5 * x**3 - 2.5 * x**2 + 1, np.where(x < 2, -0.5 * x**3 + 2.5 * x**2 - 4 * x + 2, 0.0))


def moments(order: int) -> list[tuple[int, int]]:
    """(n, m) of the Zernike functions up to an order, m not negative: 12 for order 5."""
    return [(n, m) for n in range(order + 1) for m in range(n % 2, n + 1, 2)]


@lru_cache(8)
def zernike_filters(radius: int, order: int) -> np.ndarray:
    """(moments, 2 radius + 1, 2 radius + 1) complex: what pixels weigh in each moment of the disc around the middle one.

    The disc is cut into rings of a pixel and sectors of equal area; each cell has the exact integral of its Zernike function and the bicubic value of the image at its middle.
    """
    side = np.arange(-radius, radius + 1)
    out = np.zeros((len(moments(order)), len(side), len(side)), complex)
    for ring in range(radius):
        n_cells = SECTORS * (2 * ring + 1)
        edges = 2 * np.pi * np.arange(n_cells + 1) / n_cells
        middle = (edges[:-1] + edges[1:]) / 2
        at = (ring + 0.5) * np.stack((np.sin(middle), np.cos(middle)))
        weights = cubic(side[None] - at[0][:, None])[:, :, None] * cubic(side[None] - at[1][:, None])[:, None, :]
        low, high = ring / radius, (ring + 1) / radius
        for i, (n, m) in enumerate(moments(order)):
            radial = 0.0
            for s in range((n - m) // 2 + 1):
                power = n - 2 * s + 2
                radial += (-1) ** s * factorial(n - s) / (factorial(s) * factorial((n + m) // 2 - s) * factorial((n - m) // 2 - s)) * (high**power - low**power) / power
            angular = np.diff(edges) if m == 0 else 1j / m * np.diff(np.exp(-1j * m * edges))
            out[i] += (n + 1) / np.pi * radial * np.tensordot(angular, weights, axes=1)
    return out


def zernike_vectors(image: np.ndarray, radius: int = 8, order: int = 5) -> np.ndarray:
    """(height, width, moments): magnitudes of the Zernike moments of the disc around each pixel; black beyond the border."""
    h, w = image.shape
    shape = (h + 2 * radius, w + 2 * radius)
    seen = np.fft.fft2(image.astype(float), shape)
    out = np.empty((h, w, len(moments(order))))
    for i, f in enumerate(zernike_filters(radius, order)):
        out[..., i] = np.abs(np.fft.ifft2(seen * np.fft.fft2(f[::-1, ::-1], shape))[radius : radius + h, radius : radius + w])
    return out


def raw_vectors(image: np.ndarray, patch: int) -> np.ndarray:
    """(height - patch + 1, width - patch + 1, patch^2): the pixels of each square, by its upper left corner."""
    windows = np.lib.stride_tricks.sliding_window_view(image.astype(float), (patch, patch))
    return windows.reshape(*windows.shape[:2], -1)


class Fields:
    """A match and its cost for every place of many rasters, improved line by line; vectors are (n, height, width, length). Matches lie at least `least` away.

    Rasters do not meet: each has its own random numbers, and its field is that of the raster alone.
    """

    def __init__(self, vectors: np.ndarray, least: float, seed: int = 0):
        self.vectors, self.least = vectors, least
        self.n, self.h, self.w = vectors.shape[:3]
        self.random = [np.random.default_rng(seed) for _ in range(self.n)]
        self.image = np.arange(self.n)[:, None]
        self.y, self.x = (a.ravel() for a in np.indices((self.h, self.w)))
        draw = lambda most: np.stack([r.integers(0, most, (self.h, self.w)) for r in self.random])
        self.my, self.mx = draw(self.h), draw(self.w)
        self.cost = self._costs(self.y, self.x, self.my.reshape(self.n, -1), self.mx.reshape(self.n, -1)).reshape(self.my.shape)

    def _costs(self, y: np.ndarray, x: np.ndarray, ty: np.ndarray, tx: np.ndarray) -> np.ndarray:
        """(n, k) of k places and their targets in each raster."""
        good = (ty >= 0) & (ty < self.h) & (tx >= 0) & (tx < self.w) & ((ty - y) ** 2 + (tx - x) ** 2 >= self.least**2)
        out = np.full(ty.shape, np.inf)
        i, k = np.nonzero(good)
        d = self.vectors[i, y[k], x[k]] - self.vectors[i, ty[good], tx[good]]
        out[good] = np.einsum("ij,ij->i", d, d)
        return out

    def _offer(self, y: np.ndarray, x: np.ndarray, ty: np.ndarray, tx: np.ndarray) -> None:
        cost = self._costs(y, x, ty, tx)
        i, k = np.nonzero(cost < self.cost[:, y, x])
        at = (i, y[k], x[k])
        self.cost[at], self.my[at], self.mx[at] = cost[i, k], ty[i, k], tx[i, k]

    def propagate(self, step: int) -> None:
        """Displacements, and displacements carried on by their change, from the lines before: rows with their three neighbours behind, then columns; step -1 goes backwards."""
        for axis, n in ((0, self.h), (1, self.w)):
            lines = range(n) if step > 0 else range(n - 1, -1, -1)
            length = (self.w, self.h)[axis]
            along = np.arange(length)
            for line in lines:
                for order in (1, 2):
                    before, far = line - step, line - 2 * step
                    if not 0 <= (before if order == 1 else far) < n:
                        continue
                    for side in (0, -1, 1):
                        near, beyond = along + side, along + 2 * side
                        inside = (near >= 0) & (near < length) & ((order == 1) | (beyond >= 0) & (beyond < length))
                        own, near, beyond = along[inside], near[inside], beyond[inside]
                        at = lambda k, i: (np.full(len(i), k), i) if axis == 0 else (i, np.full(len(i), k))
                        y, x = at(line, own)
                        dy, dx = self._moved(*at(before, near))
                        if order == 2:
                            ey, ex = self._moved(*at(far, beyond))
                            dy, dx = 2 * dy - ey, 2 * dx - ex
                        self._offer(y, x, y + dy, x + dx)

    def _moved(self, y: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return self.my[:, y, x] - y, self.mx[:, y, x] - x

    def search(self) -> None:
        """Random places around each match, in windows that halve from the whole raster to a pixel."""
        cy, cx = self.my.reshape(self.n, -1).copy(), self.mx.reshape(self.n, -1).copy()
        reach = max(self.h, self.w)
        while reach >= 1:
            target = []
            for c, most in ((cy, self.h), (cx, self.w)):
                low, high = np.maximum(c - reach, 0), np.minimum(c + reach, most - 1) + 1
                target.append(np.stack([r.integers(a, b) for r, a, b in zip(self.random, low, high, strict=True)]))
            self._offer(self.y, self.x, *target)
            reach //= 2

    def symmetrise(self) -> None:
        """Each place offers itself to its match; of several the nearest wins, of equals the first."""
        cost = self.cost.reshape(self.n, -1)
        order = np.argsort(cost, axis=1, kind="stable")[:, ::-1]
        image = np.broadcast_to(self.image, order.shape)
        known = np.isfinite(cost[image, order])
        i, k = image[known], order[known]
        ty, tx, cost = self.my.reshape(self.n, -1)[i, k], self.mx.reshape(self.n, -1)[i, k], cost[i, k]
        better = cost < self.cost[i, ty, tx]
        at = (i[better], ty[better], tx[better])
        self.my[at], self.mx[at], self.cost[at] = self.y[k[better]], self.x[k[better]], cost[better]  # the last of a place, the nearest, stays


class Field:
    """Fields of one raster, (height, width, length)."""

    def __init__(self, vectors: np.ndarray, least: float, seed: int = 0):
        self._one = Fields(vectors[None], least, seed)
        self.propagate, self.search, self.symmetrise = self._one.propagate, self._one.search, self._one.symmetrise

    vectors, my, mx, cost = (property(lambda self, name=name: getattr(self._one, name)[0]) for name in ("vectors", "my", "mx", "cost"))


def match_field(vectors: np.ndarray, least: float, rounds: int = 8, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """((height, width, 2) matches as y and x, costs, infinite where no place is far enough): rounds that go forwards and backwards in turn, each with symmetry and a random search."""
    matches, cost = match_fields(vectors[None], least, rounds, seed)
    return matches[0], cost[0]


def match_fields(vectors: np.ndarray, least: float, rounds: int = 8, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """match_field() of many rasters of one size at once."""
    field = Fields(vectors, least, seed)
    for turn in range(rounds):
        field.propagate(1 if turn % 2 == 0 else -1)
        field.symmetrise()
        field.search()
    return np.stack((field.my, field.mx), axis=-1), field.cost
