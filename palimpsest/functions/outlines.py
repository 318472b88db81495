"""Outlines of one area: its border in order, and its convex hull."""

from __future__ import annotations

import numpy as np

#: The eight neighbours (dy, dx), clockwise from the left.
AROUND = ((0, -1), (-1, -1), (-1, 0), (-1, 1), (0, 1), (1, 1), (1, 0), (1, -1))


def contour(points: np.ndarray) -> np.ndarray:
    """The outer border of an 8-connected area of pixels (rows y, x), clockwise from its first pixel in reading order; a pixel that is passed twice stands twice."""
    inside = set(map(tuple, points.tolist()))
    start = min(inside)
    out, here, came = [start], start, 0  # nothing lies to the left of the first pixel
    first_step = None
    while True:
        for i in range(1, 9):
            turn = (came + i) % 8
            there = (here[0] + AROUND[turn][0], here[1] + AROUND[turn][1])
            if there in inside:
                break
        else:
            return np.array(out)  # one pixel
        if first_step is None:
            first_step = turn
        elif here == start and turn == first_step:
            return np.array(out[:-1])
        # the next search starts behind the neighbour that was looked at last and is outside
        before = AROUND[(turn - 1) % 8]
        outside = (here[0] + before[0] - there[0], here[1] + before[1] - there[1])
        here, came = there, AROUND.index(outside)
        out.append(here)


def hull(points: np.ndarray) -> np.ndarray:
    """Corners of the convex hull of points (rows y, x), from the least x, then y, on by way of the greatest y; points on its edges are none."""
    ordered = sorted({(int(x), int(y)) for y, x in points.tolist()})

    def chain(run) -> list[tuple[int, int]]:
        kept: list[tuple[int, int]] = []
        for p in run:
            while len(kept) > 1 and (kept[-1][0] - kept[-2][0]) * (p[1] - kept[-2][1]) - (kept[-1][1] - kept[-2][1]) * (p[0] - kept[-2][0]) >= 0:
                kept.pop()
            kept.append(p)
        return kept

    if len(ordered) < 2:
        return np.array([(y, x) for x, y in ordered]).reshape(-1, 2)
    corners = chain(ordered)[:-1] + chain(reversed(ordered))[:-1]
    return np.array([(y, x) for x, y in corners])
