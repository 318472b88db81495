"""Maps between point pairs, robustly: affine maps and homographies as 3 x 3 matrices; points are rows (x, y)."""

from __future__ import annotations

import numpy as np

from palimpsest.functions.grids import fit_affine, fit_affine_total, normalise_points

#: Samples drawn and tried together.
BATCH = 64
METHODS = ("ownransac", "ransac", "lmeds", "pure", "goldstandard")


def projected(h: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Points under one map, or under each of a stack of maps; infinite where a point goes to infinity."""
    q = np.einsum("...ij,nj->...ni", h, np.column_stack((p, np.ones(len(p)))))
    w = q[..., 2:]
    return np.where(np.abs(w) > 1e-12, q[..., :2] / np.where(np.abs(w) > 1e-12, w, 1), np.inf)


def squared_errors(h: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances from where a goes to b."""
    return ((projected(h, a) - b) ** 2).sum(axis=-1)


def _equations(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Two rows a pair, whose null vector is the homography: (..., 2 n, 9)."""
    x, y, u, v = a[..., 0], a[..., 1], b[..., 0], b[..., 1]
    o, i = np.zeros_like(x), np.ones_like(x)
    first = np.stack((x, y, i, o, o, o, -u * x, -u * y, -u), axis=-1)
    second = np.stack((o, o, o, x, y, i, -v * x, -v * y, -v), axis=-1)
    return np.concatenate((first, second), axis=-2)


def direct_linear(a: np.ndarray, b: np.ndarray) -> np.ndarray | None:
    """The homography by the direct linear transform on normalised points; None where the pairs (four at least) leave it open."""
    if len(a) < 4:
        return None
    pa, ta = normalise_points(a)
    pb, tb = normalise_points(b)
    _, s, vt = np.linalg.svd(_equations(pa, pb))
    if s[7] <= 1e-9 * s[0]:
        return None
    h = np.linalg.inv(tb) @ vt[-1].reshape(3, 3) @ ta
    return h / h[2, 2] if abs(h[2, 2]) > 1e-12 else None


def _collinear(p: np.ndarray) -> np.ndarray:
    """By sample of three or more points: whether some three of the first four lie on one line."""
    n = min(p.shape[-2], 4)
    out = np.zeros(p.shape[:-2], bool)
    for i in range(n):
        for j in range(i + 1, n):
            for k in range(j + 1, n):
                d, e = p[..., j, :] - p[..., i, :], p[..., k, :] - p[..., i, :]
                out |= np.abs(d[..., 0] * e[..., 1] - d[..., 1] * e[..., 0]) < 1e-9
    return out


def _samples(n: int, size: int, random: np.random.Generator) -> np.ndarray:
    """BATCH samples of `size` different indices."""
    return np.argsort(random.random((BATCH, n)), axis=1)[:, :size] if n <= 256 else np.array([random.choice(n, size, replace=False) for _ in range(BATCH)])


def _minimal(a: np.ndarray, b: np.ndarray, affine: bool) -> np.ndarray:
    """Maps through samples of three (affine) or four pairs, each a sample (s, k, 2)."""
    if affine:
        m = np.linalg.solve(np.concatenate((a, np.ones((*a.shape[:2], 1))), axis=2), b).transpose(0, 2, 1)
        return np.concatenate((m, np.broadcast_to([[[0.0, 0.0, 1.0]]], (len(m), 1, 3))), axis=1)
    return np.linalg.svd(_equations(a, b))[2][:, -1].reshape(-1, 3, 3)


def candidates(a: np.ndarray, b: np.ndarray, affine: bool, rounds: int, seed: int):
    """(maps, squared errors of all pairs) of batches of random samples, without samples that have three points on a line."""
    random, size = np.random.default_rng(seed), 3 if affine else 4
    for _ in range(-(-rounds // BATCH) if len(a) >= size else 0):
        pick = _samples(len(a), size, random)
        pick = pick[~(_collinear(a[pick]) | _collinear(b[pick]))]
        if len(pick):
            maps = _minimal(a[pick], b[pick], affine)
            yield maps, squared_errors(maps, a, b)


def refined(h: np.ndarray, a: np.ndarray, b: np.ndarray, steps: int = 10) -> np.ndarray:
    """The homography of least reprojection error near h, by damped Gauss-Newton steps over its first eight entries."""
    p, damping = (h / h[2, 2]).ravel()[:8], 1e-3
    cost = squared_errors(np.append(p, 1).reshape(3, 3), a, b).sum()
    for _ in range(steps):
        m = np.append(p, 1).reshape(3, 3)
        w = np.column_stack((a, np.ones(len(a)))) @ m[2]
        q = projected(m, a)
        if not np.isfinite(q).all():
            break
        x, o = np.column_stack((a, np.ones(len(a)))) / w[:, None], np.zeros((len(a), 3))
        jacobian = np.vstack((np.hstack((x, o, -q[:, :1] * x[:, :2])), np.hstack((o, x, -q[:, 1:] * x[:, :2]))))
        normal = jacobian.T @ jacobian
        try:
            step = np.linalg.solve(normal + damping * np.diag(np.diag(normal)) + 1e-15 * np.eye(8), jacobian.T @ (b - q).T.ravel())
        except np.linalg.LinAlgError:
            break
        new = squared_errors(np.append(p + step, 1).reshape(3, 3), a, b).sum()
        if new < cost:
            done = cost - new <= 1e-12 * cost
            p, cost, damping = p + step, new, damping / 10
            if done:
                break
        else:
            damping *= 10
    return np.append(p, 1).reshape(3, 3)


def locally_optimised(h: np.ndarray, a: np.ndarray, b: np.ndarray, tolerance: float, affine: bool, rounds: int = 10) -> tuple[np.ndarray, np.ndarray]:
    """The map fitted again to its inliers while that wins inliers, and those inliers."""
    near = squared_errors(h, a, b) <= tolerance**2
    for _ in range(rounds):
        fit = affine_total(a[near], b[near]) if affine else direct_linear(a[near], b[near])
        if fit is None:
            break
        now = squared_errors(fit, a, b) <= tolerance**2
        if now.sum() < near.sum():
            break
        h, stop, near = fit, (now == near).all(), now
        if stop:
            break
    return h, near


def affine_total(a: np.ndarray, b: np.ndarray) -> np.ndarray | None:
    """The affine map of total least squares; ordinary ones where the pairs determine no such plane, None below three pairs or on a line."""
    if len(a) < 3 or np.linalg.matrix_rank(a - a.mean(axis=0), tol=1e-9) < 2:
        return None
    try:
        m = fit_affine_total(a, b)
    except np.linalg.LinAlgError:
        m = fit_affine(a, b)
    return np.vstack((m if np.isfinite(m).all() else fit_affine(a, b), (0, 0, 1)))


def consensus(a: np.ndarray, b: np.ndarray, tolerance: float, affine: bool, rounds: int = 2000, seed: int = 0, enough: float = 0.97, confidence: float = 0.995) -> tuple[np.ndarray | None, np.ndarray]:
    """The map that most pairs follow within the tolerance, among random samples, locally optimised; and its inliers.

    It stops when the share `enough` follows, or when a better sample is so unlikely as `confidence` says.
    """
    n, size = len(a), 3 if affine else 4
    best, near, tried = None, np.zeros(n, bool), 0
    for maps, errors in candidates(a, b, affine, rounds, seed):
        counts = (errors <= tolerance**2).sum(axis=1)
        tried += BATCH
        k = int(counts.argmax())
        if counts[k] > near.sum():
            best, near = maps[k], errors[k] <= tolerance**2
        share = near.sum() / n
        if share > enough or tried >= np.log(1 - confidence) / np.log(max(1e-12, 1 - share**size) if share < 1 else 1e-12):
            break
    if best is None or near.sum() < size:
        return None, np.zeros(n, bool)
    return locally_optimised(best, a, b, tolerance, affine)


def least_median(a: np.ndarray, b: np.ndarray, rounds: int = 2000, seed: int = 0) -> tuple[np.ndarray | None, np.ndarray]:
    """The homography whose median squared error is least among random samples, refined on what lies within 2.5 robust deviations of it."""
    best, median = None, np.inf
    for maps, errors in candidates(a, b, False, rounds, seed):
        middle = np.median(errors, axis=1)
        k = int(middle.argmin())
        if middle[k] < median:
            best, median = maps[k], middle[k]
    if best is None:
        return None, np.zeros(len(a), bool)
    deviation = max(1.4826 * (1 + 5 / max(1, len(a) - 4)) * np.sqrt(median), 1e-3)
    near = squared_errors(best, a, b) <= (2.5 * deviation) ** 2
    fit = direct_linear(a[near], b[near])
    return (refined(fit, a[near], b[near]), near) if fit is not None else (best, near)


def estimate(method: str, a: np.ndarray, b: np.ndarray, tolerance: float = 3.0, rounds: int = 2000, seed: int = 0) -> tuple[np.ndarray | None, np.ndarray]:
    """(map, inliers) by one of METHODS; tolerance in the points' units.

    ownransac: affine by samples of three, refitted by total least squares. ransac: homography by samples of four, of least reprojection error on its inliers. lmeds: homography of least median error, without
    a tolerance. pure: homography of all pairs. goldstandard: affine of total least squares over all pairs, `rounds` of them at most, drawn by the seed.
    """
    everything = np.ones(len(a), bool)
    if method == "ownransac":
        return consensus(a, b, tolerance, True, rounds, seed)
    if method == "ransac":
        h, near = consensus(a, b, tolerance, False, rounds, seed)
        return (h if h is None else refined(h, a[near], b[near])), near
    if method == "lmeds":
        return least_median(a, b, rounds, seed)
    if method == "pure":
        h = direct_linear(a, b)
        return (h if h is None else refined(h, a, b)), everything & (h is not None)
    if method == "goldstandard":
        pick = everything if len(a) <= rounds else np.random.default_rng(seed).choice(len(a), rounds, replace=False)
        h = affine_total(a[pick], b[pick])
        return h, everything & (h is not None)
    raise ValueError(f"no such method: {method}; one of {', '.join(METHODS)}")
