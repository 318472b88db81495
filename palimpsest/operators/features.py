"""Block features. Closed forms are sums over (image_id, block_y, block_x, y, x, g) rows, y and x within the block; forms that need a
decomposition are numpy kernels over the packed tier."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.functions import keypoints as K
from palimpsest.functions.arrays import quotient
from palimpsest.functions.log_polar import fourier_mellin
from palimpsest.operators import raster as R
from palimpsest.session import prepare

KEY = ["image_id", "block_y", "block_x"]


def blocks(pixels: DataFrame, height: int, width: int, size: int, step: int, value: str = "g", regions: list[tuple[int, int, int, int]] | None = None) -> DataFrame:
    """Every size x size window at a step; each pixel goes to the few windows that cover it. regions: (y0, x0, y1, x1) that windows must lie in."""

    def starts(p: Column, n: int) -> Column:
        low = F.greatest(F.ceil((p - (size - 1)) / step), F.lit(0)).cast("int")
        high = F.least(F.floor(p / step), F.lit((n - size) // step)).cast("int")
        return F.when(low <= high, F.transform(F.sequence(low, high), lambda i: i * step)).otherwise(F.array().cast("array<int>"))

    rows = pixels.withColumn("block_y", F.explode(starts(F.col("y"), height))).withColumn("block_x", F.explode(starts(F.col("x"), width)))
    if regions is not None:
        inside = F.lit(False)
        for y0, x0, y1, x1 in regions:
            inside = inside | ((F.col("block_y") >= y0) & (F.col("block_x") >= x0) & (F.col("block_y") + size <= y1) & (F.col("block_x") + size <= x1))
        rows = rows.filter(inside)
    return rows.select(*KEY, (F.col("y") - F.col("block_y")).alias("y"), (F.col("x") - F.col("block_x")).alias("x"), F.col(value).alias("g"))


def _sum(condition: Column) -> Column:
    return F.sum(F.when(condition, F.col("g")).otherwise(0)).cast("double")


def luo(cells: DataFrame, size: int) -> DataFrame:
    """Mean, and the shares of the top half, left half and the two triangles against the rest."""
    y, x, half = F.col("y"), F.col("x"), size // 2
    parts = {"f1": y < half, "f2": x < half, "f3": x >= y, "f4": x < size - y}
    sums = cells.groupBy(*KEY).agg(F.avg("g").alias("f0"), F.sum("g").cast("double").alias("all"), *[_sum(c).alias(n) for n, c in parts.items()])
    return sums.select(*KEY, "f0", *[quotient(F.col(n), F.col("all")).alias(n) for n in parts])


def lin(cells: DataFrame, size: int) -> DataFrame:
    """Whole mean; each quarter's share of the sum of quarter means; and each quarter's difference to the mean, from its least to its greatest as 0 to 255."""
    y, x, half = F.col("y"), F.col("x"), size // 2
    quarters = {"q0": (y < half) & (x < half), "q1": (y < half) & (x >= half), "q2": (y >= half) & (x < half), "q3": (y >= half) & (x >= half)}
    means = cells.groupBy(*KEY).agg(F.avg("g").alias("m"), *[F.avg(F.when(c, F.col("g"))).alias(n) for n, c in quarters.items()])
    total = F.expr("q0 + q1 + q2 + q3")
    d = {n: F.col(n) - F.col("m") for n in quarters}
    low, high = F.least(*d.values()), F.greatest(*d.values())
    ratios = [F.floor(quotient(F.col(n), total) * 255).cast("double").alias(f"f{i + 1}") for i, n in enumerate(quarters)]
    spread = [F.floor(quotient((v - low) * 255, high - low)).cast("double").alias(f"f{i + 5}") for i, v in enumerate(d.values())]
    return means.select(*KEY, F.floor("m").cast("double").alias("f0"), *ratios, *spread)


def _radius2(size: int) -> Column:
    c = (size - 1) / 2
    return (F.col("y") - c) * (F.col("y") - c) + (F.col("x") - c) * (F.col("x") - c)


def circle(cells: DataFrame, size: int) -> DataFrame:
    """Means over discs of radius 1 to half the side."""
    radii = range(1, size // 2 + 1)
    return cells.groupBy(*KEY).agg(*[F.avg(F.when(_radius2(size) <= r * r, F.col("g"))).alias(f"f{r - 1}") for r in radii])


def bravo(cells: DataFrame, size: int, bins: int = 8) -> DataFrame:
    """Disc mean and the entropy of the block's values."""
    mean = cells.filter(_radius2(size) <= (size / 2) ** 2).groupBy(*KEY).agg(F.avg("g").alias("f0"))
    bits = R.entropy(cells.withColumn("bin", F.expr(f"g div {bins}")), KEY, "bin")
    return mean.join(bits, KEY).withColumnRenamed("entropy", "f1")


def hu(cells: DataFrame, number: int = 4) -> DataFrame:
    """The first invariant moments of the block's values, from central moments up to the third order."""
    y, x, g = F.col("y"), F.col("x"), F.col("g").cast("double")
    raw = cells.groupBy(*KEY).agg(*[F.sum(g * F.pow(x.cast("double"), F.lit(p)) * F.pow(y.cast("double"), F.lit(q))).alias(f"m{p}{q}") for p in range(4) for q in range(4 - p)])
    cx, cy = quotient(F.col("m10"), F.col("m00")), quotient(F.col("m01"), F.col("m00"))
    c = raw.withColumns({"cx": cx, "cy": cy})
    c = c.withColumns({"u20": F.expr("m20 - cx * m10"), "u02": F.expr("m02 - cy * m01"), "u11": F.expr("m11 - cx * m01"), "u30": F.expr("m30 - 3 * cx * m20 + 2 * cx * cx * m10"), "u03": F.expr("m03 - 3 * cy * m02 + 2 * cy * cy * m01"), "u21": F.expr("m21 - 2 * cx * m11 - cy * m20 + 2 * cx * cx * m01"), "u12": F.expr("m12 - 2 * cy * m11 - cx * m02 + 2 * cy * cy * m10")})
    n = lambda p, q: quotient(F.col(f"u{p}{q}"), F.pow("m00", F.lit(1 + (p + q) / 2)))
    c = c.withColumns({f"n{p}{q}": n(p, q) for p, q in ((2, 0), (0, 2), (1, 1), (3, 0), (0, 3), (2, 1), (1, 2))})
    all_ = [
        "n20 + n02",
        "(n20 - n02) * (n20 - n02) + 4 * n11 * n11",
        "(n30 - 3 * n12) * (n30 - 3 * n12) + (3 * n21 - n03) * (3 * n21 - n03)",
        "(n30 + n12) * (n30 + n12) + (n21 + n03) * (n21 + n03)",
        "(n30 - 3 * n12) * (n30 + n12) * ((n30 + n12) * (n30 + n12) - 3 * (n21 + n03) * (n21 + n03)) + (3 * n21 - n03) * (n21 + n03) * (3 * (n30 + n12) * (n30 + n12) - (n21 + n03) * (n21 + n03))",
        "(n20 - n02) * ((n30 + n12) * (n30 + n12) - (n21 + n03) * (n21 + n03)) + 4 * n11 * (n30 + n12) * (n21 + n03)",
        "(3 * n21 - n03) * (n30 + n12) * ((n30 + n12) * (n30 + n12) - 3 * (n21 + n03) * (n21 + n03)) - (n30 - 3 * n12) * (n21 + n03) * (3 * (n30 + n12) * (n30 + n12) - (n21 + n03) * (n21 + n03))",
    ]
    return c.select(*KEY, *[F.expr(e).alias(f"f{i}") for i, e in enumerate(all_[:number])])


def zernike_basis(size: int, degree: int) -> list[tuple[int, int, int, int, float, float]]:
    """(y, x, n, m, re, im) over the unit disc, of n <= degree, m >= 0, n - m even."""
    out = []
    for y in range(size):
        for x in range(size):
            u, v = (2 * x - size + 1) / size, (2 * y - size + 1) / size
            rho, theta = math.hypot(u, v), math.atan2(v, u)
            if rho > 1:
                continue
            for n in range(degree + 1):
                for m in range(n % 2, n + 1, 2):
                    radial = sum((-1) ** s * math.factorial(n - s) / (math.factorial(s) * math.factorial((n + m) // 2 - s) * math.factorial((n - m) // 2 - s)) * rho ** (n - 2 * s) for s in range((n - m) // 2 + 1))
                    scale = (n + 1) / math.pi * (2 / size) ** 2
                    out.append((y, x, n, m, scale * radial * math.cos(m * theta), -scale * radial * math.sin(m * theta)))
    return out


def zernike(cells: DataFrame, size: int, degree: int = 5) -> DataFrame:
    """image_id, block_y, block_x, n, m, magnitude: a join with the basis table, whose size is fixed by the block's."""
    basis = cells.sparkSession.createDataFrame(zernike_basis(size, degree), "y int, x int, n int, m int, re double, im double")
    sums = cells.join(F.broadcast(basis), ["y", "x"]).groupBy(*KEY, "n", "m").agg(F.sum(F.expr("g * re")).alias("re"), F.sum(F.expr("g * im")).alias("im"))
    return sums.select(*KEY, "n", "m", F.sqrt(F.expr("re * re + im * im")).alias("magnitude"))


def dct_basis(size: int) -> list[tuple[int, int, int, int, float]]:
    a = lambda k: math.sqrt((1 if k == 0 else 2) / size)
    c = lambda k, i: a(k) * math.cos(math.pi * (2 * i + 1) * k / (2 * size))
    return [(y, x, u, v, c(u, y) * c(v, x)) for y in range(size) for x in range(size) for u in range(size) for v in range(size)]


def dct(cells: DataFrame, size: int, step: float = 16.0) -> DataFrame:
    """image_id, block_y, block_x, u, v, q: cosine coefficients, coarser with frequency, rounded half up."""
    basis = cells.sparkSession.createDataFrame(dct_basis(size), "y int, x int, u int, v int, w double")
    sums = cells.join(F.broadcast(basis), ["y", "x"]).groupBy(*KEY, "u", "v").agg(F.sum(F.expr("g * w")).alias("c"))
    return sums.select(*KEY, "u", "v", F.floor(F.col("c") / (step * (1 + F.col("u") + F.col("v"))) + 0.5).cast("long").alias("q"))


def _blur_invariants(blocks: np.ndarray) -> np.ndarray:
    """(n, 18) of n square blocks: central moments of odd order up to 7, made invariant to a symmetric blur by the known recursion."""
    y, x = np.indices(blocks.shape[1:]).astype(float)
    m = blocks.sum(axis=(1, 2))
    m = np.where(m == 0, 1.0, m)
    u, v = (a - (blocks * a).sum(axis=(1, 2))[:, None, None] / m[:, None, None] for a in (x, y))
    side = range(8)
    us, vs = np.stack([u**p for p in side], axis=1), np.stack([v**q for q in side], axis=1)
    mu = {(p, q): (blocks * us[:, p] * vs[:, q]).sum(axis=(1, 2)) for p in side for q in range(8 - p)}
    known: dict[tuple[int, int], np.ndarray] = {}
    for o in (1, 3, 5, 7):
        for p in range(o + 1):
            q, rest = o - p, np.zeros(len(blocks))
            for n in range(p + 1):
                for k in range(q + 1):
                    if 0 < n + k < o and (n + k) % 2 == 0:  # invariants of even order are 0
                        rest = rest + math.comb(p, n) * math.comb(q, k) * known[p - n, q - k] * mu[n, k]
            known[p, q] = mu[p, q] - rest / m
    return np.stack([known[p, o - p] for o in (3, 5, 7) for p in range(o + 1)], axis=1)


def _haar_bands(block: np.ndarray) -> np.ndarray:
    out, low = [], block
    while low.shape[0] > 1:
        a, b, c, d = low[::2, ::2], low[::2, 1::2], low[1::2, ::2], low[1::2, 1::2]
        out.insert(0, np.concatenate([z.ravel() / 2 for z in (a - b + c - d, a + b - c - d, a - b - c + d)]))
        low = (a + b + c + d) / 2
    return np.concatenate([low.ravel(), *out])


def _orientations(block: np.ndarray, cells: int = 2, bins: int = 8) -> np.ndarray:
    """Gradient orientations by cell, weighted by magnitude; unit length, large entries cut and unit again."""
    gy, gx = np.gradient(block)
    bin_ = ((np.arctan2(gy, gx) + np.pi) / (2 * np.pi) * bins).astype(int) % bins
    y, x = np.indices(block.shape)
    cell = (y * cells // block.shape[0]) * cells + x * cells // block.shape[1]
    out = np.bincount((cell * bins + bin_).ravel(), weights=np.hypot(gy, gx).ravel(), minlength=cells * cells * bins)
    for cut in (0.2, None):
        size = np.linalg.norm(out)
        out = out / size if size > 0 else out
        out = np.minimum(out, cut) if cut else out
    return out


#: Features by name, block -> vector; sides are powers of two.
KERNELS = {
    "NO": lambda b: b.ravel(),
    "SVD": lambda b: np.linalg.svd(b, compute_uv=False),
    "DWTFEAT": _haar_bands,
    "FMT": fourier_mellin,
    "BLUR": lambda b: _blur_invariants(b[None])[0],
    "DSIFT": _orientations,
}


#: Those that take many blocks at once, (n, size, size) -> (n, length).
BATCHED = {"NO": lambda b: b.reshape(len(b), -1), "SVD": lambda b: np.linalg.svd(b, compute_uv=False), "BLUR": _blur_invariants}


def block_vectors(packed: DataFrame, kernel: str, size: int, step: int) -> DataFrame:
    """image_id, block_y, block_x, vec by one of KERNELS; images of one size are worked on together."""
    prepare(packed.sparkSession)
    make, kind = KERNELS[kernel], dict(packed.dtypes)["image_id"]
    together = BATCHED.get(kernel, lambda blocks: [make(b) for b in blocks])

    def run(batches):
        for pdf in batches:
            for ids, stack in R.alike(pdf):
                if min(stack.shape[1:]) < size:
                    continue
                windows = np.lib.stride_tricks.sliding_window_view(stack, (size, size), axis=(1, 2))[:, ::step, ::step]
                n, ny, nx = windows.shape[:3]
                by, bx = np.indices((ny, nx), dtype=np.int32).reshape(2, -1) * step
                for row in range(0, n, per := max(1, R.TOGETHER // (ny * nx * size * size))):
                    own = windows[row : row + per]
                    vec = together(np.ascontiguousarray(own).reshape(-1, size, size))
                    yield pd.DataFrame({"image_id": np.repeat(ids[row : row + per], ny * nx), "block_y": np.tile(by, len(own)), "block_x": np.tile(bx, len(own)), "vec": list(vec)})

    return packed.select("image_id", "height", "width", "values").mapInPandas(run, f"image_id {kind}, block_y int, block_x int, vec array<double>")


def covariance(vectors: DataFrame, dim: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Mean, covariance and number of vectors; partial sums, so dim (dim + 1) / 2 + dim numbers meet."""
    cells = vectors.select(F.posexplode("vec").alias("i", "a"), "vec").select("i", "a", F.posexplode("vec").alias("j", "b")).filter("j >= i")
    sums = cells.groupBy("i", "j").agg(F.sum(F.col("a") * F.col("b")).alias("s"), F.sum("a").alias("a"), F.count(F.lit(1)).alias("n")).collect()
    n = sums[0]["n"] if sums else 0
    mean, second = np.zeros(dim), np.zeros((dim, dim))
    for r in sums:
        second[r["i"], r["j"]] = second[r["j"], r["i"]] = r["s"] / n
        if r["j"] == dim - 1:
            mean[r["i"]] = r["a"] / n
    return mean, second - np.outer(mean, mean), n


def reduce_by_pca(vectors: DataFrame, dim: int, keep: int | None = None, error: float = 0.01) -> DataFrame:
    """Vectors on the leading axes: `keep` of them, or as many as leave at most that share of the variance."""
    mean, cov, n = covariance(vectors, dim)
    if not n:
        return vectors
    values, axes = np.linalg.eigh(cov)
    values, axes = values[::-1], axes[:, ::-1]
    axes = axes * np.where(axes[np.abs(axes).argmax(axis=0), np.arange(dim)] < 0, -1, 1)
    if keep is None:
        share = np.cumsum(np.maximum(values, 0)) / max(values.clip(0).sum(), 1e-300)
        keep = int(np.searchsorted(share, 1 - error) + 1)
    sparkless = [F.aggregate(F.zip_with("vec", F.array(*[F.lit(float(w)) for w in axes[:, k]]), lambda x, w: x * w), F.lit(float(-mean @ axes[:, k])), lambda s, x: s + x) for k in range(min(keep, dim))]
    return vectors.withColumn("vec", F.array(*sparkless))


def reduce_by_kernel_pca(vectors: DataFrame, key: list[str], train: int, keep: int, sigma: float = 25.0, seed: int = 0) -> DataFrame:
    """Gaussian kernel PCA on `train` seeded training vectors, a documented bound; all vectors are projected."""
    spark = prepare(vectors.sparkSession)
    rows = vectors.orderBy(F.xxhash64(*key, F.lit(seed)), *key).limit(train).select("vec").collect()
    base = np.array([r[0] for r in rows], dtype=float)
    k = np.exp(-((base[:, None] - base[None]) ** 2).sum(axis=2) / (2 * sigma**2))
    centred = k - k.mean(axis=0) - k.mean(axis=1)[:, None] + k.mean()
    values, axes = np.linalg.eigh(centred)
    order = np.argsort(values)[::-1][:keep]
    values, axes = values[order], axes[:, order]
    axes = axes / np.sqrt(np.maximum(values, 1e-12))
    sent = spark.sparkContext.broadcast((base, k.mean(axis=0), k.mean(), axes))

    def run(batches):
        points, column, mean, w = sent.value
        for pdf in batches:
            v = np.array(pdf["vec"].tolist(), dtype=float).reshape(len(pdf), -1)
            q = np.exp(-((v[:, None] - points[None]) ** 2).sum(axis=2) / (2 * sigma**2)) if len(v) else np.zeros((0, len(points)))
            pdf = pdf.assign(vec=((q - q.mean(axis=1)[:, None] - column + mean) @ w).tolist())
            yield pdf

    return vectors.mapInPandas(run, vectors.schema)


def keypoints(packed: DataFrame, contrast: float = 0.04) -> DataFrame:
    """image_id, id (from 0), y, x, gray, scale, octave, theta (radians), vec (128 values): keypoints of each image; one image a task."""
    prepare(packed.sparkSession)
    kind = dict(packed.dtypes)["image_id"]

    def run(batches):
        for pdf in batches:
            for row in pdf.itertuples():
                image = np.asarray(row.values, dtype=float).reshape(row.height, row.width)
                found = K.keypoints(image, contrast)
                gray = [int(image[min(row.height - 1, round(k.y)), min(row.width - 1, round(k.x))]) for k in found]
                yield pd.DataFrame(
                    [(row.image_id, i, k.y, k.x, g, k.scale, k.octave, k.theta, k.vec.tolist()) for i, (k, g) in enumerate(zip(found, gray, strict=True))],
                    columns=["image_id", "id", "y", "x", "gray", "scale", "octave", "theta", "vec"],
                )

    return packed.select("image_id", "height", "width", "values").mapInPandas(run, f"image_id {kind}, id long, y double, x double, gray int, scale double, octave int, theta double, vec array<double>")
