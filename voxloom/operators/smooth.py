"""One-dimensional kernels along the axes of dense volumes, resizing, and what is made of them.

Every pass is one window over rows mirrored at the ends of a line, so a task holds lines of
the volume and no more. ``by`` names the key columns of a table with several volumes.
"""

from __future__ import annotations

from itertools import product

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .intensity import background_correct, percentile_normalize
from .kernels import gaussian_weights
from .stencils import AXES, by_tiles, difference_of_means


def grid(spark: SparkSession, shape: tuple[int, int, int]) -> DataFrame:
    """All cells (z, y, x) of a volume."""
    nz, ny, nx = shape
    rows = spark.range(nz * ny).selectExpr(f"cast(id div {ny} as int) z", f"cast(id % {ny} as int) y")
    return rows.select("z", "y", F.explode(F.sequence(F.lit(0), F.lit(nx - 1))).alias("x"))


def densify(cells: DataFrame, shape: tuple[int, int, int], **fill) -> DataFrame:
    """``cells`` with the missing ones added, their columns filled as given; cells are sorted for it and never broadcast."""
    d = grid(cells.sparkSession, shape).join(cells.select(*AXES, *fill).hint("merge"), list(AXES), "left")
    return d.withColumns({c: F.coalesce(c, F.lit(v)) for c, v in fill.items()})


def mirrored(axis: str, n: int, before: int, after: int, border: str = "symmetric") -> Column:
    """Places from -before to n + after - 1 that show cell ``axis``: symmetric repeats the edge cell, reflect does not."""
    here, period = F.col(axis), 2 * n if border == "symmetric" else max(1, 2 * n - 2)
    turns = range(-(before // period) - 1, (after + n) // period + 2)
    other = -1 - here if border == "symmetric" else -here
    places = F.array_distinct(F.array(*[x + period * k for k in turns for x in (here, other)]))
    return F.filter(places, lambda q: (q >= -before) & (q < n + after))


def correlate(df: DataFrame, cols: list[str], weights, axis: str, n: int, by: tuple = (), rest: tuple = AXES, border: str = "symmetric") -> DataFrame:
    """Replace ``cols`` by sums of neighbours along an axis, times odd weights."""
    r = len(weights) // 2
    if r == 0:
        return df.withColumns({c: F.col(c) * float(weights[0]) for c in cols})
    padded = df.withColumn("_at", F.explode(mirrored(axis, n, r, r, border)))
    w = Window.partitionBy(*by, *[a for a in rest if a != axis]).orderBy("_at")
    near = lambda c, k: F.lead(c, k).over(w) if k >= 0 else F.lag(c, -k).over(w)
    sums = {c: sum(float(x) * near(c, k - r) for k, x in enumerate(weights) if x) for c in cols}
    return padded.withColumns(sums).where(f"_at >= 0 and _at < {n}").withColumn(axis, F.col("_at").cast("int")).drop("_at")


def gaussian(df: DataFrame, cols: list[str], sigma, shape: tuple, by: tuple = (), truncate: float = 4.0, border: str = "symmetric", axes: tuple = AXES) -> DataFrame:
    """Separable Gaussian, one sigma or one for each axis; sigma 0 leaves an axis as it is.

    Radius int(truncate sigma + 0.5). A truncate of 3 with border reflect is the other
    convention in use.
    """
    for a, n, s in zip(axes, shape, sigma if isinstance(sigma, (tuple, list)) else [sigma] * len(axes)):
        if s > 0:
            df = correlate(df, cols, gaussian_weights(float(s), truncate), a, n, by, axes, border)
    return df


def gaussian_gradient(df: DataFrame, sigma: float, shape: tuple, by: tuple = ()) -> DataFrame:
    """Columns g_z, g_y, g_x: correlation with derivatives of a Gaussian along one axis and Gaussians along the others."""
    g = gaussian_weights(sigma, 3.0)
    r = len(g) // 2
    slope = np.arange(-r, r + 1) / sigma**2 * g
    out = df
    for a in AXES:
        part = df.select(*by, *AXES, F.col("v").alias(f"g_{a}"))
        for b, n in zip(AXES, shape):
            part = correlate(part, [f"g_{a}"], slope if a == b else g, b, n, by, border="reflect")
        out = out.join(part, [*by, *AXES])
    return out


def sobel(df: DataFrame, shape: tuple[int, int], by: tuple = ("z",)) -> DataFrame:
    """Edge magnitude of each slice: the root mean square of the two Sobel derivatives."""
    plane, parts = ("y", "x"), []
    for a in plane:
        e = df.select(*by, *plane, F.col("v").alias(f"_e{a}"))
        for b, n in zip(plane, shape):
            e = correlate(e, [f"_e{a}"], (-0.5, 0, 0.5) if a == b else (0.25, 0.5, 0.25), b, n, by, plane)
        parts.append(e)
    j = parts[0].join(parts[1], [*by, *plane])
    return j.select(*by, *plane, F.sqrt((F.col("_ey") ** 2 + F.col("_ex") ** 2) / 2).alias("v"))


def median_filter(df: DataFrame, size: int, shape: tuple, by: tuple = ()) -> DataFrame:
    """Median of the cube ``size`` wide around each voxel, edges repeated; tile by tile, in a plane at a time."""
    lo, hi = size // 2, (size - 1) // 2

    def run(a: np.ndarray) -> np.ndarray:
        near = np.lib.stride_tricks.sliding_window_view(np.pad(a, (lo, hi), mode="symmetric"), (size,) * 3)
        median = np.nanmedian if np.isnan(a).any() else np.median
        return np.stack([median(p.reshape(*p.shape[:2], -1), axis=2) for p in near])

    return by_tiles(df, run, lo, by)


def _positions(n: int, m: int, corners: bool, nearest: bool) -> list[tuple[int, int, float]]:
    """(target, source, weight): cell centres aligned, or the corner cells if ``corners``."""
    out = []
    for t in range(m):
        p = t * (n - 1) / max(1, m - 1) if corners else (t + 0.5) * n / m - 0.5
        if nearest:
            out.append((t, int(min(n - 1, max(0, np.floor(p + 0.5)))), 1.0))
            continue
        p = min(max(p, 0.0), n - 1.0)
        i = int(np.floor(p))
        out += [(t, j, w) for j, w in ((i, 1 - (p - i)), (min(i + 1, n - 1), p - i)) if w > 0]
    return out


def resize(df: DataFrame, cols: list[str], shape: tuple, to: tuple, by: tuple = (), corners: bool = False, nearest: bool = False) -> DataFrame:
    """Linear (or nearest) resampling of a dense volume from ``shape`` to ``to``, axis by axis.

    The map of an axis has two rows for each of its new cells, so it is sent to all tasks.
    """
    spark = df.sparkSession
    for a, n, m in zip(AXES, shape, to):
        if n == m:
            continue
        where = spark.createDataFrame(_positions(n, m, corners, nearest), "_t int, _s int, _w double")
        j = df.join(F.broadcast(where), F.col(a) == F.col("_s"))
        rest = [x for x in AXES if x != a]
        df = j.groupBy(*by, *rest, F.col("_t").alias(a)).agg(*[F.sum(F.col(c) * F.col("_w")).alias(c) for c in cols])
    return df.select(*by, *AXES, *cols)


def resize_labels(labels: DataFrame, shape: tuple, to: tuple, by: tuple = ()) -> DataFrame:
    """Nearest-cell resampling of a sparse label table."""
    spark = labels.sparkSession
    for a, n, m in zip(AXES, shape, to):
        where = spark.createDataFrame([(t, s) for t, s, _ in _positions(n, m, False, True)], "_t int, _s int")
        labels = labels.join(F.broadcast(where), F.col(a) == F.col("_s")).withColumn(a, F.col("_t")).drop("_t", "_s")
    return labels


def smooth_volume(df: DataFrame, factor: int, sigma, shape: tuple, by: tuple = ()) -> DataFrame:
    """Background estimate: block means, a Gaussian on the small volume, and linear resampling back."""
    small = tuple(max(1, n // factor) for n in shape)
    cell = lambda a, n, m: F.floor(F.col(a) * m / n).cast("int").alias(a)
    s = df.groupBy(*by, *[cell(a, n, m) for a, n, m in zip(AXES, shape, small)]).agg(F.avg("v").alias("v"))
    return resize(gaussian(s, ["v"], sigma, small, by), ["v"], small, shape, by)


def flat_field(df: DataFrame, factor: int, sigma: float, shape: tuple, by: tuple = ()) -> DataFrame:
    """Divide by the background estimate and stretch between the percentiles 2 and 99.8, clipped."""
    bg = smooth_volume(df.select(*by, *AXES, "v"), factor, sigma, shape, by).withColumnRenamed("v", "bg")
    return percentile_normalize(background_correct(df.join(bg, [*by, *AXES]), by=by).drop("bg"), clip=True, by=by)


def combine_by_contrast(views: list[DataFrame], size: int, shape: tuple, eps: float = 1e-20) -> DataFrame:
    """Views fused with the z-scored difference to their box mean, cut to 0..4, as weight."""
    out = None
    for v in views:
        d = difference_of_means(v.select(*AXES, "v"), size, shape).withColumnRenamed("v", "w")
        p = v.select(*AXES, "v").join(d, list(AXES)).withColumn("w", F.least(F.greatest("w", F.lit(0.0)), F.lit(4.0)))
        out = p if out is None else out.unionByName(p)
    return out.groupBy(*AXES).agg((F.sum(F.col("v") * F.col("w")) / (F.sum("w") + eps)).alias("v"))


def combine_by_entropy(views: list[DataFrame], size: int, shape: tuple, alpha: float = 0.5, eps: float = 1e-20, bins: int = 256) -> DataFrame:
    """Views fused with weights 1 / (local entropy + alpha); the entropy in bits of the values, in bins, within a ball."""
    ball = [o for o in product(range(-size, size + 1), repeat=3) if sum(d * d for d in o) <= size * size]
    steps = F.array(*[F.struct(*[F.lit(d).alias(k) for k, d in zip("ijk", o)]) for o in ball])
    inside, out = " and ".join(f"{a} >= 0 and {a} < {n}" for a, n in zip(AXES, shape)), None
    for v in views:
        m = v.agg(F.min("v").alias("_lo"), F.max("v").alias("_hi"))
        q = v.crossJoin(F.broadcast(m)).select(*AXES, F.floor((F.col("v") - F.col("_lo")) / (F.col("_hi") - F.col("_lo") + 1e-20) * (bins - 1)).alias("q"))  # one row
        near = q.select(*AXES, "q", F.explode(steps).alias("o")).select(*[(F.col(a) + F.col(f"o.{k}")).cast("int").alias(a) for a, k in zip(AXES, "ijk")], "q").where(inside)
        n = near.groupBy(*AXES, "q").count().groupBy(*AXES).agg(F.sum("count").alias("t"), F.sum(F.col("count") * F.log2("count")).alias("s"))
        p = v.select(*AXES, "v").join(n, list(AXES)).select(*AXES, "v", (1 / (F.log2("t") - F.col("s") / F.col("t") + alpha)).alias("w"))
        out = p if out is None else out.unionByName(p)
    return out.groupBy(*AXES).agg((F.sum(F.col("v") * F.col("w")) / (F.sum("w") + eps)).alias("v"))


def moving_average(df: DataFrame, size: int, n: int, at: str = "i", by: tuple = ()) -> DataFrame:
    """Centred means of v over ``size`` rows of a series 0..n-1, mirrored without its end rows."""
    half = size // 2
    padded = df.withColumn("_at", F.explode(mirrored(at, n, half, half, "reflect")))
    w = Window.partitionBy(*(by or [F.lit(0)])).orderBy("_at").rowsBetween(-half, half)
    return padded.withColumn("v", F.avg("v").over(w)).where(f"_at >= 0 and _at < {n}").withColumn(at, F.col("_at").cast("int")).drop("_at")
