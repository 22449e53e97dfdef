"""Histograms and thresholds of value columns, robust outliers, and voting over masks."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .intensity import histogram
from .labels import AXES


def robust_outliers(df: DataFrame, col: str, k: float = 3.0) -> DataFrame:
    """Rows whose squared residual from the median is above k^2 times 1.4826^2 times its median."""
    m = df.agg(F.median(col).alias("_m"))
    r = df.crossJoin(F.broadcast(m)).withColumn("_r", (F.col(col) - F.col("_m")) ** 2)  # one row
    s = r.agg((F.median("_r") * 1.4826**2 * k * k).alias("_top"))
    return r.crossJoin(F.broadcast(s)).where("_r > _top").select(*df.columns)  # one row


def optimal_histogram(df: DataFrame, col: str) -> DataFrame:
    """(bin, n) of bins 2 IQR n^(-1/3) wide from the minimum; one bin if the quartiles agree."""
    v = df.select(F.col(col).cast("double").alias("v")).where("v is not null and not isnan(v)")
    q = v.agg(F.percentile("v", F.array(F.lit(0.25), F.lit(0.75))).alias("q"), F.count("*").alias("c"), F.min("v").alias("lo"))
    q = q.select("lo", (2 * (F.col("q")[1] - F.col("q")[0]) * F.pow(F.col("c"), F.lit(-1 / 3))).alias("w"))
    b = F.when(F.col("w") > 0, F.floor((F.col("v") - F.col("lo")) / F.col("w"))).otherwise(0).cast("long")
    return v.crossJoin(F.broadcast(q)).groupBy(b.alias("bin")).agg(F.count("*").alias("n"))  # one row


def rosin(df: DataFrame, bins: int = 256) -> DataFrame:
    """One row (threshold): the bin farthest below the chord from the histogram's peak to its last bin; zeros are left out."""
    h = histogram(df.where("v <> 0"), bins)
    p = h.agg(F.max_by(F.struct("bin", "n"), F.struct("n", -F.col("bin"))).alias("p"), F.max_by(F.struct("bin", "n"), "bin").alias("e"))
    j = h.crossJoin(F.broadcast(p)).where("bin >= p.bin")  # one row
    dx, dy = (F.col("e.bin") - F.col("p.bin")) / bins, (F.col("e.n") - F.col("p.n")) / F.col("p.n")
    ax, ay = (F.col("bin") - F.col("p.bin")) / bins, (F.col("n") - F.col("p.n")) / F.col("p.n")
    below = F.round((dy * ax - dx * ay) / F.sqrt(dx * dx + dy * dy + 1e-300), 9)
    return j.select("centre", "bin", below.alias("d")).agg(F.max_by("centre", F.struct("d", -F.col("bin"))).alias("threshold"))


def first_minimum(df: DataFrame, bins: int = 64, smooth: int = 5) -> DataFrame:
    """One row (threshold): the first minimum of the smoothed histogram after its first maximum; null if there is none."""
    w = Window.orderBy("bin")  # bins rows at most
    all_bins = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    m = df.agg(F.min("v").alias("_a"), ((F.max("v") - F.min("v")) / bins).alias("_w"))
    h = all_bins.join(histogram(df, bins).select("bin", "n"), "bin", "left").crossJoin(m).select("bin", (F.col("_a") + (F.col("bin") + 0.5) * F.col("_w")).alias("centre"), F.coalesce("n", F.lit(0)).alias("n"))
    s = h.withColumn("n", F.avg("n").over(w.rowsBetween(-(smooth // 2), smooth // 2)))
    s = s.withColumns({"lo": F.lag("n", 1, 0.0).over(w), "hi": F.lead("n", 1, 0.0).over(w)})
    top = s.where("n > lo and n >= hi").agg(F.min("bin").alias("_t"))
    return s.crossJoin(top).where("bin > _t and n <= lo and n < hi").agg(F.min_by("centre", "bin").alias("threshold"))


def vote_mask(masks: DataFrame, models: int, shape: tuple, tightness: float = 0.5) -> DataFrame:
    """Voxels whose share of votes, in ``models``, reaches the cut between the two most frequent counts.

    ``masks``: (model, z, y, x), a row per vote. tightness 0 cuts just above the lower
    count, 1 at the higher.
    """
    n = shape[0] * shape[1] * shape[2]
    got = masks.select("model", *AXES).distinct()
    share = got.agg(F.countDistinct("model").alias("_k"))
    votes = got.groupBy(*AXES).count().crossJoin(F.broadcast(share)).select(*AXES, F.round(F.col("count") / F.col("_k") * models).cast("int").alias("v"))  # one row
    tab = votes.groupBy("v").agg(F.count("*").alias("c"))
    none = tab.agg((F.lit(n) - F.coalesce(F.sum("c"), F.lit(0))).alias("c")).select(F.lit(0).alias("v"), "c")
    two = tab.unionByName(none).groupBy("v").agg(F.sum("c").alias("c")).orderBy(F.desc("c"), "v").limit(2)
    cut = two.agg(F.min("v").alias("lo"), F.max("v").alias("hi")).select(F.round(F.col("lo") + 1 + tightness * (F.col("hi") - F.col("lo") - 1)).alias("_cut"))
    return votes.crossJoin(F.broadcast(cut)).where("v >= _cut").select(*AXES, "v")  # one row


def crop(df: DataFrame, low: dict, high: dict) -> DataFrame:
    """Rows inside half-open ranges of columns, with those columns counted from the range's start."""
    for c in low:
        df = df.where((F.col(c) >= low[c]) & (F.col(c) < high[c])).withColumn(c, F.col(c) - low[c])
    return df


def frame_statistics(df: DataFrame, by: tuple = ("frame",)) -> DataFrame:
    """n, mean and smallest value (lo) of each frame's v."""
    return df.groupBy(*by).agg(F.avg("v").alias("mean"), F.count("v").alias("n"), F.min("v").alias("lo"))


def frame_thresholds(df: DataFrame, by: tuple = ("frame",), bins: int = 256, at_least: float | None = None, percentile: bool = False, exclude_zero: bool = False, exclude_outliers: float | None = None) -> DataFrame:
    """(frame, thr): Otsu's threshold of each frame's values.

    ``at_least``: only values above it count, and no threshold is below it; with
    ``percentile`` it is each frame's own percentile. ``exclude_zero`` leaves zeros out, and
    the threshold is 0 at least; ``exclude_outliers`` is the k of :func:`robust_outliers`.
    A frame without two different values has a null threshold. Jumps are a matter of
    :func:`.intensity.carry_forward`.
    """
    keys = list(by)
    floor = df.groupBy(*by).agg((F.percentile("v", F.lit(at_least / 100)) if percentile else F.lit(float(at_least))).alias("_f")) if at_least is not None else df.select(*by).distinct().withColumn("_f", F.lit(None).cast("double"))
    v = df.join(floor, keys).where("_f is null or v > _f")
    if exclude_zero:
        v = v.where("v <> 0")
    if exclude_outliers is not None:
        m = v.groupBy(*by).agg(F.median("v").alias("_m"))
        r = v.join(m, keys).withColumn("_r", (F.col("v") - F.col("_m")) ** 2)
        top = r.groupBy(*by).agg((F.median("_r") * 1.4826**2 * exclude_outliers**2).alias("_top"))
        v = r.join(top, keys).where("_r <= _top")
    e = v.groupBy(*by).agg(F.min("v").alias("_a"), ((F.max("v") - F.min("v")) / bins).alias("_w")).where("_w > 0")
    b = F.least(F.floor((F.col("v") - F.col("_a")) / F.col("_w")), F.lit(bins - 1)).cast("int")
    h = v.join(e, keys).groupBy(*by, b.alias("bin"), "_a", "_w").agg(F.count("*").alias("n")).withColumn("centre", F.col("_a") + (F.col("bin") + 0.5) * F.col("_w"))
    up = Window.partitionBy(*by).orderBy("bin")  # bins rows of a frame at most
    full = Window.partitionBy(*by)
    c = h.withColumns({"w0": F.sum("n").over(up), "s0": F.sum(F.col("n") * F.col("centre")).over(up), "w": F.sum("n").over(full), "s": F.sum(F.col("n") * F.col("centre")).over(full)})
    w1 = F.col("w") - F.col("w0")
    c = c.where("w > w0").withColumn("var", F.round(F.col("w0") * w1 * (F.col("s0") / F.col("w0") - (F.col("s") - F.col("s0")) / w1) ** 2, 6))
    best = c.groupBy(*by).agg(F.min(F.struct((-F.col("var")).alias("a"), "centre")).alias("m")).select(*by, F.col("m.centre").alias("thr"))
    low = F.greatest("_f", F.lit(0.0)) if exclude_zero else F.col("_f")
    return floor.join(best, keys, "left").select(*by, F.when(F.col("thr").isNotNull(), F.greatest("thr", low)).alias("thr"))


def frame_masks(df: DataFrame, thresholds: DataFrame, by: tuple = ("frame",), invert: bool = False, at: str = "thr") -> DataFrame:
    """``df`` with thr and on: v above its frame's threshold (below it if ``invert``)."""
    j = df.join(thresholds.select(*by, F.col(at).alias("thr")), list(by))
    return j.withColumn("on", F.col("v") < F.col("thr") if invert else F.col("v") > F.col("thr"))


def binned_gradient(df: DataFrame, shape: tuple, width: float = 10.0, sigma: float = 1.0, smooth: float = 1e-5, shoulder: bool = False) -> DataFrame:
    """One row (threshold): where the mean gradient magnitude by intensity first peaks.

    Intensities are binned from the smallest, ``width`` wide; the means are smoothed by a cubic
    spline. ``shoulder``: the bin before the peak where the spline bends down most. Null
    without a peak or with fewer than two bins.
    """
    from .smooth import gaussian_gradient
    from .stencils import gradient

    low = df.agg(F.min("v").alias("_lo"))
    g = gaussian_gradient(df, sigma, shape) if sigma > 0 else gradient(df)
    size = F.sqrt(sum(F.col(c) ** 2 for c in ("g_z", "g_y", "g_x")))
    j = df.select(*AXES, "v").join(g.select(*AXES, size.alias("g")), list(AXES)).crossJoin(F.broadcast(low))  # one row
    bins = j.groupBy(F.floor((F.col("v") - F.col("_lo")) / width).alias("bin"), "_lo").agg(F.avg("g").alias("g"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        n = int(pdf["bin"].max()) + 1
        out = None
        if n >= 2:
            y = np.zeros(n)
            y[pdf["bin"].astype(int)] = pdf["g"]
            out = _spline_peak(float(pdf["_lo"].iloc[0]) + (np.arange(n) + 0.5) * width, y, smooth, shoulder)
        return pd.DataFrame({"threshold": [out]}, dtype="float64")

    return bins.groupBy("_lo").applyInPandas(run, "threshold double")  # a row for each bin


def _spline_peak(x: np.ndarray, y: np.ndarray, p: float, shoulder: bool) -> float | None:
    """First maximum of the smoothing spline that minimises p * squared residuals + (1 - p) * integral of its squared bend."""
    if len(x) < 3:
        return None
    h = np.diff(x)
    k = np.arange(len(x) - 2)
    q = np.zeros((len(x), len(x) - 2))
    q[k, k], q[k + 1, k], q[k + 2, k] = 1 / h[:-1], -1 / h[:-1] - 1 / h[1:], 1 / h[1:]
    r = np.diag((h[:-1] + h[1:]) / 3) + np.diag(h[1:-1] / 6, 1) + np.diag(h[1:-1] / 6, -1)
    bend = np.zeros(len(x))
    bend[1:-1] = np.linalg.solve(p * r + (1 - p) * q.T @ q, p * (q.T @ y))
    f = y - (1 - p) / p * (q @ bend[1:-1]) if p > 0 else np.poly1d(np.polyfit(x, y, 1))(x)
    for i, w in enumerate(h):
        # the piece's slope is a quadratic in s, the way from x[i]
        a, b = (bend[i + 1] - bend[i]) / (2 * w), bend[i]
        c = (f[i + 1] - f[i]) / w - w * (2 * bend[i] + bend[i + 1]) / 6
        for s in sorted(np.roots([a, b, c])) if abs(a) > 1e-300 else ([-c / b] if b else []):
            if np.isreal(s) and 0 <= np.real(s) <= w and 2 * a * np.real(s) + b < 0:
                top = float(x[i] + np.real(s))
                before = x <= top
                return float(x[before][np.argmin(bend[before])]) if shoulder else top
    return None
