"""Point operators and thresholds on dense volumes (z, y, x, v)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _scalar(df: DataFrame, by: tuple, **aggs: Column) -> DataFrame:
    """``df`` with aggregates of its volume: one row, or one for each key, is joined."""
    s = df.groupBy(*by).agg(*[c.alias(n) for n, c in aggs.items()])
    return df.join(s, list(by)) if by else df.crossJoin(F.broadcast(s))


def normalize_min_max(df: DataFrame, low: Column, high: Column, clip: bool = False, eps: float = 1e-20) -> DataFrame:
    x = (F.col("v") - low) / (high - low + eps)
    return df.withColumn("v", F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0)) if clip else x)


def percentile_normalize(df: DataFrame, pmin: float = 2, pmax: float = 99.8, clip: bool = False, eps: float = 1e-20, by: tuple = ()) -> DataFrame:
    """(v - p_min) / (p_max - p_min + eps), percentiles with linear interpolation."""
    s = _scalar(df, by, _p=F.percentile("v", F.array(F.lit(pmin / 100), F.lit(pmax / 100))))
    return normalize_min_max(s, F.col("_p")[0], F.col("_p")[1], clip, eps).drop("_p")


def adjust_contrast(df: DataFrame, p1: float, p2: float, by: tuple = ()) -> DataFrame:
    """Stretch between two percentiles to 0..1, clipped."""
    return percentile_normalize(df, p1, p2, True, 0.0, by)


def fill_low(df: DataFrame, threshold: float = 0, method: str = "constant", value: float = 0, by: tuple = ()) -> DataFrame:
    """Replace v <= threshold by a constant, or by the median or mean of the rest."""
    low = F.col("v") <= threshold
    if method == "constant":
        return df.withColumn("v", F.when(low, F.lit(float(value))).otherwise(F.col("v")))
    rest = F.when(F.col("v") > threshold, F.col("v"))
    s = _scalar(df, by, _f={"median": F.median(rest), "mean": F.avg(rest)}[method])
    return s.withColumn("v", F.when(low, F.col("_f")).otherwise(F.col("v"))).drop("_f")


def background_correct(df: DataFrame, eps: float = 0.1, by: tuple = ()) -> DataFrame:
    """mean(bg) / (bg + eps) * v, for a table that also has column bg."""
    s = _scalar(df, by, _m=F.avg("bg"))
    return s.withColumn("v", F.col("_m") / (F.col("bg") + eps) * F.col("v")).drop("_m")


def histogram(df: DataFrame, bins: int = 256) -> DataFrame:
    """(bin, n, centre) of equal bins between the extremes; only bins with values."""
    s = _scalar(df.select("v"), (), _a=F.min("v"), _b=F.max("v"))
    width = (F.col("_b") - F.col("_a")) / bins
    b = F.when(width == 0, 0).otherwise(F.least(F.floor((F.col("v") - F.col("_a")) / width), F.lit(bins - 1))).cast("int")
    h = s.groupBy(b.alias("bin"), "_a", (width).alias("_w")).agg(F.count("*").alias("n"))
    return h.select("bin", "n", (F.col("_a") + (F.col("bin") + 0.5) * F.col("_w")).alias("centre"))


def otsu(df: DataFrame, bins: int = 256) -> DataFrame:
    """One row (threshold): the bin centre of the largest between-class variance, the first among equals."""
    w = Window.orderBy("bin")  # bins rows at most
    c = histogram(df, bins).withColumns({"w0": F.sum("n").over(w), "s0": F.sum(F.col("n") * F.col("centre")).over(w)})
    full = Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    c = c.withColumns({"w": F.sum("n").over(full), "s": F.sum(F.col("n") * F.col("centre")).over(full)})
    w1 = F.col("w") - F.col("w0")
    var = F.when(w1 > 0, F.round(F.col("w0") * w1 * (F.col("s0") / F.col("w0") - (F.col("s") - F.col("s0")) / w1) ** 2, 6))
    return c.withColumn("var", var).agg(F.min(F.struct((-F.coalesce("var", F.lit(-1.0))).alias("a"), "centre")).alias("b")).select(F.col("b.centre").alias("threshold"))


def multi_otsu(df: DataFrame, bins: int = 256) -> DataFrame:
    """One row (low, high): the two cuts between three classes of the largest between-class variance."""
    w = Window.orderBy("bin")  # bins rows at most
    c = histogram(df, bins).withColumns({"w0": F.sum("n").over(w).cast("double"), "s0": F.sum(F.col("n") * F.col("centre")).over(w)})
    t = c.agg(F.max("w0").alias("w"), F.max_by("s0", "bin").alias("s"))
    a, b = c.selectExpr("bin as i", "centre as low", "w0 as wa", "s0 as sa"), c.selectExpr("bin as j", "centre as high", "w0 as wb", "s0 as sb")
    p = a.join(b, F.col("i") < F.col("j")).crossJoin(t).where("wb < w")  # pairs of bins
    part = lambda s, w: s * s / w
    var = part(F.col("sa"), F.col("wa")) + part(F.col("sb") - F.col("sa"), F.col("wb") - F.col("wa")) + part(F.col("s") - F.col("sb"), F.col("w") - F.col("wb"))
    return p.agg(F.min(F.struct((-F.round(var, 3)).alias("a"), "low", "high")).alias("b")).select("b.low", "b.high")


def carry_forward(frames: DataFrame, max_jump: float = 1.5, by: str = "channel") -> DataFrame:
    """(channel, frame, thr, used): a threshold that jumps too far from the last good one is replaced by it.

    Acceptance depends on what was accepted before, so each channel's frames are folded in
    order. A null threshold is a failed one; before the first good one used is null.
    """
    rows = F.array_sort(F.collect_list(F.struct("frame", "thr")))
    start = F.struct(F.lit(None).cast("double").alias("good"), F.array().cast("array<struct<frame:int,thr:double,used:double>>").alias("out"))

    def step(acc, x):
        ok = x["thr"].isNotNull() & (acc["good"].isNull() | (F.abs(x["thr"] / acc["good"] - 1) <= max_jump - 1))
        good = F.when(ok, x["thr"]).otherwise(acc["good"])
        row = F.struct(x["frame"].cast("int").alias("frame"), x["thr"].cast("double").alias("thr"), good.cast("double").alias("used"))
        return F.struct(good.cast("double").alias("good"), F.concat(acc["out"], F.array(row)).alias("out"))

    g = frames.groupBy(by).agg(rows.alias("r"))
    return g.select(by, F.explode(F.aggregate("r", start, step, lambda a: a["out"])).alias("x")).select(by, "x.frame", "x.thr", "x.used")
