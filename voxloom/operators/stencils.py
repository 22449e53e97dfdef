"""Local filters on dense volumes (z, y, x, value columns).

Box means run along one axis at a time as window functions over rows mirrored at the
border (the edge value repeated), so memory is bounded by a line of the volume. Filters that are
no sums take tiles with a halo as arrays.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

AXES = ("z", "y", "x")


def with_tiles(df: DataFrame, axes: tuple, tile: int, halo: int, shape: tuple | None = None) -> DataFrame:
    """A row of ``df`` for each tile that holds its cell or has it in its halo; columns _t and the axis number tiles from 0 (within ``shape``)."""
    for k, a in enumerate(axes):
        first, last = (F.floor((F.col(a) + d) / tile).cast("int") for d in (-halo, halo))
        last = F.least(last, F.lit((shape[k] - 1) // tile)) if shape else last
        df = df.withColumn(f"_t{a}", F.explode(F.sequence(F.greatest(first, F.lit(0)), last)))
    return df


def by_tiles(df: DataFrame, fn, halo: int, by: tuple = (), axes: tuple = AXES, tile: int = 64) -> DataFrame:
    """(by, axes, v): ``fn`` of dense arrays of v, which keeps their shape, tile by tile.

    A cell's result depends on cells at most ``halo`` away; an array ends at the latest where the volume ends.
    """
    rows = with_tiles(df.select(*by, *axes, F.col("v").cast("double").alias("v")), axes, tile, halo)
    keys = [*by, *[f"_t{a}" for a in axes]]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        at = pdf[list(axes)].to_numpy()
        first = pdf[[f"_t{a}" for a in axes]].iloc[0].to_numpy(np.int64) * tile
        own = ((at >= first) & (at < first + tile)).all(axis=1)
        if not own.any():
            return pdf[[*by, *axes, "v"]][own]
        low = at.min(axis=0)
        v = np.zeros(at.max(axis=0) - low + 1)
        v[tuple((at - low).T)] = pdf["v"]
        return pdf[[*by, *axes]][own].assign(v=fn(v)[tuple((at[own] - low).T)])

    kinds = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in (*by, *axes))
    return rows.groupBy(*keys).applyInPandas(run, f"{kinds}, v double")


def box_mean(df: DataFrame, cols: list[str], size: int, shape: tuple[int, int, int], by: tuple = ()) -> DataFrame:
    """Means of ``cols`` over boxes ``size`` wide (an even one leans to lower coordinates); size 1 or less changes nothing."""
    if size <= 1:
        return df
    before, after = size // 2, (size - 1) // 2
    for a, n in zip(AXES, shape):
        if size // 2 > n:
            raise ValueError("the box is wider than the mirrored volume")
        here = F.col(a)
        copies = F.array_compact(F.array(here, F.when(here < before, -1 - here), F.when(here >= n - after, 2 * n - 1 - here)))
        padded = df.withColumn("_at", F.explode(copies))
        rest = [x for x in AXES if x != a]
        w = Window.partitionBy(*by, *rest).orderBy("_at").rowsBetween(-before, after)
        df = padded.withColumns({c: F.avg(c).over(w) for c in cols}).where(f"_at >= 0 and _at < {n}").withColumn(a, F.col("_at").cast("int")).drop("_at")
    return df


def local_variance(df: DataFrame, size: int, shape: tuple, by: tuple = ()) -> DataFrame:
    """Column var: box mean of squares less the square of the box mean."""
    if size <= 1:
        return df.withColumn("var", F.lit(0.0))
    m = box_mean(df.select(*by, *AXES, F.col("v").alias("_m"), (F.col("v") * F.col("v")).alias("_s")), ["_m", "_s"], size, shape, by)
    return df.join(m.select(*by, *AXES, (F.col("_s") - F.col("_m") * F.col("_m")).alias("var")), [*by, *AXES])


def difference_of_means(df: DataFrame, size: int, shape: tuple, norm: bool = True) -> DataFrame:
    """v less its box mean, as a z-score (population deviation) if ``norm``."""
    m = box_mean(df.select(*AXES, F.col("v").alias("_m")), ["_m"], size, shape)
    d = df.join(m, list(AXES)).withColumn("v", F.col("v") - F.col("_m")).drop("_m")
    if not norm:
        return d
    s = d.agg(F.avg("v").alias("_a"), F.stddev_pop("v").alias("_d"))
    return d.crossJoin(F.broadcast(s)).withColumn("v", (F.col("v") - F.col("_a")) / F.col("_d")).drop("_a", "_d")


def combine_by_variance(views: list[DataFrame], size: int, shape: tuple, alpha: float = 1.0, eps: float = 1e-20) -> DataFrame:
    """Views fused with weights 1 / (local variance + alpha)."""
    parts = [local_variance(v.select(*AXES, "v"), size, shape).select(*AXES, "v", (1 / (F.col("var") + alpha)).alias("w")) for v in views]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy(*AXES).agg((F.sum(F.col("v") * F.col("w")) / (F.sum("w") + eps)).alias("v"))


def guided_filter(df: DataFrame, size: int, eps: float, shape: tuple) -> DataFrame:
    """q = a g + b of the guided filter; input i, guide g; ``size`` is the box width."""
    s = df.select(*AXES, "i", "g", F.col("i").alias("mi"), F.col("g").alias("mg"), (F.col("g") * F.col("g")).alias("gg"), (F.col("i") * F.col("g")).alias("ig"))
    s = box_mean(s.drop("i", "g"), ["mi", "mg", "gg", "ig"], size, shape).join(df.select(*AXES, "g"), list(AXES))
    a = (F.col("ig") - F.col("mi") * F.col("mg")) / (F.col("gg") - F.col("mg") * F.col("mg") + eps)
    return s.withColumn("a", a).select(*AXES, (F.col("a") * F.col("g") + F.col("mi") - F.col("a") * F.col("mg")).alias("q"))


def gradient(df: DataFrame, col: str = "v", by: tuple = ()) -> DataFrame:
    """Columns g_z, g_y, g_x: central differences, one-sided at the ends of a line."""
    for a in AXES:
        w = Window.partitionBy(*by, *[x for x in AXES if x != a]).orderBy(a)
        lo, hi, v = F.lag(col).over(w), F.lead(col).over(w), F.col(col)
        df = df.withColumn(f"g_{a}", F.when(lo.isNull() & hi.isNull(), F.lit(0.0)).when(lo.isNull(), hi - v).when(hi.isNull(), v - lo).otherwise((hi - lo) / 2))
    return df
