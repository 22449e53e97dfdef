"""Single slices: a model's probabilities and flows, the choice of its diameter, and advection and clustering in a plane."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import materialize
from . import kernels as k
from .flows import PIECE
from .labels import components, ranked
from .smooth import moving_average
from .stencils import by_tiles, with_tiles

#: A model takes a slice and a diameter and gives its probabilities (y, x) and its flow (2, y, x).
Model = Callable[[np.ndarray, float], tuple[np.ndarray, np.ndarray]]


def _image(pdf: pd.DataFrame, value: str = "v") -> np.ndarray:
    a = np.zeros((pdf["y"].max() + 1, pdf["x"].max() + 1))
    a[pdf["y"], pdf["x"]] = pdf[value]
    return a


def slice_contrast(df: DataFrame, edge: bool = False) -> DataFrame:
    """(z, score): the mean of each slice, or of its Sobel edges."""

    def run(a: np.ndarray) -> np.ndarray:
        p = np.pad(a, 1, mode="symmetric")
        across = lambda d: (d[:-2] + 2 * d[1:-1] + d[2:]) / 4
        dy, dx = across((p[2:] - p[:-2]).T).T / 2, across(p[:, 2:] - p[:, :-2]) / 2
        return np.sqrt((dy**2 + dx**2) / 2)

    rows = by_tiles(df, run, 1, ("z",), ("y", "x"), 512) if edge else df
    return rows.groupBy(F.col("z").cast("int").alias("z")).agg(F.avg("v").alias("score"))


def run_model(df: DataFrame, model: Model, diameter: float, invert: bool = False) -> DataFrame:
    """(z, y, x, prob, d_row, d_col) of a dense volume (z, y, x, v), a slice a call. ``invert`` turns values about the volume's range."""
    if invert:
        ends = df.agg((F.min("v") + F.max("v")).alias("_s"))
        df = df.crossJoin(F.broadcast(ends)).withColumn("v", F.col("_s") - F.col("v"))  # one row

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        prob, flow = model(_image(pdf), diameter)
        at = (pdf["y"], pdf["x"])
        return pdf[["z", "y", "x"]].assign(prob=np.asarray(prob, float)[at], d_row=np.asarray(flow[0], float)[at], d_col=np.asarray(flow[1], float)[at])

    return df.select("z", "y", "x", "v").groupBy("z").applyInPandas(run, "z int, y int, x int, prob double, d_row double, d_col double")


def diameter_scores(df: DataFrame, model: Model, diameters: list[float], test: int | None = None, size: int = 25, window: int = 5, weighted: bool = True, edge: bool = False) -> DataFrame:
    """(diameter, score, smoothed) of one test slice: the mean local variance of the flow, times the probability if ``weighted``.

    ``test`` is the slice; without it that of the largest :func:`slice_contrast`, the first among
    equals. Each diameter is a task; ``smoothed`` is a centred mean over ``window`` diameters, mirrored at the ends.
    """
    if test is None:
        best = slice_contrast(df, edge).agg(F.min(F.struct((-F.col("score")).alias("a"), "z")).alias("b")).select("b.z")
        own = df.join(F.broadcast(best), "z", "left_semi")  # one row
    else:
        own = df.where(F.col("z") == test)
    scale = df.sparkSession.createDataFrame([(i, float(d)) for i, d in enumerate(diameters)], "i int, diameter double")
    rows = own.select("z", "y", "x", "v").crossJoin(F.broadcast(scale))  # the given diameters

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        d = float(pdf["diameter"].iloc[0])
        prob, flow = model(_image(pdf), d)
        var = np.mean([np.maximum(k.box_filter(np.asarray(f, float) ** 2, size) - k.box_filter(np.asarray(f, float), size) ** 2, 0) for f in flow], axis=0)
        score = var * np.asarray(prob, float) if weighted else var
        return pd.DataFrame({"i": [int(pdf["i"].iloc[0])], "diameter": [d], "score": [float(np.nanmean(score))]})

    scores = materialize(rows.groupBy("i").applyInPandas(run, "i int, diameter double, score double"), "diameters")
    smooth = moving_average(scores.select("i", F.col("score").alias("v")), window, len(diameters)).withColumnRenamed("v", "smoothed")
    return scores.join(smooth, "i").select("diameter", "score", "smoothed")


def best_diameter(scores: DataFrame) -> DataFrame:
    """One row (diameter): the largest smoothed score, the smaller diameter among equals."""
    return scores.agg(F.min(F.struct((-F.col("smoothed")).alias("a"), "diameter")).alias("b")).select("b.diameter")


def peak_diameters(scores: DataFrame, height: float = 0.1, prominence: float = 0.25) -> DataFrame:
    """(diameter) of the peaks of the smoothed scores, scaled to 0..1 of their range: local maxima at least ``height``

    high that fall by ``prominence`` on both sides before a higher one or the end. A flat top counts at its first diameter.
    """
    rows = Window.orderBy("diameter")  # the given diameters
    ends = scores.agg(F.min("smoothed").alias("_lo"), F.max("smoothed").alias("_hi"))
    s = scores.crossJoin(F.broadcast(ends)).where("_hi > _lo").select("diameter", ((F.col("smoothed") - F.col("_lo")) / (F.col("_hi") - F.col("_lo"))).alias("s"))  # one row
    all_ = s.withColumns({"n": F.row_number().over(rows), "list": F.collect_list("s").over(rows.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))})
    before, after = F.reverse(F.slice("list", F.lit(1), F.col("n") - 1)), F.slice("list", F.col("n") + 1, F.size("list"))
    # the lowest value on the way to the first higher one
    drop = lambda side: F.aggregate(side, F.struct(F.col("s").alias("low"), F.lit(False).alias("done")), lambda a, x: F.struct(F.when(a["done"] | (x > F.col("s")), a["low"]).otherwise(F.least(a["low"], x)).alias("low"), (a["done"] | (x > F.col("s"))).alias("done")))["low"]
    prev, after_top = F.lag("s", 1, -1.0).over(rows), F.element_at(F.concat(F.filter(after, lambda x: x != F.col("s")), F.array(F.lit(-1.0))), 1)
    all_ = all_.withColumns({"prev": prev, "next": after_top, "left": drop(before), "right": drop(after)})
    # at an end only the side that is there counts
    fall = F.col("s") - F.when(F.size(before) == 0, F.col("right")).when(F.size(after) == 0, F.col("left")).otherwise(F.greatest("left", "right"))
    return all_.where((F.col("s") > F.col("prev")) & (F.col("s") > F.col("next")) & (F.col("s") >= height) & (fall >= prominence)).select("diameter")


def advect_planes(mask: DataFrame, flow: DataFrame, shape: tuple[int, int], n_iter: int = 10, delta: float = 0.5, momentum: float = 0.0, decay: float = 0.0, interp: bool = True, tracks: bool = False) -> DataFrame:
    """(slice, r, c, er, ec): where the pixels of a mask (slice, r, c) end along unit vectors of ``flow`` (slice, r, c, d_row, d_col).

    With ``tracks`` a row for each step (column step, 0 the start). Pixels without flow stay. A step is
    ``delta`` long at most, so large planes are cut into tiles with a halo as wide as all steps.
    """
    halo = int(np.ceil(n_iter * delta)) + 2
    rows = flow.select("slice", "r", "c", "d_row", "d_col").join(mask.select("slice", "r", "c", F.lit(True).alias("on")).distinct(), ["slice", "r", "c"], "full")
    tile = max(PIECE, 2 * halo)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        first = pdf[["_tr", "_tc"]].iloc[0].to_numpy(np.int64) * tile
        low, high = np.maximum(first - halo, 0), np.minimum(first + tile + halo, shape)
        field = np.zeros((2, *(high - low)))
        field[:, pdf["r"] - low[0], pdf["c"] - low[1]] = pdf[["d_row", "d_col"]].fillna(0.0).to_numpy().T
        at = pdf[["r", "c"]].to_numpy()
        start = at[pdf["on"].notna() & ((at >= first) & (at < first + tile)).all(axis=1)]
        steps = [(0, start.astype(float))]
        end = k.advect(field, start, n_iter, delta, momentum, decay, interp, True, not interp, (lambda i, p: steps.append((i, p.copy()))) if tracks else None, low, shape) if len(start) else start.astype(float)
        base = {"slice": int(pdf["slice"].iloc[0]), "r": start[:, 0].astype("int32"), "c": start[:, 1].astype("int32")}
        one = lambda p: pd.DataFrame({**base, "er": p[:, 0], "ec": p[:, 1]})
        return pd.concat([one(p).assign(step=i) for i, p in steps]) if tracks else one(end)

    return with_tiles(rows, ("r", "c"), tile, halo, shape).groupBy("slice", "_tr", "_tc").applyInPandas(run, "slice int, r int, c int, er double, ec double" + (", step int" if tracks else ""))


def cluster_planes(ends: DataFrame, shape: tuple[int, int], sigma: float = 1.0, factor: float | None = None, min_area: int = 1) -> DataFrame:
    """(slice, r, c, label) of pixels whose end lies in a dense place of more than ``min_area`` pixels, numbered in each slice.

    Cells that hold an end count once; they are smoothed in tiles, and those above mean + factor * deviation of
    the slice are joined side by side.
    """
    cells, halo, tile = float(shape[0] * shape[1]), int(4 * sigma + 0.5), PIECE
    at = materialize(ends.select("slice", "r", "c", *[F.floor(f"e{a}").cast("int").alias(b) for a, b in zip("rc", "yx")]), "ends").hint("merge")  # read twice

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        first = pdf[["_ty", "_tx"]].iloc[0].to_numpy(np.int64) * tile
        low, high = np.maximum(first - halo, 0), np.minimum(first + tile + halo, shape)
        votes = np.zeros(high - low)
        votes[pdf["y"] - low[0], pdf["x"] - low[1]] = 1
        votes = k.gaussian(votes, sigma)
        own = tuple(slice(f - l, f - l + tile) for f, l in zip(first, low))
        y, x = np.nonzero(votes[own])
        return pd.DataFrame({"slice": int(pdf["slice"].iloc[0]), "y": (y + first[0]).astype("int32"), "x": (x + first[1]).astype("int32"), "v": votes[own][y, x]})

    tiles = with_tiles(at.select("slice", "y", "x").distinct(), ("y", "x"), tile, halo, shape)
    votes = materialize(tiles.groupBy("slice", "_ty", "_tx").applyInPandas(run, "slice int, y int, x int, v double"), "votes")
    each = F.broadcast  # a row of each slice
    cut = votes.groupBy("slice").agg((F.sum("v") / cells).alias("_cut"))  # cells without a row are 0
    if factor:
        gap = votes.join(each(cut), "slice").groupBy("slice", "_cut").agg(F.sum((F.col("v") - F.col("_cut")) ** 2).alias("q"), (cells - F.count("*")).alias("rest"))
        cut = gap.select("slice", (F.col("_cut") + factor * F.sqrt((F.col("q") + F.col("rest") * F.col("_cut") ** 2) / cells)).alias("_cut"))
    high = votes.join(each(cut.where("_cut >= 0")), "slice").where("v > _cut").select("slice", F.lit(0).alias("z"), "y", "x")
    comp = components(high, 6, ("slice",))
    kept = ranked(comp.groupBy("slice", "comp").count().where(F.col("count") > min_area), ["comp"], "label", ("slice",)).select("slice", "comp", F.col("label").cast("long").alias("label"))
    out = at.join(comp.join(kept, ["slice", "comp"]).select("slice", "y", "x", "label"), ["slice", "y", "x"]).select("slice", "r", "c", "label")
    if factor and factor < 0 and cells > min_area:  # where the cut is below 0 all cells are above it, and are one
        out = out.union(at.join(each(cut.where("_cut < 0")), "slice").select("slice", "r", "c", F.lit(1).cast("long").alias("label")))
    return out
