"""Label slices (slice, r, c, label): renumbering, components and persistence along the slice axis."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

import numpy as np

from . import kernels as k
from .labels import ranked
from .stencils import by_tiles

PIX = ("slice", "r", "c")


def relabel_slices(rows: DataFrame) -> DataFrame:
    """Labels raised slice by slice, the offset growing by the largest raised label so far.

    The offsets are folded over one row per slice. Slices without labels add the offset
    nothing: their largest cell is the background.
    """
    top = rows.groupBy("slice").agg(F.max("label").cast("long").alias("top"))
    start = F.struct(F.lit(0).cast("long").alias("off"), F.array().cast("array<struct<slice:int,off:long>>").alias("out"))
    step = lambda a, x: F.struct((a["off"] + a["off"] + x["top"]).alias("off"), F.concat(a["out"], F.array(F.struct(x["slice"].cast("int").alias("slice"), a["off"].alias("off")))).alias("out"))
    offs = top.agg(F.array_sort(F.collect_list(F.struct("slice", "top"))).alias("t")).select(F.explode(F.aggregate("t", start, step, lambda a: a["out"])).alias("o")).select("o.*")
    return rows.join(offs, "slice").select(*PIX, (F.col("label") + F.col("off")).alias("label"))


def unique_slices(rows: DataFrame) -> DataFrame:
    """Labels 1..n that are unique over the slices, in the order of slice and label."""
    new = ranked(rows.select("slice", "label").distinct(), ["slice", "label"], "_n")
    return rows.join(new, ["slice", "label"]).select(*PIX, F.col("_n").alias("label"))


def _per_slice(rows: DataFrame, fn, schema: str) -> DataFrame:
    """A function of a slice's label image (cropped to its labels) and its corner, slice by slice."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        r0, c0 = int(pdf["r"].min()), int(pdf["c"].min())
        img = np.zeros((pdf["r"].max() - r0 + 1, pdf["c"].max() - c0 + 1), np.int64)
        img[pdf["r"] - r0, pdf["c"] - c0] = pdf["label"]
        out = fn(img)
        r, c = np.nonzero(out)
        return pd.DataFrame({"slice": pdf["slice"].iloc[0], "r": (r + r0).astype("int32"), "c": (c + c0).astype("int32"), "label": out[r, c]})

    return rows.groupBy("slice").applyInPandas(run, schema)


_SCHEMA = "slice int, r int, c int, label long"


def _pieces(img: np.ndarray) -> np.ndarray:
    """Fully connected components of equal labels, in raster order."""
    out, n = np.zeros(img.shape, np.int64), 0
    for v in np.unique(img[img > 0]):
        c = k.component_labels(img == v, img.ndim)
        out[c > 0] = c[c > 0] + n
        n += c.max()
    first = {}
    for x in out[out > 0]:
        first.setdefault(int(x), len(first) + 1)
    table = np.zeros(n + 1, np.int64)
    for a, b in first.items():
        table[a] = b
    return table[out]


def component_slices(rows: DataFrame) -> DataFrame:
    """Fully connected components of every slice, numbered on from slice to slice."""
    c = _per_slice(rows, _pieces, _SCHEMA)
    top = c.groupBy("slice").agg(F.max("label").alias("t"))
    w = Window.partitionBy(F.lit(0)).orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)  # one row per slice
    return c.join(top.select("slice", F.coalesce(F.sum("t").over(w), F.lit(0)).alias("off")), "slice").select(*PIX, (F.col("label") + F.col("off")).alias("label"))


def filter_slice_labels(rows: DataFrame, min_size: int = 10) -> DataFrame:
    """Each label's pieces of more than ``min_size`` pixels, numbered anew from 1 in every slice."""

    def run(img: np.ndarray) -> np.ndarray:
        out, n = np.zeros(img.shape, np.int64), 0
        for v in np.unique(img[img > 0]):
            c = k.component_labels(img == v, 2)
            for i in np.flatnonzero(np.bincount(c.ravel())[1:] > min_size) + 1:
                n += 1
                out[c == i] = n
        return out

    return _per_slice(rows, run, _SCHEMA)




def _neighbours(rows: DataFrame, n: int, window: int) -> DataFrame:
    """(slice, label, o, other, n): pixels that a slice's label shares with the labels of the slice o away (mirrored, its end not repeated)."""
    half, last = window // 2, 2 * (n - 1)
    to = lambda s: F.when(s < 0, -s).when(s >= n, last - s).otherwise(s)
    own = rows.select("slice", "r", "c", "label", F.explode(F.array(*[F.lit(o) for o in range(-half, half)])).alias("o")).withColumn("at", to(F.col("slice") + F.col("o")))
    other = rows.select(F.col("slice").alias("at"), "r", "c", F.col("label").alias("other"))
    return own.join(other, ["at", "r", "c"]).groupBy("slice", "label", "at", "o", "other").agg(F.count("*").alias("n"))


def persistent_slices(rows: DataFrame, n: int, window: int = 3, min_count: int = 1) -> DataFrame:
    """Slice labels whose footprint is labelled in a long enough run of neighbouring slices.

    Of ``n`` slices those at offsets -h to h - 1 are tested (h = window // 2); an offset counts
    with ``min_count`` labelled pixels under the footprint. The longest run, the first among
    equals, must have h + 1 offsets or more and hold offset -1 or 0.
    """
    half = window // 2
    hit = _neighbours(rows, n, window).groupBy("slice", "label", "o").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count)
    w = Window.partitionBy("slice", "label").orderBy("o")
    runs = hit.withColumn("g", F.col("o") - F.row_number().over(w)).groupBy("slice", "label", "g").agg(F.count("*").alias("len"), F.min("o").alias("lo"), F.max("o").alias("hi"))
    best = runs.groupBy("slice", "label").agg(F.min(F.struct((-F.col("len")).alias("a"), "lo", "hi")).alias("b"))
    keep = best.where((-F.col("b.a") >= half + 1) & (F.col("b.lo") <= 0) & (F.col("b.hi") >= -1)).select("slice", "label")
    return rows.join(keep, ["slice", "label"], "left_semi").select(*PIX, "label")


def stable_slices(rows: DataFrame, n: int, window: int = 3, iou_var: float = 0.1) -> DataFrame:
    """Slice labels whose IoU with their largest partner varies by ``iou_var`` or less.

    The population deviation is over the tested offsets (see :func:`persistent_slices`); the
    partner at an offset is the largest label under the footprint, the smaller id among
    equals; no partner counts 0.
    """
    area = rows.groupBy("slice", "label").agg(F.count("*").alias("a"))
    j = _neighbours(rows, n, window).join(area.select(F.col("slice").alias("at"), F.col("label").alias("other"), F.col("a").alias("b")), ["at", "other"])
    best = j.groupBy("slice", "label", "o").agg(F.min(F.struct((-F.col("b")).alias("s"), "other", "b", "n")).alias("m")).join(area, ["slice", "label"])
    iou = best.select("slice", "label", (F.col("m.n") / (F.col("a") + F.col("m.b") - F.col("m.n"))).alias("iou"))
    tests = max(1, 2 * (window // 2))
    s = iou.groupBy("slice", "label").agg(F.sum("iou").alias("s"), F.sum(F.col("iou") ** 2).alias("q"))
    var = F.coalesce(F.col("q"), F.lit(0.0)) / tests - (F.coalesce(F.col("s"), F.lit(0.0)) / tests) ** 2
    bad = s.where(F.sqrt(F.greatest(var, F.lit(0.0))) > iou_var)
    return rows.join(bad, ["slice", "label"], "left_anti").select(*PIX, "label")


def expand_slices(seeds: DataFrame, mask: DataFrame, keep_rest: bool = True) -> DataFrame:
    """Seed labels (slice, r, c, label) grown over a mask (slice, r, c), slice by slice, from its deepest places.

    With ``keep_rest`` parts of the mask without a seed become labels above the slice's largest seed.
    """
    rows = mask.select(*PIX).join(seeds.select(*PIX, "label"), list(PIX), "left").fillna(0, ["label"])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        r0, c0 = int(pdf["r"].min()), int(pdf["c"].min())
        m = np.zeros((pdf["r"].max() - r0 + 3, pdf["c"].max() - c0 + 3), np.int64)
        s = m.copy()
        at = (pdf["r"] - r0 + 1, pdf["c"] - c0 + 1)
        m[at], s[at] = 1, pdf["label"]
        out = k.flood(s, m > 0, -k.label_distance(m))
        if keep_rest:
            rest = k.component_labels((m > 0) & (out == 0), 2)
            out = np.where(rest > 0, rest + s.max(), out)
        r, c = np.nonzero(out)
        return pd.DataFrame({"slice": pdf["slice"].iloc[0], "r": (r + r0 - 1).astype("int32"), "c": (c + c0 - 1).astype("int32"), "label": out[r, c]})

    return rows.groupBy("slice").applyInPandas(run, _SCHEMA)


def map_slices(df: DataFrame, fn, by: tuple = ("z",)) -> DataFrame:
    """A numpy function of each dense slice (by, y, x, v), which keeps its shape."""
    keys = ", ".join(f"{c} int" for c in by)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        a = np.zeros((pdf["y"].max() + 1, pdf["x"].max() + 1))
        a[pdf["y"], pdf["x"]] = pdf["v"]
        return pdf[[*by, "y", "x"]].assign(v=fn(a)[pdf["y"], pdf["x"]])

    return df.select(*by, "y", "x", "v").groupBy(*by).applyInPandas(run, f"{keys}, y int, x int, v double")


def anisotropic_diffusion(df: DataFrame, niter: int = 1, kappa: float = 50, gamma: float = 0.1, option: int = 1) -> DataFrame:
    """niter - 1 steps of diffusion in each slice; a step reaches one cell, so slices are cut into tiles with a halo."""
    return by_tiles(df, lambda a: k.perona_malik(a, niter, kappa, gamma, option=option), max(0, niter - 1), ("z",), ("y", "x"), 512)


def ridge_filter(df: DataFrame, sigmas=(3,), low_contrast: float = 0.05, black: bool = False) -> DataFrame:
    """Neuriteness of each slice of a volume scaled to 0..1; slices of less contrast than ``low_contrast`` become 0."""
    m = df.agg(F.min("v").alias("_lo"), F.max("v").alias("_hi"))
    scaled = df.crossJoin(F.broadcast(m)).withColumn("v", (F.col("v") - F.col("_lo")) / (F.col("_hi") - F.col("_lo") + 1e-20))  # one row

    def run(a: np.ndarray) -> np.ndarray:
        lo, hi = np.percentile(a, [1, 99])
        return k.ridges(a, sigmas, black) if hi - lo >= low_contrast else np.zeros(a.shape)

    return map_slices(scaled, run)


def local_equalize(df: DataFrame, tile: tuple = (64, 64), clip: float = 0.05, low_contrast: float | None = None) -> DataFrame:
    """Adaptive histogram equalisation of each slice; with ``low_contrast`` flatter slices stay as they are."""

    def run(a: np.ndarray) -> np.ndarray:
        lo, hi = np.percentile(a, [1, 99])
        if low_contrast is not None and hi - lo < low_contrast * max(abs(a.max()), 1e-20):
            return a
        return k.local_equalize(a, tile, clip)

    return map_slices(df, run)


def remove_plane(df: DataFrame) -> DataFrame:
    """Each slice less its least-squares quadratic surface, scaled to 0..1."""

    def run(a: np.ndarray) -> np.ndarray:
        y, x = (i.ravel() / max(1, n - 1) for i, n in zip(np.indices(a.shape), a.shape))
        base = np.stack([np.ones(a.size), y, x, y * y, x * y, x * x], axis=1)
        rest = a.ravel() - base @ np.linalg.lstsq(base, a.ravel(), rcond=None)[0]
        return ((rest - rest.min()) / (np.ptp(rest) + 1e-20)).reshape(a.shape)

    return map_slices(df, run)


def fill_label_slices(rows: DataFrame) -> DataFrame:
    """Holes of every label filled slice by slice; a hole that several labels enclose goes to the highest."""

    def run(img: np.ndarray) -> np.ndarray:
        out = img.copy()
        for v in np.unique(img[img > 0]):
            out[k.fill(img == v)] = v
        return out

    return _per_slice(rows, run, _SCHEMA)
