"""Orthogonal views, flow fields of label slices, their fusion, advection and clustering.

Slices and tiles are the groups: a task holds one slice or one tile at a time.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as k
from .labels import components
from .smooth import densify, gaussian, grid
from .stencils import AXES, combine_by_variance, with_tiles

#: slice, row and column of each view as axes of the volume
VIEWS = {"xy": ("z", "y", "x"), "xz": ("y", "z", "x"), "yz": ("x", "z", "y")}
#: Cells of a volume that one task advects without tiles.
MAX_CELLS = 1 << 24
#: Edge of the pieces into which larger planes are cut.
PIECE = 512


def slices(labels: DataFrame, views: tuple = tuple(VIEWS), value: str = "label") -> DataFrame:
    """A volume's rows as (view, slice, r, c, value): coordinates are renamed, nothing is moved."""
    parts = [labels.select(F.lit(v).alias("view"), F.col(VIEWS[v][0]).alias("slice"), F.col(VIEWS[v][1]).alias("r"), F.col(VIEWS[v][2]).alias("c"), value) for v in views]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


def unslice(rows: DataFrame, view: str) -> DataFrame:
    """Rows of one view with coordinates z, y, x."""
    s, r, c = VIEWS[view]
    return rows.where(F.col("view") == view).drop("view").withColumnsRenamed({"slice": s, "r": r, "c": c})


def plane(shape: tuple, view: str) -> tuple[int, int]:
    size = dict(zip(AXES, shape))
    return size[VIEWS[view][1]], size[VIEWS[view][2]]


def slice_flows(rows: DataFrame, shape: tuple, method: str = "poisson", guided: bool = True, **how) -> DataFrame:
    """(view, slice, r, c, dist, d_row, d_col) where a slice's flow or distance is not zero.

    Methods: edt, poisson, poisson_skeleton, heat, fmm, fmm_skeleton; ``how`` goes to the
    kernel (quantile, iter_factor, skel_sigma, power). The centre of an object is guided by
    the distance to its border if ``guided``. Slices of an empty table give no rows.

    Slices longer than PIECE are cut into tiles whose halo holds the largest label whole, so
    that its flow and distance are those of the whole slice.
    """
    tile, halo = PIECE, 0
    if max(shape) > tile:
        side = lambda a: F.max(a) - F.min(a) + 1
        widest = rows.groupBy("view", "slice", "label").agg(F.greatest(side("r"), side("c")).alias("n")).agg(F.max("n")).first()[0]
        halo = int(widest or 0) + 2
        tile = max(tile, 4 * halo)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        view, s = pdf["view"].iloc[0], pdf["slice"].iloc[0]
        first = pdf[["_tr", "_tc"]].iloc[0].to_numpy(np.int64) * tile
        low, high = np.maximum(first - halo, 0), np.minimum(first + tile + halo, plane(shape, view))
        img = np.zeros(high - low, np.int64)
        img[pdf["r"] - low[0], pdf["c"] - low[1]] = pdf["label"]
        d, f = k.slice_flow(img, method, k.label_distance(img) if guided and method != "edt" else None, **how) if method != "edt" else k.slice_flow(img, "edt")
        r, c = np.nonzero((d != 0) | (f != 0).any(axis=0))
        own = ((np.stack([r, c], 1) + low >= first) & (np.stack([r, c], 1) + low < first + tile)).all(axis=1)
        r, c = r[own], c[own]
        return pd.DataFrame({"view": view, "slice": s, "r": (r + low[0]).astype("int32"), "c": (c + low[1]).astype("int32"), "dist": d[r, c], "d_row": f[0, r, c], "d_col": f[1, r, c]})

    return with_tiles(rows, ("r", "c"), tile, halo, (max(shape),) * 2).groupBy("view", "slice", "_tr", "_tc").applyInPandas(run, "view string, slice int, r int, c int, dist double, d_row double, d_col double")


def slice_transform(rows: DataFrame, shape: tuple, fn, clip: bool = False) -> DataFrame:
    """(view, slice, r, c, dist): a function of an object's boolean patch, applied to every object of every slice.

    Values are cut below 0; with ``clip`` they are divided by the object's largest first and cut to 0..1.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for _, own in pdf.groupby("label"):
            r0, c0 = own["r"].min(), own["c"].min()
            patch = np.zeros((own["r"].max() - r0 + 1, own["c"].max() - c0 + 1), bool)
            patch[own["r"] - r0, own["c"] - c0] = True
            d = np.asarray(fn(patch), float)
            d = np.clip(d / d.max(), 0, 1) if clip else np.clip(d, 0, None)
            out.append(own[["view", "slice", "r", "c"]].assign(dist=d[own["r"] - r0, own["c"] - c0]))
        return pd.concat(out)

    return rows.groupBy("view", "slice").applyInPandas(run, "view string, slice int, r int, c int, dist double")


def lift(flows: DataFrame) -> DataFrame:
    """(view, z, y, x, dz, dy, dx): in-plane flows as volume vectors; the axis across the plane is null."""
    out = None
    for view, (_, r, c) in VIEWS.items():
        v = unslice(flows, view)
        part = {f"d{a}": F.col("d_row") if a == r else F.col("d_col") if a == c else F.lit(None).cast("double") for a in AXES}
        v = v.select(F.lit(view).alias("view"), *[F.col(a).cast("int").alias(a) for a in AXES], *[x.alias(n) for n, x in part.items()])
        out = v if out is None else out.unionByName(v)
    return out


def unit_flow(field: DataFrame) -> DataFrame:
    n = F.sqrt(F.col("dz") ** 2 + F.col("dy") ** 2 + F.col("dx") ** 2) + 1e-20
    return field.select(*AXES, *[(F.col(c) / n).alias(c) for c in ("dz", "dy", "dx")])


def fuse_flows(lifted: DataFrame, shape: tuple, views: tuple = tuple(VIEWS), size: int = 1, alpha: float = 0.5, sigma: float = 1.0, post_sigma: float = 1.0) -> DataFrame:
    """(z, y, x, dz, dy, dx), dense unit vectors: views smoothed, fused by component, smoothed and normalised.

    A component that two views show is their fusion weighted by local variance (with
    ``size`` 1 their mean, so one Gaussian does for both); dz of two views is smoothed with
    sigma 1. A component without a view is zero.
    """
    have = {a: [v for v in views if a in VIEWS[v][1:]] for a in AXES}
    width = {a: 1.0 if a == "z" and len(have[a]) == 2 else sigma for a in AXES}
    if size <= 1:
        eps = 1e-20 * alpha
        sums = lifted.where(F.col("view").isin(*views)).groupBy(*AXES).agg(*[(F.coalesce(F.sum(f"d{a}"), F.lit(0.0)) / (max(1, len(have[a])) + (eps if len(have[a]) == 2 else 0))).alias(f"d{a}") for a in AXES])
        f = densify(sums, shape, dz=0.0, dy=0.0, dx=0.0)
        if len(set(width.values())) == 1:
            f = gaussian(f, ["dz", "dy", "dx"], sigma, shape)
        else:
            f = gaussian(gaussian(f, ["dz"], width["z"], shape), ["dy", "dx"], sigma, shape)
    else:
        f = grid(lifted.sparkSession, shape)
        for a in AXES:
            parts = [gaussian(densify(lifted.where(F.col("view") == v).select(*AXES, F.col(f"d{a}").alias("v")), shape, v=0.0), ["v"], width[a], shape) for v in have[a]]
            one = combine_by_variance(parts, size, shape, alpha) if len(parts) == 2 else parts[0] if parts else grid(lifted.sparkSession, shape).withColumn("v", F.lit(0.0))
            f = f.join(one.select(*AXES, F.col("v").alias(f"d{a}")), list(AXES))
    return unit_flow(gaussian(f, ["dz", "dy", "dx"], post_sigma, shape))


def label_flow(labels: DataFrame, shape: tuple, method: str = "poisson", size: int = 1, alpha: float = 0.5, sigma: float = 1.0, **how) -> DataFrame:
    """The fused unit flow of a label volume, from its own slices in all three views."""
    return fuse_flows(lift(slice_flows(slices(labels), shape, method, **how)), shape, size=size, alpha=alpha, sigma=sigma)


def distance_flow(labels: DataFrame, shape: tuple) -> DataFrame:
    """(z, y, x, dz, dy, dx): unit gradient of the three-dimensional distance to other labels, outside counted as one.

    One volume is one group.
    """
    _bounded(shape)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        img = np.zeros(shape, np.int64)
        img[pdf["z"], pdf["y"], pdf["x"]] = pdf["label"]
        f = k.unit(k.gradient(k.label_distance(img, True)))
        at = np.nonzero((f != 0).any(axis=0))
        return pd.DataFrame({**{a: i.astype("int32") for a, i in zip(AXES, at)}, **{c: g[at] for c, g in zip(("dz", "dy", "dx"), f)}})

    return labels.select(*AXES, "label").groupBy(F.lit(0)).applyInPandas(run, "z int, y int, x int, dz double, dy double, dx double")


def flow_errors(labels: DataFrame, flow: DataFrame, other: DataFrame) -> DataFrame:
    """(label, error): the mean over a label's voxels of the squared distance of two flows; missing vectors are zero."""
    zero = lambda df, p: df.select(*AXES, *[F.col(c).alias(p + c) for c in ("dz", "dy", "dx")])
    j = labels.join(zero(flow, "a_"), list(AXES), "left").join(zero(other, "b_"), list(AXES), "left")
    gap = sum((F.coalesce(f"a_{c}", F.lit(0.0)) - F.coalesce(f"b_{c}", F.lit(0.0))) ** 2 for c in ("dz", "dy", "dx"))
    return j.groupBy("label").agg(F.avg(gap).alias("error"))


def remove_bad_flows(labels: DataFrame, flow: DataFrame, other: DataFrame, threshold: float = 0.6) -> DataFrame:
    """``labels`` without those whose flow error, to 9 digits, is above the threshold (the order of a sum does not decide)."""
    bad = flow_errors(labels, flow, other).where(F.round("error", 9) > threshold).select("label")
    return labels.join(bad, "label", "left_anti").select(*labels.columns)


def remove_bad_slice_flows(rows: DataFrame, flows: DataFrame, shape: tuple, threshold: float = 0.6, method: str = "poisson", **how) -> DataFrame:
    """Slice labels (view, slice, r, c, label) without those whose own 2-D flow differs from ``flows``."""
    key = ["view", "slice", "r", "c"]
    own = slice_flows(rows, shape, method, **how).select(*key, F.col("d_row").alias("a"), F.col("d_col").alias("b"))
    j = rows.join(own, key, "left").join(flows.select(*key, F.col("d_row").alias("p"), F.col("d_col").alias("q")), key, "left")
    z = lambda c: F.coalesce(c, F.lit(0.0))
    bad = j.groupBy("view", "slice", "label").agg(F.avg((z("a") - z("p")) ** 2 + (z("b") - z("q")) ** 2).alias("e")).where(F.col("e") > threshold)
    return rows.join(bad, ["view", "slice", "label"], "left_anti").select(*rows.columns)


def _bounded(shape: tuple) -> None:
    if np.prod([int(n) for n in shape]) > MAX_CELLS:
        raise ValueError(f"a volume of more than {MAX_CELLS} cells needs tiles")


def _tiles(shape: tuple, tile: tuple, halo: int, inside: bool):
    """The tiles that own a cell (inside) or hold it with their halo, as an array of (z, y, x) tile numbers."""
    def span(a, n, t):
        last, own = -(-n // t) - 1, F.floor(F.col(a) / t).cast("int")
        if inside:
            return F.array(own)
        return F.sequence(F.greatest(F.lit(0), F.floor((F.col(a) - halo) / t)).cast("int"), F.least(F.lit(last), F.floor((F.col(a) + halo) / t)).cast("int"))

    z, y, x = (span(a, n, t) for a, n, t in zip(AXES, shape, tile))
    return F.flatten(F.transform(z, lambda i: F.flatten(F.transform(y, lambda j: F.transform(x, lambda l: F.struct(i.alias("tz"), j.alias("ty"), l.alias("tx")))))))


def advect(points: DataFrame, field: DataFrame, shape: tuple, tile: tuple | None = None, overlap: float = 0.25, **how) -> DataFrame:
    """(z, y, x, ez, ey, ex): where each voxel of ``points`` ends when it follows ``field``.

    ``how``: n_iter, delta, momentum, decay, interp, renorm. Without ``tile`` the volume is one
    group and has at most MAX_CELLS cells. With it, a tile owns its voxels, sees ``overlap`` of
    its size around it, and its points stay inside that.
    """
    if tile is None:
        _bounded(shape)
        tile, halo = shape, 0
    else:
        halo = max(1, int(max(tile) * overlap / 2))
    key = ["tz", "ty", "tx"]
    f = field.select(*AXES, "dz", "dy", "dx", F.explode(_tiles(shape, tile, halo, False)).alias("t")).select(*AXES, "dz", "dy", "dx", "t.*")
    p = points.select(*AXES, F.explode(_tiles(shape, tile, 0, True)).alias("t")).select(*[F.col(a).alias(f"p{a}") for a in AXES], "t.*")

    def run(own: pd.DataFrame, vec: pd.DataFrame) -> pd.DataFrame:
        own = own.rename(columns={f"p{a}": a for a in AXES})
        if own.empty:
            return pd.DataFrame({c: pd.Series(dtype=t) for c, t in zip([*AXES, "ez", "ey", "ex"], ["int32"] * 3 + ["float64"] * 3)})
        low = np.array([max(0, int(own[n].iloc[0]) * t - halo) for n, t in zip(key, tile)])
        high = np.array([min(n, (int(own[c].iloc[0]) + 1) * t + halo) for c, t, n in zip(key, tile, shape)])
        g = np.zeros((3, *(high - low)))
        at = vec[list(AXES)].to_numpy() - low
        g[(slice(None), *at.T)] = vec[["dz", "dy", "dx"]].to_numpy().T
        end = k.advect(g, own[list(AXES)].to_numpy() - low, **how) + low
        return pd.DataFrame({**{a: own[a].astype("int32") for a in AXES}, "ez": end[:, 0], "ey": end[:, 1], "ex": end[:, 2]})

    return p.groupBy(*key).cogroup(f.groupBy(*key)).applyInPandas(run, "z int, y int, x int, ez double, ey double, ex double")


def tracks(points: DataFrame, field: DataFrame, shape: tuple, every: int = 1, **how) -> DataFrame:
    """(pid, step, z, y, x) of points (pid, z, y, x) along their way, each ``every`` steps; step 0 is the start.

    The points are one group with the volume, so give those that are to be drawn only.
    """
    _bounded(shape)

    def run(own: pd.DataFrame, vec: pd.DataFrame) -> pd.DataFrame:
        own = own.rename(columns={f"p{a}": a for a in AXES})
        g = np.zeros((3, *shape))
        g[(slice(None), *vec[list(AXES)].to_numpy().T)] = vec[["dz", "dy", "dx"]].to_numpy().T
        start = own[list(AXES)].to_numpy(float)
        seen = [(0, start)]
        k.advect(g, start, each=lambda i, p: seen.append((i, p.copy())) if i % every == 0 else None, **how)
        return pd.concat([pd.DataFrame({"pid": own["pid"].to_numpy(), "step": i, "z": p[:, 0], "y": p[:, 1], "x": p[:, 2]}) for i, p in seen])

    one = F.lit(0).alias("_g")
    return points.select("pid", *[F.col(a).alias(f"p{a}") for a in AXES], one).groupBy("_g").cogroup(field.select(*AXES, "dz", "dy", "dx", one).groupBy("_g")).applyInPandas(run, "pid long, step int, z double, y double, x double")


def vote_clusters(ends: DataFrame, shape: tuple, sigma: float = 1.0, factor: float | None = 0.0, mask: DataFrame | None = None) -> DataFrame:
    """(z, y, x, label) of the start voxels whose end lies in a dense place; labels 1..n in raster order.

    Cells that hold an end count once, whatever number ends there. They are smoothed, and
    those above mean + factor * population deviation (None: the mean) are joined, diagonals
    included. Mean and deviation are over the grid, or over ``mask``, which then also bounds
    the result.
    """
    cell = [F.floor(f"e{a}").cast("int").alias(a) for a in AXES]
    votes = gaussian(densify(ends.select(*cell).distinct().withColumn("v", F.lit(1.0)), shape, v=0.0), ["v"], sigma, shape)
    over = votes.join(mask.select(*AXES).distinct(), list(AXES), "left_semi") if mask is not None else votes
    cut = over.agg((F.avg("v") + (factor or 0.0) * F.stddev_pop("v")).alias("_cut"))
    high = votes.crossJoin(F.broadcast(cut)).where("v > _cut").select(*AXES)  # one row
    place = components(high, 26).select(*[F.col(a).alias(f"c{a}") for a in AXES], F.col("comp").alias("label"))
    at = ends.select(*AXES, *[F.floor(f"e{a}").cast("int").alias(f"c{a}") for a in AXES])
    out = at.join(place, [f"c{a}" for a in AXES]).select(*AXES, "label")
    return out.join(mask.select(*AXES).distinct(), list(AXES), "left_semi") if mask is not None else out


def surface_normals(mask: DataFrame, shape: tuple, sigma: float = 0.0) -> DataFrame:
    """(z, y, x, sdf, dz, dy, dx, curvature): signed distance (positive inside), its unit gradient, half its divergence.

    One volume is one group.
    """
    _bounded(shape)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        m = np.zeros(shape, bool)
        m[pdf["z"], pdf["y"], pdf["x"]] = True
        d = -k.signed_distance(m)
        g = k.gradient(d)
        g = k.unit(np.stack([k.gaussian(c, sigma) for c in g]) if sigma else g)
        bend = sum(k.gradient(c)[i] for i, c in enumerate(g)) / 2
        at = np.indices(shape, dtype="int32").reshape(3, -1)
        return pd.DataFrame({**dict(zip(AXES, at)), "sdf": d.ravel(), **{c: x.ravel() for c, x in zip(("dz", "dy", "dx"), g)}, "curvature": bend.ravel()})

    return mask.select(*AXES).groupBy(F.lit(0)).applyInPandas(run, "z int, y int, x int, sdf double, dz double, dy double, dx double, curvature double")
