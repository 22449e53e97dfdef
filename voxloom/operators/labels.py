"""Operators on label volumes: sparse tables (z, y, x, label) with label > 0.

``by`` names further key columns (a volume id, say); every volume is treated on its own.
"""

from __future__ import annotations

from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import materialize
from . import kernels
from .graph import connected_components

AXES = ("z", "y", "x")


def region_props(labels: DataFrame, by: tuple = ()) -> DataFrame:
    """Area, half-open bounding box and centroid of each label."""
    aggs = [F.count("*").alias("area")]
    for a in AXES:
        aggs += [F.min(a).alias(f"min_{a}"), (F.max(a) + 1).alias(f"max_{a}"), F.avg(a).alias(f"c_{a}")]
    return labels.groupBy(*by, "label").agg(*aggs)


def ranked(rows: DataFrame, cols: list, name: str, by: tuple = ()) -> DataFrame:
    """``rows`` with their number from 1 in the order of ``cols``, within ``by``, which must name each row.

    Rows are sorted over all tasks by range; a task's numbers start after the rows of those before it.
    """
    key = [F.col(c) for c in (*by, *cols)]
    spread = materialize(rows.repartitionByRange(*key).withColumn("_p", F.spark_partition_id()), "ranked")
    before = spread.groupBy("_p").agg(F.count("*").alias("_n"))  # a row for each task
    before = before.select("_p", F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    at = F.row_number().over(Window.partitionBy("_p").orderBy(*key))
    out = spread.withColumn("_at", at).join(F.broadcast(before), "_p").withColumn(name, F.col("_at") + F.col("_before")).drop("_p", "_at", "_before")
    if by:
        start = out.groupBy(*by).agg((F.min(name) - 1).alias("_start"))
        out = out.join(start, list(by)).withColumn(name, F.col(name) - F.col("_start")).drop("_start")
    return out.withColumn(name, F.col(name).cast("int"))


def renumber(labels: DataFrame, order: DataFrame, cols: list, by: tuple = ()) -> DataFrame:
    """New labels 1..n in the order of ``cols`` of ``order``, a table with one row per label."""
    new = ranked(order, cols, "_new", by).select(*by, "label", "_new")
    return labels.join(new, [*by, "label"]).withColumn("label", F.col("_new")).drop("_new")


def relabel_sequential(labels: DataFrame, by: tuple = ()) -> DataFrame:
    return renumber(labels, labels.select(*by, "label").distinct(), ["label"], by)


def reorder_labels(labels: DataFrame, by: tuple = ()) -> DataFrame:
    """Labels 1..n by centroid (z, y, x); ties by old label."""
    return renumber(labels, region_props(labels, by), ["c_z", "c_y", "c_x", "label"], by)


def _keep(labels: DataFrame, keep: DataFrame, by: tuple) -> DataFrame:
    return labels.join(keep.select(*by, "label"), [*by, "label"], "left_semi")


def remove_small_labels(labels: DataFrame, min_size: int = 64, inclusive: bool = False, by: tuple = ()) -> DataFrame:
    """Drop labels of fewer than ``min_size`` voxels (of as many too if ``inclusive``)."""
    n = labels.groupBy(*by, "label").count()
    return _keep(labels, n.where(F.col("count") > min_size if inclusive else F.col("count") >= min_size), by)


def size_statistics_filter(labels: DataFrame, factor: float = 10.0, by: tuple = ()) -> DataFrame:
    """Drop labels larger than mean + factor * population deviation of the sizes."""
    n = labels.groupBy(*by, "label").count()
    s = n.groupBy(*by).agg((F.avg("count") + factor * F.stddev_pop("count")).alias("_top"))
    j = n.join(s, list(by)) if by else n.crossJoin(F.broadcast(s))  # one row
    return _keep(labels, j.where(~(F.col("count") > F.col("_top"))), by)


def intensity_filter(labels: DataFrame, volume: DataFrame, threshold: float | str = "mean", by: tuple = ()) -> DataFrame:
    """Drop labels whose mean of ``v`` is below a number, or the mean, the median or Otsu's threshold of the labels' means.

    Otsu's needs two different means at least; without them all labels stay. It takes no ``by``.
    """
    m = labels.join(volume.select(*by, *AXES, "v"), [*by, *AXES]).groupBy(*by, "label").agg(F.avg("v").alias("m"))
    if not isinstance(threshold, str):
        return _keep(labels, m.where(F.col("m") >= threshold), by)
    if threshold == "otsu":
        if by:
            raise ValueError("Otsu's threshold is one volume's")
        from .intensity import otsu

        t = otsu(m.select(F.col("m").alias("v"))).select(F.col("threshold").alias("_t"))
        return _keep(labels, m.crossJoin(F.broadcast(t)).where(F.col("_t").isNull() | (F.col("m") >= F.col("_t"))), by)  # one row
    agg = {"mean": F.avg("m"), "median": F.median("m")}[threshold]
    t = m.groupBy(*by).agg(agg.alias("_t"))
    j = m.join(t, list(by)) if by else m.crossJoin(F.broadcast(t))  # one row
    return _keep(labels, j.where(F.col("m") >= F.col("_t")), by)


def shape_covariance(labels: DataFrame, by: tuple = ()) -> DataFrame:
    """Size and sample covariance matrix of each label's coordinates."""
    pairs = [(a, b) for i, a in enumerate(AXES) for b in AXES[i:]]
    return labels.groupBy(*by, "label").agg(F.count("*").alias("area"), *[F.covar_samp(a, b).alias(f"cov_{a}{b}") for a, b in pairs])


def remove_eccentric_shapes(labels: DataFrame, min_size: int = 20, stretch: float = 15.0, by: tuple = ()) -> DataFrame:
    """Drop labels of ``min_size`` voxels or fewer, and those whose covariance eigenvalues' ratio exceeds ``stretch``.

    Eigenvalues of the symmetric 3 x 3 matrices come in closed form, without leaving the JVM.
    """
    c = {n: F.col(f"cov_{n}") for n in ("zz", "zy", "zx", "yy", "yx", "xx")}
    q = (c["zz"] + c["yy"] + c["xx"]) / 3
    off = c["zy"] ** 2 + c["zx"] ** 2 + c["yx"] ** 2
    p = F.sqrt(((c["zz"] - q) ** 2 + (c["yy"] - q) ** 2 + (c["xx"] - q) ** 2 + 2 * off) / 6)
    a, d, f = c["zz"] - q, c["yy"] - q, c["xx"] - q
    det = a * (d * f - c["yx"] ** 2) - c["zy"] * (c["zy"] * f - c["yx"] * c["zx"]) + c["zx"] * (c["zy"] * c["yx"] - d * c["zx"])
    phi = F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), det / (2 * p**3)))) / 3
    top, low = q + 2 * p * F.cos(phi), q + 2 * p * F.cos(phi + 2 * 3.141592653589793 / 3)
    s = shape_covariance(labels, by).where(F.col("area") > min_size)
    s = s.withColumn("_ratio", F.when(p == 0, 1.0).otherwise(top / F.greatest(low, F.lit(1e-12))))
    return _keep(labels, s.where(F.col("_ratio") <= stretch), by)


def _offsets(connectivity: int) -> list[tuple]:
    """Half of the neighbour offsets of 6-, 18- or 26-connectivity."""
    most = {6: 1, 18: 2, 26: 3}[connectivity]
    return [o for o in product((-1, 0, 1), repeat=3) if o > (0, 0, 0) and sum(map(abs, o)) <= most]


def _name(key: int, at: np.ndarray) -> np.ndarray:
    """64-bit names of voxels of the rows with this key hash."""
    h = np.full(at.shape[1], np.int64(key)).view(np.uint64)
    for c in at.astype(np.int64).view(np.uint64):
        h = (h ^ c) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(32)
    return h.view(np.int64)


#: Edge of the cubes that a task labels as one array.
TILE = 64


def components(voxels: DataFrame, connectivity: int = 6, same: tuple = (), by: tuple = (), tile: int = TILE) -> DataFrame:
    """``voxels`` with column ``comp``: components of neighbours that agree in the columns ``same``, 1..n in raster order.

    Cubes are labelled as arrays, one task each; only the voxels on their faces are joined
    to their neighbours, so the graph whose components remain holds the cubes' pieces.
    Columns of ``same`` and ``by`` are not null; repeated voxels count once.
    """
    keys, reach = [*by, *same], {6: 1, 18: 2, 26: 3}[connectivity]
    cube = [F.floor(F.col(a) / tile).cast("int").alias(f"_t{a}") for a in AXES]
    names = [f"_t{a}" for a in AXES]
    v = voxels.select(*keys, *[F.col(a).cast("int").alias(a) for a in AXES]).distinct().select("*", *cube, F.xxhash64(*keys).alias("_k") if keys else F.lit(0).cast("long").alias("_k"))

    def label(pdf: pd.DataFrame) -> pd.DataFrame:
        out = np.zeros(len(pdf), np.int64)
        at = np.stack([pdf[a].to_numpy() for a in AXES])
        for k, rows in pdf.groupby("_k", sort=False).indices.items():
            p = at[:, rows]
            low = p.min(axis=1, keepdims=True)
            mask = np.zeros(p.max(axis=1) - low[:, 0] + 1, bool)
            mask[tuple(p - low)] = True
            piece = kernels.component_labels(mask, reach)[tuple(p - low)]
            # a piece is named by its first voxel
            first = np.full(piece.max() + 1, -1, np.int64)
            order = np.lexsort(p[::-1])[::-1]
            first[piece[order]] = rows[order]
            own = first[piece]
            out[rows] = _name(k, at[:, own])
        return pdf.drop(columns=["_k", *names]).assign(_piece=out)

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in v.schema if f.name not in ("_k", *names))
    v = materialize(v.groupBy(*by, *names).applyInPandas(label, kinds + ", _piece long"), "pieces").hint("merge")  # small files, many voxels
    steps = F.array(*[F.struct(*[F.lit(d).alias(f"d{a}") for a, d in zip(AXES, o)]) for o in _offsets(connectivity)])
    rim = v.where(" or ".join(f"pmod({a}, {tile}) in (0, {tile - 1})" for a in AXES))
    shifted = rim.select(*keys, F.col("_piece").alias("u"), F.explode(steps).alias("o"), *AXES)
    shifted = shifted.select(*keys, "u", *[(F.col(a) + F.col(f"o.d{a}")).cast("int").alias(a) for a in AXES])
    edges = shifted.join(rim.select(*keys, *AXES, F.col("_piece").alias("v")), [*keys, *AXES]).where("u <> v").select("u", "v")
    roots = connected_components(edges).withColumnRenamed("node", "_piece")
    pieces = v.groupBy(*by, "_piece").agg(F.min(F.struct(*AXES, *same)).alias("_first")).join(roots, "_piece", "left").withColumn("_root", F.coalesce("root", "_piece"))
    first = pieces.groupBy(*by, "_root").agg(F.min("_first").alias("_first"))
    no = ranked(first, ["_first", "_root"], "comp", by).select(*by, "_root", "comp")
    named = pieces.select(*by, "_piece", "_root").join(no, [*by, "_root"]).select(*by, "_piece", "comp")
    out = v.join(named, [*by, "_piece"]).select(*keys, *AXES, "comp")
    rest = [c for c in voxels.columns if c not in (*keys, *AXES)]
    return out.join(voxels.select(*keys, *AXES, *rest), [*keys, *AXES]).select(*voxels.columns, "comp") if rest else out.select(*voxels.columns, "comp")


def largest_component(voxels: DataFrame, connectivity: int = 6, by: tuple = ()) -> DataFrame:
    """Voxels of the largest component; the first in raster order among equals."""
    c = components(voxels, connectivity, by=by)
    n = c.groupBy(*by, "comp").count()
    best = n.groupBy(*by).agg(F.min(F.struct((-F.col("count")).alias("a"), "comp")).alias("b")).select(*by, F.col("b.comp").alias("comp"))
    return c.join(best, [*by, "comp"], "left_semi").drop("comp")


def largest_component_per_label(labels: DataFrame, connectivity: int = 6, by: tuple = ()) -> DataFrame:
    return largest_component_of(labels, ("label",), connectivity, by)


def largest_component_of(labels: DataFrame, same: tuple, connectivity: int, by: tuple = ()) -> DataFrame:
    c = components(labels, connectivity, same, by)
    n = c.groupBy(*by, *same, "comp").count()
    best = n.groupBy(*by, *same).agg(F.min(F.struct((-F.col("count")).alias("a"), "comp")).alias("b")).select(*by, *same, F.col("b.comp").alias("comp"))
    return c.join(best, [*by, *same, "comp"], "left_semi").drop("comp")


def remove_small_components(voxels: DataFrame, min_size: int, connectivity: int = 18, by: tuple = ()) -> DataFrame:
    c = components(voxels, connectivity, by=by)
    n = c.groupBy(*by, "comp").count().where(F.col("count") >= min_size)
    return c.join(n.select(*by, "comp"), [*by, "comp"], "left_semi").drop("comp")


def split_components(labels: DataFrame, min_size: int = 100, by: tuple = ()) -> DataFrame:
    """Each label's full-connectivity components of ``min_size`` or more as labels 1..n, by old label, then raster order."""
    c = components(labels, 26, ("label",), by)
    n = c.groupBy(*by, "label", "comp").count().where(F.col("count") >= min_size)
    new = ranked(n, ["label", "comp"], "_new", by).select(*by, "label", "comp", "_new")
    return c.join(new, [*by, "label", "comp"]).withColumn("label", F.col("_new")).drop("_new", "comp")


def fill_holes(voxels: DataFrame, shape: tuple[int, int, int]) -> DataFrame:
    """Voxels with the background components (6-connected) that do not touch the volume's border."""
    spark = voxels.sparkSession
    grid = spark.range(shape[0] * shape[1]).select(F.expr(f"cast(id div {shape[1]} as int)").alias("z"), F.expr(f"cast(id % {shape[1]} as int)").alias("y"), F.explode(F.sequence(F.lit(0), F.lit(shape[2] - 1))).alias("x"))
    own = voxels.select(*[F.col(a).cast("int").alias(a) for a in AXES]).distinct()
    back = components(grid.join(own, list(AXES), "left_anti"), 6)
    edge = back.groupBy("comp").agg(*[F.min(a).alias(f"l{a}") for a in AXES], *[F.max(a).alias(f"h{a}") for a in AXES])
    inner = edge.where(" and ".join(f"l{a} > 0 and h{a} < {n - 1}" for a, n in zip(AXES, shape))).select("comp")
    return own.union(back.join(inner, "comp", "left_semi").select(*AXES))


def ball(radius: int) -> list[tuple]:
    r = range(-radius, radius + 1)
    return [o for o in product(r, r, r) if sum(d * d for d in o) <= radius * radius]


def _shifts(offsets: list[tuple]):
    return F.explode(F.array(*[F.struct(*[F.lit(d).alias(a) for a, d in zip("ijk", o)]) for o in offsets])).alias("_o")


def dilate_ball(voxels: DataFrame, radius: int, shape: tuple[int, int, int]) -> DataFrame:
    """Voxels within ``radius`` of the given ones, inside the volume.

    Runs along x are moved instead of voxels: a ball is one piece of a line for each (z, y), and pieces that
    meet are joined before they are spread to voxels again.
    """
    line = Window.partitionBy("z", "y").orderBy("x")
    v = voxels.select(*[F.col(a).cast("int").alias(a) for a in AXES]).where("z is not null and y is not null and x is not null")
    v = v.withColumn("_g", F.col("x") - F.dense_rank().over(line))
    runs = v.groupBy("z", "y", "_g").agg(F.min("x").alias("a"), F.max("x").alias("b"))
    wide = {(i, j): max(o[2] for o in ball(radius) if o[:2] == (i, j)) for i, j, _ in ball(radius)}
    steps = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.lit(k).alias("k")) for (i, j), k in wide.items()])).alias("o")
    p = runs.select("z", "y", "a", "b", steps).selectExpr("z + o.i as z", "y + o.j as y", "greatest(a - o.k, 0) as a", f"least(b + o.k, {shape[2] - 1}) as b")
    p = p.where(f"z >= 0 and z < {shape[0]} and y >= 0 and y < {shape[1]} and a <= b").groupBy("z", "y", "a").agg(F.max("b").alias("b"))
    # what the pieces before have covered is left out
    done = F.max("b").over(Window.partitionBy("z", "y").orderBy("a").rowsBetween(Window.unboundedPreceding, -1))
    p = p.withColumn("a", F.greatest(F.col("a"), F.coalesce(done + 1, F.lit(0)))).where("a <= b")
    return p.select("z", "y", F.explode(F.sequence("a", "b")).alias("x"))


def erode_ball(voxels: DataFrame, radius: int, shape: tuple[int, int, int]) -> DataFrame:
    """Voxels whose ball lies in the set; outside the volume counts as inside the set."""
    own = voxels.select(*[F.col(a).cast("int").alias(a) for a in AXES]).distinct()
    need = own.select(*[F.col(a).alias(f"o{a}") for a in AXES], _shifts(ball(radius))).select("oz", "oy", "ox", *[(F.col(f"o{a}") + F.col(f"_o.{k}")).cast("int").alias(a) for a, k in zip(AXES, "ijk")])
    need = need.where(" and ".join(f"{a} >= 0 and {a} < {n}" for a, n in zip(AXES, shape)))
    lost = need.join(own, list(AXES), "left_anti").select(*[F.col(f"o{a}").alias(a) for a in AXES]).distinct()
    return own.join(lost, list(AXES), "left_anti")


def boundary_voxels(labels: DataFrame, shape: tuple[int, int, int]) -> DataFrame:
    """Labelled voxels with a 6-neighbour inside the volume of another label or none."""
    six = [o for o in ball(1) if o != (0, 0, 0)]
    n = labels.select(*[F.col(a).alias(f"o{a}") for a in AXES], "label", _shifts(six)).select("oz", "oy", "ox", F.col("label").alias("own"), *[(F.col(f"o{a}") + F.col(f"_o.{k}")).cast("int").alias(a) for a, k in zip(AXES, "ijk")])
    n = n.where(" and ".join(f"{a} >= 0 and {a} < {s}" for a, s in zip(AXES, shape)))
    j = n.join(labels.select(*[F.col(a).cast("int").alias(a) for a in AXES], "label"), list(AXES), "left").where("label is null or label <> own")
    return j.select(F.col("oz").alias("z"), F.col("oy").alias("y"), F.col("ox").alias("x"), F.col("own").alias("label")).distinct()


def relabel_truth(labels: DataFrame, min_size: int = 10, reorder: bool = True) -> DataFrame:
    """Each label's fully connected pieces of ``min_size`` voxels or more as labels of their own, by centroid if ``reorder``."""
    out = split_components(labels, min_size).select(*AXES, "label")
    return reorder_labels(out) if reorder else out


def expand_labels(seeds: DataFrame, mask: DataFrame) -> DataFrame:
    """Seed labels grown over a mask (z, y, x) from its deepest places; parts of the mask without a seed are left out.

    Each fully connected part of the mask is flooded on its own, by a task that holds its box.
    """
    parts = components(mask.select(*AXES), 26)
    rows = parts.join(seeds.select(*AXES, F.col("label").cast("long").alias("label")), list(AXES), "left").fillna(0, ["label"])
    seeded = rows.groupBy("comp").agg(F.max("label").alias("_m")).where("_m > 0").select("comp")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        at = np.stack([pdf[a].to_numpy() for a in AXES])
        low = at.min(axis=1, keepdims=True) - 1
        own = tuple(at - low)
        m = np.zeros(at.max(axis=1) - low[:, 0] + 2, np.int64)
        s = m.copy()
        m[own], s[own] = 1, pdf["label"]
        out = kernels.flood(s, m > 0, -kernels.label_distance(m))
        return pdf[list(AXES)].assign(label=out[own].astype("int32"))

    return rows.join(seeded, "comp", "left_semi").groupBy("comp").applyInPandas(run, "z int, y int, x int, label int").where("label > 0")
