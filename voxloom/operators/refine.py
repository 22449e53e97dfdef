"""Refinement of single objects against a guide image: label diffusion and guided filtering.

An object's padded box is one group; where boxes reach the same voxel the highest label has it.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as k
from .labels import AXES, region_props


def crops(labels: DataFrame, guide: DataFrame, shape: tuple, pad: int) -> DataFrame:
    """(label, z, y, x, own, g): the voxels of each label's box and ``pad`` around it, inside the volume, with the label there."""
    box = region_props(labels).select(F.col("label"), *[F.greatest(F.col(f"min_{a}") - pad, F.lit(0)).alias(f"l{a}") for a in AXES], *[F.least(F.col(f"max_{a}") + pad - 1, F.lit(n - 1)).alias(f"h{a}") for a, n in zip(AXES, shape)])
    for a in AXES:
        box = box.withColumn(a, F.explode(F.sequence(F.col(f"l{a}").cast("int"), F.col(f"h{a}").cast("int"))))
    own = labels.select(*AXES, F.col("label").alias("own"))
    return box.select("label", *AXES).join(guide.select(*AXES, F.col("v").alias("g")), list(AXES)).join(own, list(AXES), "left").select("label", *AXES, F.coalesce("own", F.lit(0)).alias("own"), "g")


def _per_object(labels: DataFrame, guide: DataFrame, shape: tuple, pad: int, fn) -> DataFrame:
    """Voxels that ``fn(own labels, label, guide)`` marks in a box; sides that the volume cuts off are mirrored in the guide and empty in the labels."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        name = int(pdf["label"].iloc[0])
        at = pdf[list(AXES)].to_numpy()
        low, size = at.min(axis=0), np.ptp(at, axis=0) + 1
        own, g = np.zeros(size, np.int64), np.zeros(size)
        cell = tuple((at - low).T)
        own[cell], g[cell] = pdf["own"], pdf["g"]
        here = np.argwhere(own == name) + low
        before = np.maximum(0, pad - here.min(axis=0))
        after = np.maximum(0, here.max(axis=0) + pad + 1 - np.array(shape))
        sides = list(zip(before, after))
        m = fn(np.pad(own, sides), name, np.pad(g, sides, mode="reflect"))
        found = np.argwhere(m) - before + low
        found = found[((found >= 0) & (found < shape)).all(axis=1)]
        return pd.DataFrame({**{a: found[:, i].astype("int32") for i, a in enumerate(AXES)}, "label": name})

    out = crops(labels, guide, shape, pad).groupBy("label").applyInPandas(run, "z int, y int, x int, label int")
    return out.groupBy(*AXES).agg(F.max("label").alias("label"))


def diffuse_objects(labels: DataFrame, guide: DataFrame, shape: tuple, pad: int = 25, clamp: float = 0.7, iters: int = 50, alpha: float = 0.5, kind: str = "heat") -> DataFrame:
    """Each object spread by label diffusion over a guide of values 0..1 (kind: heat or laplace)."""
    return _per_object(labels, guide, shape, pad, lambda own, name, g: k.diffuse_labels((own == name).astype(int), g, clamp, iters, alpha, kind) > 0)


def guide_objects(
    labels: DataFrame, guide: DataFrame, shape: tuple, pad: int = 25, radius: float = 25, eps: float = 1e-4, adaptive: bool = False, size_factor: float = 0.75,
    least_radius: float = 15.0, classes: int = 2, level: int = 0, additive: bool = False, base_dilate: int = 0, base_erode: int = 5,
    collision_erode: int = 2, collision_close: int = 3, collision_dilate: int = 0, fill_holes: bool = True,
) -> DataFrame:
    """Each object redrawn by a guided filter of its mask, thresholded, kept off its neighbours and closed."""

    def one(own: np.ndarray, name: int, g: np.ndarray) -> np.ndarray:
        me = own == name
        width = int(max(least_radius, size_factor * own.size ** (1 / 3))) if adaptive else int(radius)
        soft = k.guided(me.astype(float), g, width, eps)
        m = k.largest(soft >= k.multi_otsu(soft, classes)[level])
        if additive:
            m = m | (k.dilate(me, base_dilate) if base_dilate else k.erode(me, base_erode))
        if collision_erode:
            m = m & (me | k.erode(own == 0, collision_erode))
        m = k.dilate(k.close(m, collision_close), collision_dilate)
        return k.largest(k.fill(m) if fill_holes else m)

    return _per_object(labels, guide, shape, pad, one)
