"""Triangle meshes as two tables: vertices (vid, z, y, x) and faces (a, b, c).

Surfaces are cut out of a volume by tetrahedra: every unit cube between eight voxel centres falls into
six, one for each order of the axes, and each tetrahedron's corners above and below the level
say which of its edges the surface crosses. Crossed edges name the vertices, so cubes and tiles
meet without a search.
"""

from __future__ import annotations

import struct
from itertools import permutations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..scratch import materialize
from .graph import connected_components
from .labels import AXES

_SPAN = 1 << 20
_TRIANGLE = ", ".join(f"v{k} long, z{k} double, y{k} double, x{k} double" for k in range(3))


def _corners(order: tuple) -> np.ndarray:
    """The four corners of the tetrahedron that walks the axes in this order."""
    out = np.zeros((4, 3), np.int64)
    for k, a in enumerate(order):
        out[k + 1 :, a] = 1
    return out


def _surface(v: np.ndarray, low: np.ndarray, level: float) -> tuple[np.ndarray, np.ndarray]:
    """(names, places) of the triangles' corners in the cubes of an array whose first voxel stands at ``low``."""
    found = []
    cube = tuple(n - 1 for n in v.shape)
    at = np.stack(np.meshgrid(*[np.arange(n) for n in cube], indexing="ij"), -1).reshape(-1, 3)
    for order in permutations(range(3)):
        tet = _corners(order)
        p = at[:, None, :] + tet
        w = v[p[..., 0], p[..., 1], p[..., 2]] - level
        up = w >= 0
        some = up.any(axis=1) & ~up.all(axis=1)
        p, w, up = p[some], w[some], up[some]
        for mask in range(1, 15):
            above = [k for k in range(4) if mask >> k & 1]
            below = [k for k in range(4) if not mask >> k & 1]
            rows = np.flatnonzero((up == [k in above for k in range(4)]).all(axis=1))
            if not len(rows):
                continue
            edges = [(a, b) for a in above for b in below]
            if len(edges) == 4:  # a quadrangle, its corners in turn
                edges = [edges[0], edges[1], edges[3], edges[2]]
            where, names = [], []
            for a, b in edges:
                s = w[rows, a] / (w[rows, a] - w[rows, b])
                where.append(p[rows, a] + s[:, None] * (p[rows, b] - p[rows, a]) + low)
                i, j = min(a, b), max(a, b)
                start = p[rows, i] + low + 1
                way = (tet[j] - tet[i]) @ np.array([4, 2, 1])
                names.append(((start[:, 0] * _SPAN + start[:, 1]) * _SPAN + start[:, 2]) * 8 + way)
            # the triangle of the edges' middles is never flat, and turns as all of its kind
            middle = np.array([(tet[a] + tet[b]) / 2 for a, b in edges])
            for tri in ((0, 1, 2),) if len(edges) == 3 else ((0, 1, 2), (0, 2, 3)):
                m = middle[list(tri)]
                out = np.cross(m[1] - m[0], m[2] - m[0]) @ (tet[above].mean(axis=0) - m[0]) < 0
                tri = tri if out else (tri[0], tri[2], tri[1])
                found.append((np.stack([names[k] for k in tri], 1), np.stack([where[k] for k in tri], 1)))
    if not found:
        return np.zeros((0, 3), np.int64), np.zeros((0, 3, 3))
    n, q = (np.concatenate(x) for x in zip(*found))
    return n, q


def surface(volume: DataFrame, level: float = 0.5, tile: int = 48) -> tuple[DataFrame, DataFrame]:
    """(vertices, faces) where ``v`` of a volume (z, y, x, v) crosses ``level``; absent voxels are 0, so surfaces close at the border.

    Coordinates are from 0 to 2^20 - 3. Each tile of cubes is cut by one task. A triangle that
    shrinks to a vertex (v equal to the level) stays, so that the mesh is closed.
    """
    tiles = lambda a: F.array_distinct(F.array(F.floor(F.col(a) / tile), F.floor((F.col(a) - 1) / tile)).cast("array<int>"))
    rows = volume.where(F.col("v") != 0).select(*AXES, F.col("v").cast("double").alias("v"))
    for a in AXES:
        rows = rows.withColumn(f"t{a}", F.explode(tiles(a)))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        low = np.array([int(pdf[f"t{a}"].iloc[0]) * tile for a in AXES])
        v = np.zeros((tile + 1,) * 3)
        v[tuple(pdf[a].to_numpy() - k for a, k in zip(AXES, low))] = pdf["v"]
        n, q = _surface(v, low, level)
        return pd.DataFrame({k: c for i in range(3) for k, c in zip((f"v{i}", f"z{i}", f"y{i}", f"x{i}"), (n[:, i], *q[:, i].T))})

    tri = materialize(rows.groupBy("tz", "ty", "tx").applyInPandas(run, _TRIANGLE), "triangles").hint("merge")
    corner = lambda k: F.struct(F.col(f"v{k}").alias("vid"), *[F.col(f"{a}{k}").alias(a) for a in AXES])
    vertices = tri.select(F.explode(F.array(*map(corner, range(3)))).alias("p")).select("p.*").groupBy("vid").agg(*[F.first(a).alias(a) for a in AXES])
    return materialize(vertices, "vertices").hint("merge"), tri.select(F.col("v0").alias("a"), F.col("v1").alias("b"), F.col("v2").alias("c"))


def mesh_of_mask(mask: DataFrame, shape: tuple, sigma: float = 1.0, level: float = 0.5, largest_only: bool = True) -> tuple[DataFrame, DataFrame]:
    """The surface of a mask (z, y, x), smoothed, scaled to its largest value and cut at ``level``; its largest part."""
    from .smooth import densify, gaussian

    v = densify(mask.select(*AXES, F.lit(1.0).alias("v")), shape, v=0.0)
    v = materialize(gaussian(v, ["v"], sigma, shape) if sigma > 0 else v, "mask")
    top = v.agg(F.max("v").alias("_m"))
    mesh = surface(v.crossJoin(F.broadcast(top)).select(*AXES, (F.col("v") / F.col("_m")).alias("v")), level)  # one row
    return largest_part(*mesh) if largest_only else mesh


def _sides(faces: DataFrame) -> DataFrame:
    """(u, v, w): the directed edges of the faces, and the corner across."""
    side = lambda a, b, c: F.struct(F.col(a).alias("u"), F.col(b).alias("v"), F.col(c).alias("w"))
    return faces.select(F.explode(F.array(side("a", "b", "c"), side("b", "c", "a"), side("c", "a", "b"))).alias("e")).select("e.*")


def largest_part(vertices: DataFrame, faces: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The connected part with the most vertices; of equals the one with the smallest vid."""
    root = materialize(connected_components(_sides(faces).select("u", "v")), "parts")
    best = root.groupBy("root").agg(F.count("*").alias("n")).agg(F.min(F.struct((-F.col("n")).alias("a"), "root")).alias("b")).select(F.col("b.root").alias("root"))
    keep = materialize(root.join(F.broadcast(best), "root").select(F.col("node").alias("vid")), "part")  # one row
    return vertices.join(keep, "vid", "left_semi"), faces.join(keep, faces.a == keep.vid, "left_semi")


def mesh_properties(vertices: DataFrame, faces: DataFrame) -> DataFrame:
    """One row: n_vertices, n_edges, n_faces, euler, genus, watertight, winding, convex, volume and area.

    watertight: every edge has two faces; winding: each direction of an edge has one; convex: no
    corner lies outside the plane of the face across its edge. genus is that of one closed
    part, else null; volume is null for a mesh that is not watertight.
    """
    sides = materialize(_sides(faces), "sides")
    ends = sides.groupBy(F.least("u", "v").alias("p"), F.greatest("u", "v").alias("q")).agg(F.count("*").alias("n"), F.count_if(F.col("u") < F.col("v")).alias("up"))
    e = ends.agg(F.count("*").alias("n_edges"), F.coalesce(F.bool_and(F.col("n") == 2), F.lit(False)).alias("watertight"), F.coalesce(F.bool_and((F.col("n") == 2) & (F.col("up") == 1)), F.lit(False)).alias("winding"))
    at = lambda k, c: vertices.select(F.col("vid").alias(c), F.array(*AXES).alias(k))
    placed = faces.join(at("pa", "a"), "a").join(at("pb", "b"), "b").join(at("pc", "c"), "c")
    less = lambda p, q: F.zip_with(p, q, lambda x, y: x - y)
    g = F.element_at
    cross = lambda p, q: F.array(*[g(p, i) * g(q, j) - g(p, j) * g(q, i) for i, j in ((2, 3), (3, 1), (1, 2))])
    dot = lambda p, q: sum(g(p, i) * g(q, i) for i in (1, 2, 3))
    normal = cross(less("pb", "pa"), less("pc", "pa"))
    placed = materialize(placed.select("a", "b", "c", "pa", normal.alias("n")), "normals")
    f = placed.agg(F.count("*").alias("n_faces"), (F.coalesce(F.sum(F.sqrt(dot("n", "n"))), F.lit(0.0)) / 2).alias("area"), (F.coalesce(F.sum(dot("pa", "n")), F.lit(0.0)) / 6).alias("signed"))
    back = sides.select(F.col("v").alias("u"), F.col("u").alias("v"), F.col("w").alias("over"))
    own = placed.select(F.explode(F.array(*[F.struct(F.col(p).alias("u"), F.col(q).alias("v")) for p, q in (("a", "b"), ("b", "c"), ("c", "a"))])).alias("e"), "pa", "n").select("e.*", "pa", "n")
    bend = own.join(back, ["u", "v"]).join(at("po", "over"), "over").select(dot("n", less("po", "pa")).alias("out"), F.sqrt(dot("n", "n")).alias("size"))
    eps = 1e-8 * F.greatest("size", F.lit(1.0))
    c = bend.agg(F.coalesce(F.bool_and(F.col("out") <= eps), F.lit(True)).alias("below"), F.coalesce(F.bool_and(F.col("out") >= -eps), F.lit(True)).alias("above"))
    out = vertices.agg(F.count("*").alias("n_vertices")).crossJoin(e).crossJoin(f).crossJoin(c)  # one row each
    out = out.withColumn("euler", F.col("n_vertices") - F.col("n_edges") + F.col("n_faces"))
    closed = F.col("watertight") & F.col("winding")
    return out.select(
        "n_vertices", "n_edges", "n_faces", "euler", F.when(closed, 1 - F.col("euler") / 2).alias("genus"), "watertight", "winding",
        (closed & F.when(F.col("signed") > 0, F.col("below")).otherwise(F.col("above"))).alias("convex"), F.when(F.col("watertight"), F.abs("signed")).alias("volume"), "area",
    )


def read_mesh(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(vertices, faces) with column ``file`` of the .obj (v and f lines) and binary .stl files at a path; a file is one record.

    Faces of more than three corners are cut into fans. Points of an .stl that are equal are one vertex.
    """
    files = spark.read.format("binaryFile").load(path).select(F.col("path").alias("file"), "content")

    def run(frames):
        for pdf in frames:
            for name, raw in zip(pdf["file"], pdf["content"]):
                p, f = _stl(raw) if name.lower().endswith(".stl") else _obj(raw)
                n = len(p) + len(f)
                out = np.full((n, 3), np.nan)
                out[: len(p)] = p
                ids = np.full((n, 3), -1, np.int64)
                ids[len(p) :] = f
                yield pd.DataFrame({"file": name, "vid": np.r_[np.arange(len(p)), [-1] * len(f)], **dict(zip(AXES, out.T)), **dict(zip("abc", ids.T))})

    rows = materialize(files.mapInPandas(run, "file string, vid long, z double, y double, x double, a long, b long, c long"), "mesh")
    return rows.where("vid >= 0").select("file", "vid", *AXES), rows.where("vid < 0").select("file", "a", "b", "c")


def _obj(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    p, f = [], []
    for line in raw.decode().splitlines():
        w = line.split()
        if w[:1] == ["v"]:
            p.append([float(x) for x in w[3:0:-1]])
        elif w[:1] == ["f"]:
            ids = [int(x.split("/")[0]) for x in w[1:]]
            ids = [i - 1 if i > 0 else len(p) + i for i in ids]
            f += [[ids[0], *pair] for pair in zip(ids[1:], ids[2:])]
    return np.array(p, float).reshape(-1, 3), np.array(f, np.int64).reshape(-1, 3)


def _stl(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    n = struct.unpack_from("<I", raw, 80)[0]
    t = np.frombuffer(raw, np.dtype([("n", "<f4", 3), ("p", "<f4", (3, 3)), ("k", "<u2")]), n, 84)["p"].reshape(-1, 3)
    p, at = np.unique(t[:, ::-1].astype(float), axis=0, return_inverse=True)
    return p, at.reshape(-1, 3)
