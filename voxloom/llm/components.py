"""Connected components of an edge table, by hooking and contraction.

Every round hooks each node to the neighbour (or itself) with the smallest
round-salted hash, follows two more parents, and contracts the edges. Random
priorities keep chains short, so the number of rounds is logarithmic. Minima are
pre-aggregated, joins are plain equi-joins (which adaptive execution splits on a
hub), and every round is written to the shared folder. Once at most ``LOCAL`` edges
are left, the driver joins the rest, as rounds of so few rows are all start-up.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize

#: Edges (16 bytes each) that the driver joins by itself.
LOCAL = 1 << 18


def _ranked(c: str, salt: int):
    return F.struct(F.xxhash64(F.col(c), F.lit(salt)).alias("r"), F.col(c).alias("n"))


def _joined(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(nodes, roots): the root is the smallest node of the component."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    root = np.arange(len(nodes))
    while len(a):
        x, y = root[a], root[b]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while (root[root] != root).any():
            root = root[root]
        apart = root[a] != root[b]
        a, b = a[apart], b[apart]
    return nodes, nodes[root]


def _followed(labels: DataFrame, m: DataFrame) -> DataFrame:
    """``labels`` with the roots' own roots in ``m``; both are discarded."""
    step = m.selectExpr("node as mid", "root as up")
    out = materialize(labels.join(step, F.col("root") == F.col("mid"), "left").select("node", F.coalesce("up", "root").alias("root")), "cc-map")
    discard(labels)
    discard(m)
    return out


def connected_components(edges: DataFrame, u: str = "u", v: str = "v", local: int = LOCAL) -> DataFrame:
    """(node, root) for each node of ``edges``; root is one fixed node of its component.

    Null ends and self-loops are ignored; repeated edges count once; an empty edge
    table gives an empty result.
    """
    e = materialize(
        edges.select(F.col(u).alias("u"), F.col(v).alias("v"))
        .where("u is not null and v is not null and u <> v")
        .select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"))
        .distinct(),
        "cc-edges",
    )
    labels, k = None, 0
    whole = {f.dataType.typeName() for f in e.schema} == {"long"}
    while n := e.limit(local + 1).count():
        if whole and n <= local:
            t = e.toArrow()
            nodes, roots = _joined(*(t[c].to_numpy() for c in "uv"))
            m = materialize(e.sparkSession.createDataFrame(pa.table({"node": nodes, "root": roots})), "cc-map")
            discard(e)
            return m if labels is None else _followed(labels, m)
        both = e.union(e.select("v", "u"))
        best = both.groupBy("u").agg(F.min(_ranked("v", k)).alias("b"))
        p = materialize(best.select("u", F.least(F.col("b"), _ranked("u", k)).getField("n").alias("p")), "cc-hook")
        q, r = p.selectExpr("u as qu", "p as qp"), p.selectExpr("u as ru", "p as rp")
        m = materialize(
            p.join(q, F.col("p") == F.col("qu")).join(r, F.col("qp") == F.col("ru")).selectExpr("u as node", "rp as root"),
            "cc-map",
        )
        discard(p)
        a, b = m.selectExpr("node as u", "root as ru"), m.selectExpr("node as v", "root as rv")
        new = materialize(
            e.join(a, "u").join(b, "v").where("ru <> rv").select(F.least("ru", "rv").alias("u"), F.greatest("ru", "rv").alias("v")).distinct(),
            "cc-edges",
        )
        discard(e)
        e = new
        if labels is None:
            labels = m
        else:
            labels = _followed(labels, m)
        k += 1
    return labels if labels is not None else e.selectExpr("u as node", "v as root")
