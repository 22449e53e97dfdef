"""Connected components of edge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scratch import materialize


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) of the nodes in edges (u, v); root is the component's smallest node.

    Rounds hook every node to its neighbour of the smallest salted hash, jump twice and
    contract, so their number is logarithmic. Nulls and loops do not count.
    """
    e = materialize(edges.where("u is not null and v is not null and u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), "edges")
    labels, k = None, 0
    while e.limit(1).count():
        rank = lambda c, k=k: F.struct(F.xxhash64(F.col(c), F.lit(k)).alias("r"), F.col(c).alias("n"))
        near = e.union(e.select("v", "u")).groupBy("u").agg(F.min(rank("v")).alias("b"))
        p = materialize(near.select("u", F.least("b", rank("u")).getField("n").alias("p")), "hooks")
        q, r = p.selectExpr("u as p", "p as p2"), p.selectExpr("u as p2", "p as up")
        m = materialize(p.join(q, "p").join(r, "p2").selectExpr("u as node", "up"), "jumps")
        a, b = m.selectExpr("node as u", "up as ru"), m.selectExpr("node as v", "up as rv")
        e = materialize(e.join(a, "u").join(b, "v").where("ru <> rv").select(F.least("ru", "rv").alias("u"), F.greatest("ru", "rv").alias("v")).distinct(), "edges")
        if labels is None:
            labels = m.withColumnRenamed("up", "root")
        else:
            labels = materialize(labels.join(m.withColumnRenamed("node", "root"), "root", "left").select("node", F.coalesce("up", "root").alias("root")), "labels")
        k += 1
    if labels is None:
        return e.selectExpr("u as node", "v as root")
    least = labels.groupBy("root").agg(F.min("node").alias("least"))
    return labels.join(least, "root").select("node", F.col("least").alias("root"))
