"""Best assignments of predicted to reference labels, and scores that need one."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import kernels as k
from ..scratch import materialize
from .graph import connected_components
from .labels import AXES, region_props
from .metrics import iou_pairs


def assignment(edges: DataFrame, score: str = "score") -> DataFrame:
    """Of edges (t, p, score > 0) those of an assignment of the largest total score.

    Labels that overlap nobody else are no choice, so the edges fall into components, and
    each is solved on its own in one task; a component is as large as a cluster of labels
    that touch.
    """
    ends = edges.select((2 * F.col("t")).cast("long").alias("u"), (2 * F.col("p") + 1).cast("long").alias("v"))
    root = connected_components(ends).select((F.col("node") / 2).cast("long").alias("t"), F.col("root").alias("_g"), (F.col("node") % 2).alias("_odd")).where("_odd = 0").drop("_odd")
    names = edges.columns

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        ts, ti = np.unique(pdf["t"], return_inverse=True)
        ps, pi = np.unique(pdf["p"], return_inverse=True)
        s = np.zeros((len(ts), len(ps)))
        s[ti, pi] = pdf[score]
        pick = {(int(a), int(b)) for a, b in k.assign(s) if s[a, b] > 0}
        return pdf[[(int(a), int(b)) in pick for a, b in zip(ti, pi)]][names]

    return edges.join(root, "t").groupBy("_g").applyInPandas(run, edges.select(*names).schema)


def largest_matching(edges: DataFrame) -> DataFrame:
    """One row (tp): the most edges (t, p) of which no two share a label.

    An edge whose label on one side has no other is in some largest matching, so leaves are
    taken first; what remains is solved component by component.
    """
    e, got = edges.select("t", "p").distinct(), None
    while True:
        deg = e.withColumns({"_a": F.count("*").over(Window.partitionBy("t")), "_b": F.count("*").over(Window.partitionBy("p"))})
        leaf = deg.where("_a = 1 or _b = 1")
        # of the leaves around one label one is taken
        pick = leaf.groupBy("t").agg(F.min(F.struct((F.col("_a") * F.col("_b")).alias("d"), "p")).alias("m")).select("t", F.col("m.p").alias("p"))
        pick = materialize(pick.groupBy("p").agg(F.min("t").alias("t")).select("t", "p"), "leaves")
        if not pick.limit(1).count():
            break
        got = pick if got is None else got.union(pick)
        e = materialize(e.join(pick.select("t"), "t", "left_anti").join(pick.select("p"), "p", "left_anti").select("t", "p"), "kernel")
    n = e.sparkSession.range(0).selectExpr("0L as n") if got is None else got.agg(F.count("*").alias("n"))
    rest = assignment(e.withColumn("score", F.lit(1.0))).agg(F.count("*").alias("n"))
    return n.union(rest).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("tp"))


def matched(ref: DataFrame, pred: DataFrame, threshold: float = 0.5) -> DataFrame:
    """(t, p, n, n_t, n_p, iou, dice) of the assignment that has the most pairs of IoU >= threshold, then the largest IoU."""
    e = iou_pairs(ref, pred)
    n = e.agg(F.least(F.countDistinct("t"), F.countDistinct("p")).alias("_n"))
    e = e.crossJoin(F.broadcast(n)).withColumn("score", F.when(F.col("iou") >= threshold, 1.0).otherwise(0.0) + F.col("iou") / (2 * F.col("_n"))).drop("_n")  # one row
    return assignment(e).drop("score")


def true_positives(ref: DataFrame, pred: DataFrame, thresholds: tuple) -> DataFrame:
    """(threshold, tp) for thresholds of any size, by an assignment for each; ``thresholds`` is a short list of numbers."""
    out = None
    for th in thresholds:
        m = matched(ref, pred, th).agg(F.count(F.when(F.col("iou") >= th, 1)).alias("tp")).select(F.lit(float(th)).alias("threshold"), "tp")
        out = m if out is None else out.union(m)
    return out


def aggregated_jaccard(ref: DataFrame, pred: DataFrame) -> DataFrame:
    """(matched, total, aji): overlap of the assigned pairs over the voxels of either volume."""
    m = matched(ref, pred).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("matched"))
    u = ref.select(*AXES).union(pred.select(*AXES)).distinct().agg(F.count("*").alias("total"))
    return m.crossJoin(u).withColumn("aji", F.when(F.col("total") > 0, F.col("matched") / F.col("total")))  # one row each


def nearest_candidates(ref: DataFrame, pred: DataFrame, neighbours: int = 15) -> DataFrame:
    """(t, p): for each predicted label the ``neighbours`` reference labels of the nearest centroids that overlap its box.

    Only pairs that share a voxel can match, and these are found by the overlap join; the
    rank by centroid distance among them is what the neighbour limit cuts.
    """
    a = region_props(ref).select(F.col("label").alias("t"), *[F.col(f"c_{x}").alias(f"a{x}") for x in AXES])
    b = region_props(pred).select(F.col("label").alias("p"), *[F.col(f"c_{x}").alias(f"b{x}") for x in AXES])
    d = sum((F.col(f"a{x}") - F.col(f"b{x}")) ** 2 for x in AXES)
    near = iou_pairs(ref, pred).select("t", "p", "iou", "dice").join(a, "t").join(b, "p").withColumn("d", d)
    w = Window.partitionBy("p").orderBy("d", "t")
    return near.withColumn("k", F.row_number().over(w)).where(F.col("k") <= neighbours).select("t", "p", "iou", "dice")


def match_statistics(ref: DataFrame, pred: DataFrame, neighbours: int = 15, least: float = 0.0, eps: float = 1e-5) -> DataFrame:
    """One row: n_gt, n_pred, n_match, pre, rec, f1, iou, dice of the best assignment by IoU among near labels."""
    m = assignment(nearest_candidates(ref, pred, neighbours).withColumn("score", F.col("iou"))).where(F.col("iou") > least)
    s = m.agg(F.count("*").alias("n_match"), F.avg("iou").alias("iou"), F.avg("dice").alias("dice"))
    n = ref.agg(F.countDistinct("label").alias("n_gt")).crossJoin(pred.agg(F.countDistinct("label").alias("n_pred"))).crossJoin(s)  # one row each
    n = n.withColumns({"pre": F.col("n_match") / (F.col("n_pred") + eps), "rec": F.col("n_match") / (F.col("n_gt") + eps)})
    return n.select("n_gt", "n_pred", "n_match", "pre", "rec", (2 * F.col("pre") * F.col("rec") / F.nullif(F.col("pre") + F.col("rec"), F.lit(0.0))).alias("f1"), "iou", "dice")


def mean_class_scores(masks: DataFrame, smooth: float = 0.001, drop_last: bool = True) -> DataFrame:
    """One row (iou, dice): means over classes of (batch, cls, t, p) rows, t and p the 0/1 or soft values.

    Classes absent from a batch on both sides do not count there; the last class is left out
    if there are several and ``drop_last``.
    """
    g = masks.groupBy("batch", "cls").agg(F.sum(F.col("t") * F.col("p")).alias("i"), F.sum("t").alias("a"), F.sum("p").alias("b"))
    if drop_last:
        top = masks.agg(F.max("cls").alias("_m"), F.countDistinct("cls").alias("_k"))
        g = g.crossJoin(F.broadcast(top)).where("_k = 1 or cls < _m")  # one row
    g = g.where("a + b > 0").select("cls", ((F.col("i") + smooth) / (F.col("a") + F.col("b") - F.col("i") + smooth)).alias("iou"), (2 * (F.col("i") + smooth) / (F.col("a") + F.col("b") + smooth)).alias("dice"))
    return g.groupBy("cls").agg(F.avg("iou").alias("iou"), F.avg("dice").alias("dice")).agg(F.avg("iou").alias("iou"), F.avg("dice").alias("dice"))
