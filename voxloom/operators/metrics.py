"""Scores of predicted against reference labels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scratch import materialize
from .labels import AXES, components


def label_overlap(ref: DataFrame, pred: DataFrame, by: tuple = ()) -> DataFrame:
    """(t, p, n): voxels that reference label t and predicted label p share."""
    a = ref.select(*by, *AXES, F.col("label").alias("t"))
    return a.join(pred.select(*by, *AXES, F.col("label").alias("p")), [*by, *AXES]).groupBy(*by, "t", "p").agg(F.count("*").alias("n"))


def iou_pairs(ref: DataFrame, pred: DataFrame, by: tuple = ()) -> DataFrame:
    """(t, p, n, n_t, n_p, iou, dice) of all label pairs that overlap."""
    keys = list(by)
    nt = ref.groupBy(*keys, F.col("label").alias("t")).agg(F.count("*").alias("n_t"))
    np_ = pred.groupBy(*keys, F.col("label").alias("p")).agg(F.count("*").alias("n_p"))
    j = label_overlap(ref, pred, by).join(nt, [*keys, "t"]).join(np_, [*keys, "p"])
    return j.select(*keys, "t", "p", "n", "n_t", "n_p", (F.col("n") / (F.col("n_t") + F.col("n_p") - F.col("n"))).alias("iou"), (2 * F.col("n") / (F.col("n_t") + F.col("n_p"))).alias("dice"))


def average_precision(ref: DataFrame, pred: DataFrame, thresholds: tuple = (0.5, 0.75, 0.9)) -> DataFrame:
    """(threshold, tp, fp, fn, ap); the numbers of objects are the largest labels, gaps included.

    Above 0.5 a label has one partner at most, so pairs are counted; at 0.5 (two halves of one
    label tie) and below, the largest assignment counts.
    """
    from .matching import largest_matching

    spark = ref.sparkSession
    top = ref.agg(F.coalesce(F.max("label"), F.lit(0)).alias("n_t")).crossJoin(pred.agg(F.coalesce(F.max("label"), F.lit(0)).alias("n_p")))
    hit = materialize(iou_pairs(ref, pred).select("t", "p", "iou").where(F.col("iou") >= min(thresholds)), "hits")
    th = F.explode(F.array(*[F.lit(float(x)) for x in thresholds])).alias("threshold")
    tp = hit.where("iou > 0.5").select("iou", th).where("iou >= threshold and threshold > 0.5").groupBy("threshold").agg(F.count("*").alias("tp"))
    for x in sorted({float(x) for x in thresholds if x <= 0.5}):
        tp = tp.union(largest_matching(hit.where(F.col("iou") >= x)).select(F.lit(x).alias("threshold"), "tp"))
    all_th = spark.range(1).select(th)
    j = all_th.join(tp, "threshold", "left").crossJoin(top).withColumn("tp", F.coalesce("tp", F.lit(0)))
    j = j.withColumns({"fp": (F.col("n_p") - F.col("tp")).cast("long"), "fn": (F.col("n_t") - F.col("tp")).cast("long")})
    total = F.col("tp") + F.col("fp") + F.col("fn")
    return j.select("threshold", "tp", "fp", "fn", F.when(total > 0, F.col("tp") / total).alias("ap"))


def average_precision_curve(ref: DataFrame, pred: DataFrame, by: str, thresholds: tuple) -> DataFrame:
    """(threshold, ap, images): the mean AP over the images that ``by`` names, each of which has labels; thresholds are above 0.5.

    An image without predictions counts with zero.
    """
    if min(thresholds) <= 0.5:
        raise ValueError("several images are scored above 0.5, where a label has one partner")
    th = F.explode(F.array(*[F.lit(float(x)) for x in thresholds])).alias("threshold")
    top = ref.groupBy(by).agg(F.max("label").alias("n_t")).join(pred.groupBy(by).agg(F.max("label").alias("n_p")), by, "left").select("*", th)
    tp = iou_pairs(ref, pred, (by,)).where("iou > 0.5").select(by, "iou", th).where("iou >= threshold").groupBy(by, "threshold").agg(F.count("*").alias("tp"))
    j = top.join(tp, [by, "threshold"], "left").withColumn("tp", F.coalesce("tp", F.lit(0)))
    ap = F.col("tp") / (F.col("n_t") + F.coalesce("n_p", F.lit(0)) - F.col("tp"))
    return j.groupBy("threshold").agg(F.avg(ap).alias("ap"), F.count("*").alias("images"))


def best_matches(ref: DataFrame, pred: DataFrame) -> DataFrame:
    """Per reference label the predicted one of the largest IoU (ties: the smaller label)."""
    b = iou_pairs(ref, pred).groupBy("t").agg(F.min(F.struct((-F.col("iou")).alias("a"), "p", "iou", "n")).alias("b"))
    return b.select("t", "b.p", "b.iou", "b.n")


def jaccard_at_half(ref: DataFrame, pred: DataFrame) -> DataFrame:
    """(matched, total, aji): overlap of pairs of IoU above 0.5 over the voxels of either volume.

    The part of the aggregated Jaccard index that needs no assignment.
    """
    m = iou_pairs(ref, pred).where("iou > 0.5").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("matched"))
    u = ref.select(*AXES).union(pred.select(*AXES)).distinct().agg(F.count("*").alias("total"))
    return m.crossJoin(u).withColumn("aji", F.when(F.col("total") > 0, F.col("matched") / F.col("total")))


def class_scores(rows: DataFrame, true: str, pred: str, smooth: float = 0.001) -> DataFrame:
    """Smoothed IoU and Dice of two 0/1 columns."""
    t, p = F.col(true), F.col(pred)
    s = rows.agg(F.sum(t * p).alias("i"), F.sum(t).alias("a"), F.sum(p).alias("b"))
    return s.select(((F.col("i") + smooth) / (F.col("a") + F.col("b") - F.col("i") + smooth)).alias("iou"), (2 * (F.col("i") + smooth) / (F.col("a") + F.col("b") + smooth)).alias("dice"))


def valid_region(ref: DataFrame, pred: DataFrame, least: float = 0.01) -> DataFrame:
    """Predicted voxels whose foreground component is covered by the reference to ``least`` or more."""
    c = components(pred.select(*AXES), 26)
    cover = c.join(ref.select(*AXES, F.lit(1).alias("r")).distinct(), list(AXES), "left").groupBy("comp").agg((F.count("r") / F.count("*")).alias("cover"))
    return c.join(cover.where(F.col("cover") >= least).select("comp"), "comp", "left_semi").select(*AXES)
