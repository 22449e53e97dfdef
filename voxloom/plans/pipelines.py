"""The pipelines: preprocessing, aggregation of three views into a volume, postprocessing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import flows as fl
from ..operators import intensity as it
from ..operators import labels as lb
from ..operators import slices as sl
from ..operators import smooth as sm
from ..operators.stencils import AXES, combine_by_variance
from ..scratch import materialize
from .params import Aggregation, Postprocess, Preprocess


def preprocess(df: DataFrame, shape: tuple, p: Preprocess = Preprocess()) -> tuple[DataFrame, tuple]:
    """A dense volume (z, y, x, v) with its zeros filled, resized, flattened and stretched to 0..1; its new shape."""
    df = it.fill_low(df, 0, "median")
    to = tuple(max(1, round(n * p.factor * r)) for n, r in zip(shape, p.voxel_res))
    df = sm.resize(df, ["v"], shape, to, corners=True)
    if p.do_bg_correction:
        bg = sm.smooth_volume(df, p.bg_ds, p.bg_sigma, to).withColumnRenamed("v", "bg")
        df = it.background_correct(df.join(bg, list(AXES))).drop("bg")
    return it.percentile_normalize(df, p.normalize_min, p.normalize_max, clip=True), to


def foreground(fused: DataFrame, shape: tuple, p: Aggregation) -> DataFrame:
    """Voxels (z, y, x) of a fused dense volume above the threshold, after the morphology."""
    c, b = p.probs, p.binary
    if c.smooth_sigma > 0:
        fused = sm.gaussian(fused, ["v"], c.smooth_sigma, shape)
    if c.prob_thresh is not None:
        m = fused.where(F.col("v") >= c.prob_thresh)
    else:
        if c.threshold_n_levels == 3:
            t = F.col(("low", "high")[c.threshold_level])
            cut = it.multi_otsu(fused)
        elif c.threshold_n_levels == 2:
            t, cut = F.col("threshold"), it.otsu(fused)
        else:
            raise ValueError("two or three levels")
        t = F.when(t < 0, F.ceil(t * 10)).otherwise(F.floor(t * 10)) / 10 if c.one_decimal else t
        m = fused.crossJoin(F.broadcast(cut.select(F.greatest(t, F.lit(c.min_prob_thresh)).alias("_t")))).where("v >= _t")  # one row
    m = m.select(*AXES)
    if b.closing:
        m = lb.erode_ball(lb.dilate_ball(m, b.closing, shape), b.closing, shape)
    m = materialize(m, "foreground")
    if b.remove_small:
        m = lb.remove_small_components(m, b.remove_small, 18).select(*AXES)
    if b.dilation:
        m = lb.dilate_ball(m, b.dilation, shape)
    if b.fill_holes:
        m = lb.fill_holes(m, shape)
    if b.extra_erode:
        m = lb.erode_ball(m, b.extra_erode, shape)
    return materialize(m, "foreground")


def _gather(mask: DataFrame, flow: DataFrame, shape: tuple, p: Aggregation) -> DataFrame:
    d = p.descent
    ends = fl.advect(mask, flow, shape, d.tile_shape if d.tiled else None, d.overlap, n_iter=d.n_iter, delta=d.delta, momentum=d.momentum, decay=d.decay, interp=d.interp, renorm=d.renorm)
    return fl.vote_clusters(materialize(ends, "ends"), shape, p.cluster.smooth_sigma, p.cluster.thresh_factor, mask if d.tiled else None)


def aggregate_direct(probs: dict[str, DataFrame], flows: DataFrame, shape: tuple, p: Aggregation = Aggregation(), mask: DataFrame | None = None) -> DataFrame:
    """Labels (z, y, x, label) of two-dimensional probabilities and flows.

    ``probs``: dense (z, y, x, v) by view, logits or 0..1; ``flows``: (view, slice, r, c, d_row,
    d_col) of the same views. Absent views are left out.
    """
    if mask is None:
        clipped = F.least(F.greatest("v", F.lit(-88.72)), F.lit(88.72))
        v = 1 / (1 + F.exp(-clipped)) if p.probs.logits else clipped
        fused = combine_by_variance([x.withColumn("v", v) for x in probs.values()], p.probs.ksize, shape, p.probs.alpha, p.probs.eps)
        mask = foreground(materialize(fused, "fused"), shape, p)
    g = p.gradients
    flow = fl.fuse_flows(fl.lift(flows), shape, tuple(probs), g.ksize, g.alpha, g.smooth_sigma)
    return _gather(mask, materialize(flow, "flow"), shape, p)


def aggregate_indirect(slices: DataFrame, shape: tuple, p: Aggregation = Aggregation(), mask: DataFrame | None = None) -> DataFrame:
    """Labels (z, y, x, label) of label slices (view, slice, r, c, label).

    A view without labels counts as an empty volume in the foreground, and not at all in the flow.
    """
    views = [r[0] for r in slices.select("view").distinct().collect()]  # three at most
    if mask is None:
        parts = []
        for v in fl.VIEWS:
            own = fl.unslice(slices, v).select(*AXES).withColumn("v", F.lit(1.0))
            parts.append(sm.gaussian(sm.densify(own, shape, v=0.0), ["v"], p.indirect.smooth_binary, shape))
        fused = materialize(combine_by_variance(parts, p.probs.ksize, shape, p.probs.alpha, p.probs.eps), "fused")
        top = fused.agg((F.max("v") + 1e-12).alias("_m"))
        fused = fused.crossJoin(F.broadcast(top)).select(*AXES, F.least(F.greatest(F.col("v") / F.col("_m"), F.lit(0.0)), F.lit(1.0)).alias("v"))  # one row
        mask = foreground(fused, shape, p)
    i, g = p.indirect, p.gradients
    how = {} if i.method == "edt" else {"quantile": i.quantile, "iter_factor": i.iter_factor, "skel_sigma": i.skel_sigma, "power": i.power}
    flow = fl.fuse_flows(fl.lift(fl.slice_flows(slices, shape, i.method, **how)), shape, tuple(v for v in fl.VIEWS if v in views), g.ksize, g.alpha, g.smooth_sigma)
    return _gather(mask, materialize(flow, "flow"), shape, p)


def postprocess(labels: DataFrame, shape: tuple, flow: DataFrame | None = None, p: Postprocess = Postprocess(), a: Aggregation = Aggregation()) -> DataFrame:
    """Small labels dropped and holes filled, largest components, flow consistency, and the size statistics filter."""
    out = lb.remove_small_labels(labels, p.min_size)
    filled = sl.fill_label_slices(out.select(F.col("z").alias("slice"), F.col("y").alias("r"), F.col("x").alias("c"), F.col("label").cast("long").alias("label")))
    out = lb.relabel_sequential(filled.select(F.col("slice").alias("z"), F.col("r").alias("y"), F.col("c").alias("x"), F.col("label").cast("int").alias("label")))
    if p.max_size is not None:
        big = out.groupBy("label").count().where(F.col("count") > p.max_size).select("label")
        out = out.join(big, "label", "left_anti").select(*AXES, "label")
    out = materialize(lb.relabel_sequential(lb.largest_component_per_label(materialize(out, "sized"), 18).select(*AXES, "label")), "largest")
    if p.do_flow_remove and flow is not None:
        own = fl.label_flow(out, shape, p.method, a.gradients.ksize, a.gradients.alpha, a.gradients.smooth_sigma, **({} if p.method == "edt" else {"quantile": p.quantile}))
        out = materialize(fl.remove_bad_flows(out, flow, own, p.flow_threshold), "consistent")
    return lb.size_statistics_filter(out, p.max_size_factor).select(*AXES, "label") if p.do_stats_filter else out.select(*AXES, "label")
