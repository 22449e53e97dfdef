"""Kernels, slices, flows and pipelines against plain numpy."""

import numpy as np
import pytest

from voxloom.operators import flows as fl
from voxloom.operators import kernels as k
from voxloom.operators import matching as mc
from voxloom.operators import metrics as mt
from voxloom.operators import refine as rf
from voxloom.operators import slices as sl
from voxloom.operators import smooth as sm
from voxloom.plans import pipelines as pl
from voxloom.plans.params import Aggregation, Binary, Cluster, CombineProbs, Descent, Indirect, Postprocess

SHAPE = (10, 12, 14)


def balls():
    z, y, x = np.indices(SHAPE)
    a = np.where((z - 4) ** 2 + (y - 4) ** 2 + (x - 4) ** 2 <= 9, 1, 0)
    return np.where((z - 5) ** 2 + (y - 7) ** 2 + (x - 10) ** 2 <= 9, 2, a)


def table(spark, a, col="label", dense=False):
    at = np.argwhere(np.ones_like(a) if dense else a != 0).tolist()
    kind = "int" if a.dtype.kind in "iu" else "double"
    return spark.createDataFrame([(*c, a[tuple(c)].item()) for c in at], f"z int, y int, x int, {col} {kind}")


def array(df, col="label"):
    out = np.zeros(SHAPE)
    for r in df.select("z", "y", "x", col).collect():
        out[r[0], r[1], r[2]] = r[3]
    return out


def rows2(spark, a):
    return spark.createDataFrame([(int(s), int(r), int(c), int(a[s, r, c])) for s, r, c in np.argwhere(a > 0)], "slice int, r int, c int, label int")


def test_distance_brute():
    lab = balls()[5]
    d = k.label_distance(lab)
    for y, x in np.argwhere(lab > 0):
        other = np.argwhere(lab != lab[y, x])
        assert d[y, x] == pytest.approx(np.sqrt(((other - [y, x]) ** 2).sum(axis=1).min()))
    assert (d[lab == 0] == 0).all()


def test_components_and_fill():
    m = np.zeros((7, 7), bool)
    m[1:6, 1:6] = True
    m[3, 3] = False
    assert k.fill(m).sum() == 25
    assert k.component_labels(~m, 1).max() == 2
    m[0, 0] = True
    assert k.component_labels(m, 1).max() == 2 and k.component_labels(m, 2).max() == 1


def test_poisson_solves():
    m = np.zeros((9, 9), bool)
    m[2:7, 3:8] = True
    x = k.poisson(m, np.array([[5, 5]]))
    n = np.zeros((11, 11))
    free = np.pad(m, 1, constant_values=True)
    idx = {tuple(c): i for i, c in enumerate(np.argwhere(free))}
    a, b = np.zeros((len(idx), len(idx))), np.zeros(len(idx))
    for (y, c), i in idx.items():
        a[i, i] = 4
        b[i] = (y, c) == (5, 5)
        for q in ((y - 1, c), (y + 1, c), (y, c - 1), (y, c + 1)):
            if q in idx:
                a[i, idx[q]] = -1
    for (q, i), v in zip(idx.items(), np.linalg.solve(a, b)):
        n[q] = v
    n = n[1:-1, 1:-1]
    assert np.allclose(x, n - n.min(), atol=1e-8)


@pytest.mark.parametrize("method", ["poisson", "poisson_skeleton", "heat", "fmm", "fmm_skeleton"])
def test_object_flows(method):
    lab = balls()[5]
    d, f = k.slice_flow(lab, method, k.label_distance(lab))
    n = np.sqrt((f**2).sum(axis=0))
    assert (f[:, lab == 0] == 0).all() and np.isfinite(d).all()
    assert (n < 1 + 1e-6).all() and (n[lab > 0] > 0.5).mean() > 0.5


def test_assign_brute():
    from itertools import permutations

    rng = np.random.default_rng(3)
    for shape in ((3, 5), (5, 3), (4, 4)):
        s = rng.random(shape)
        got = k.assign(s)
        few, many = min(shape), max(shape)
        t = s if shape[0] <= shape[1] else s.T
        best = max(sum(t[i, q[i]] for i in range(few)) for q in permutations(range(many), few))
        assert len(got) == few and sum(s[a, b] for a, b in got) == pytest.approx(best)


def test_gaussian(spark):
    a = np.random.default_rng(1).random(SHAPE)
    got = array(sm.gaussian(table(spark, a, "v", True), ["v"], 1.0, SHAPE), "v")
    assert np.allclose(got, k.gaussian(a, 1.0))
    wide = array(sm.gaussian(table(spark, a, "v", True), ["v"], 3.0, SHAPE), "v")  # wider than the volume
    assert np.allclose(wide, k.gaussian(a, 3.0))


def test_resize_and_median(spark):
    a = np.random.default_rng(2).random(SHAPE)
    t = table(spark, a, "v", True)
    back = array(sm.resize(sm.resize(t, ["v"], SHAPE, (10, 12, 27), corners=True), ["v"], (10, 12, 27), SHAPE, corners=True), "v")
    assert np.allclose(back, a)
    p = np.pad(a, 1, mode="symmetric")
    med = np.median([p[i : i + 10, j : j + 12, l : l + 14] for i in range(3) for j in range(3) for l in range(3)], axis=0)
    assert np.allclose(array(sm.median_filter(t, 3, SHAPE), "v"), med)


def test_slice_operators(spark):
    lab = balls()
    rows = rows2(spark, lab)
    rel = sl.relabel_slices(rows).collect()
    off, want = 0, {}
    for s in range(SHAPE[0]):
        m = np.where(lab[s] > 0, lab[s] + off, 0)
        want.update({(s, r, c): m[r, c] for r, c in np.argwhere(m > 0)})
        off += m.max()
    assert {(r[0], r[1], r[2]): r[3] for r in rel} == want
    n = sum(k.component_labels(lab[s] == v, 2).max() for s in range(SHAPE[0]) for v in (1, 2))
    assert sl.component_slices(rows).agg({"label": "max"}).first()[0] == n
    assert sl.unique_slices(rows).agg({"label": "max"}).first()[0] == len({(s, v) for s, _, _ in np.argwhere(lab > 0) for v in np.unique(lab[s]) if v})
    kept = sl.filter_slice_labels(rows, 5).count()
    assert kept == sum(int((k.component_labels(lab[s] == v, 2) > 0).sum()) for s in range(SHAPE[0]) for v in (1, 2) if (lab[s] == v).sum() > 5)


def test_persistence(spark):
    lab = balls()
    lab[9, 0, 0] = 7  # alone in its slice
    got = sl.persistent_slices(rows2(spark, lab), SHAPE[0], 3).collect()
    assert 7 not in {r[3] for r in got} and {1, 2} <= {r[3] for r in got}
    stable = sl.stable_slices(rows2(spark, lab), SHAPE[0], 3, 0.6).collect()
    assert {1, 2} <= {r[3] for r in stable}


def test_matching(spark):
    lab = balls()
    pred = np.roll(lab, 1, axis=2)
    a, b = table(spark, lab), table(spark, pred)
    m = {(r["t"], r["p"]) for r in mc.matched(a, b).collect()}
    assert m == {(1, 1), (2, 2)}
    low = {r["threshold"]: r["tp"] for r in mc.true_positives(a, b, (0.1, 0.99)).collect()}
    assert low == {0.1: 2, 0.99: 0}
    j = mc.aggregated_jaccard(a, a).first()
    assert j["aji"] == 1
    s = mc.match_statistics(a, a).first()
    assert (s["n_gt"], s["n_pred"], s["n_match"], s["iou"]) == (2, 2, 2, 1)


def test_advect_and_cluster(spark):
    lab = balls()
    f = k.unit(k.gradient(k.label_distance(lab, True)))
    at = [(*c, *f[(slice(None), *c)].tolist()) for c in np.argwhere(np.ones(SHAPE)).tolist()]
    field = spark.createDataFrame(at, "z int, y int, x int, dz double, dy double, dx double")
    ends = fl.advect(table(spark, lab), field, SHAPE, n_iter=30)
    got = {tuple(r)[:3]: tuple(r)[3:] for r in ends.collect()}
    start = np.argwhere(lab > 0)
    want = k.advect(f, start, 30)
    assert all(np.allclose(got[tuple(s)], w) for s, w in zip(start.tolist(), want))
    out = array(fl.vote_clusters(ends, SHAPE))
    assert len(np.unique(out[lab > 0])) >= 2


def test_round_trip(spark):
    """A reference sliced in three views and put together again scores well."""
    z, y, x = np.indices(SHAPE)
    lab = np.where((z - 4) ** 2 + (y - 3) ** 2 + (x - 3) ** 2 <= 9, 1, np.where((z - 5) ** 2 + (y - 8) ** 2 + (x - 10) ** 2 <= 9, 2, 0))
    p = Aggregation(binary=Binary(closing=0, remove_small=0, dilation=0), descent=Descent(n_iter=60), indirect=Indirect(method="edt"), probs=CombineProbs(prob_thresh=0.45), cluster=Cluster(thresh_factor=2))
    ref = table(spark, lab)
    out = pl.aggregate_indirect(fl.slices(ref), SHAPE, p)
    ap = {r["threshold"]: r["ap"] for r in mt.average_precision(ref, out.withColumn("label", out.label.cast("int")), (0.5,)).collect()}
    assert ap[0.5] == 1
    kept = pl.postprocess(ref, SHAPE, None, Postprocess(min_size=20))
    assert {r[0] for r in kept.select("label").distinct().collect()} == {1, 2}


def test_refinement(spark):
    lab = balls()
    g = k.gaussian((lab > 0).astype(float), 0.5)
    guide = table(spark, g / g.max(), "v", True)
    for df in (rf.diffuse_objects(table(spark, lab), guide, SHAPE, pad=3, iters=5), rf.guide_objects(table(spark, lab), guide, SHAPE, pad=3, radius=5, collision_close=0, collision_erode=0)):
        out = array(df)
        for v in (1, 2):
            assert ((out == v) & (lab == v)).sum() > 0.5 * (lab == v).sum()
