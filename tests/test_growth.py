"""What a task or the driver holds must not grow with the suppliers; tiles give what whole volumes give."""

import re

import numpy as np
import pytest

from tests.test_volumes import SHAPE, balls, rows2, table
from voxloom import field_queries, more_queries  # noqa: F401  register their own
from voxloom.operators import kernels as k
from voxloom.operators import labels as lb
from voxloom.operators import planes as pn
from voxloom.operators import slices as sl
from voxloom.operators import stencils as st
from voxloom.plans import fixtures as fx
from voxloom.queries import QUERIES

LAZY = """adjust_contrast frame_statistics gaussian histogram_256 intensity_filter intensity_filter_otsu jaccard_at_half median_filter otsu persistent_slices
anisotropic_diffusion background_correct boundary_voxels difference_of_means combine_by_variance rosin_threshold slice_contrast stable_slices
remove_small_labels label_colours shape_covariance size_statistics_filter region_props relabel_slices remove_eccentric_shapes label_overlap flow_errors remove_bad_flows dilate_ball""".split()


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", LAZY)
def test_no_voxels_sent_round(spark, sf_dir, name):
    assert "BroadcastHashJoin" not in plan(QUERIES[name](spark, sf_dir))


def test_balls_are_dealt(spark, tmp_path):
    spark.range(2500).selectExpr("id as s_suppkey", "cast(id % 25 as int) as s_nationkey").coalesce(1).write.parquet(f"{tmp_path}/supplier.parquet")
    assert re.search(r"hashpartitioning\(id#\d+, 3\), REPARTITION_BY_NUM", plan(fx.ref(spark, str(tmp_path))))
    d = fx.volume(spark, str(tmp_path)).selectExpr("count(*) n", "count(distinct z, y, x) d", "max(x) x", "count_if(v >= 40) own").first()
    assert (d.n, d.d, d.x) == (32 * 64 * 1600, 32 * 64 * 1600, 1599) and d.own == fx.ref(spark, str(tmp_path)).count()


def test_unique_slices(spark):
    lab = balls()
    df = sl.unique_slices(rows2(spark, lab))
    assert "windowspecdefinition(0," not in plan(df)
    want = {p: i + 1 for i, p in enumerate(sorted({(s, lab[s, r, c]) for s, r, c in np.argwhere(lab > 0)}))}
    assert {tuple(r[:3]): r[3] for r in df.collect()} == {(s, r, c): want[s, lab[s, r, c]] for s, r, c in np.argwhere(lab > 0)}


def test_tiles(spark):
    a = np.random.default_rng(5).random(SHAPE)
    got = st.by_tiles(table(spark, a, "v", True), lambda v: k.perona_malik(v, 3, step=(1.0, 1.0, 1.0)), 2, tile=4)
    assert {tuple(r[:3]): r[3] for r in got.collect()} == {tuple(c): v for c, v in np.ndenumerate(k.perona_malik(a, 3, step=(1.0, 1.0, 1.0)))}


def test_slices_are_cut(spark):
    a = np.random.default_rng(6).random((2, 20, 1100))
    rows = spark.createDataFrame([(*map(int, c), float(v)) for c, v in np.ndenumerate(a)], "z int, y int, x int, v double")
    df = sl.anisotropic_diffusion(rows, 3)
    assert "_tx" in plan(df)
    got = {tuple(r[:3]): r[3] for r in df.collect()}
    assert got == {(z, *c): v for z in (0, 1) for c, v in np.ndenumerate(k.perona_malik(a[z], 3))}
    assert "InPandas" not in plan(pn.slice_contrast(rows))
    for r in pn.slice_contrast(rows).collect():
        assert r.score == pytest.approx(a[r.z].mean())
    p = np.pad(a, ((0, 0), (1, 1), (1, 1)), mode="symmetric")
    dy = (p[:, 2:] - p[:, :-2]) / 2
    dx = (p[:, :, 2:] - p[:, :, :-2]) / 2
    across = (dy[:, :, :-2] + 2 * dy[:, :, 1:-1] + dy[:, :, 2:]) / 4, (dx[:, :-2] + 2 * dx[:, 1:-1] + dx[:, 2:]) / 4
    for r in pn.slice_contrast(rows, True).collect():
        assert r.score == pytest.approx(np.sqrt((across[0][r.z] ** 2 + across[1][r.z] ** 2) / 2).mean())


@pytest.mark.parametrize("radius", [0, 1, 2, 5])
def test_dilation_moves_runs(spark, radius):
    m = np.random.default_rng(radius).random(SHAPE) < 0.03
    m[0, 0, 0] = m[9, 11, 13] = m[4, 4, 2:9] = True
    t = table(spark, m.astype(int)).select("z", "y", "x")
    df = lb.dilate_ball(t.union(t), radius, SHAPE)
    assert not re.search(r"hashpartitioning\(z#\d+, y#\d+, x#", plan(df))  # no row of a voxel for each place of the ball
    want = {(z + i, y + j, x + l) for z, y, x in np.argwhere(m) for i, j, l in lb.ball(radius)}
    got = [tuple(r) for r in df.select("z", "y", "x").collect()]
    assert len(got) == len(set(got)) and set(got) == {c for c in want if all(0 <= p < n for p, n in zip(c, SHAPE))}


def test_distance_is_bounded():
    """A line of 20,000 cells would need a table of 3.2 GB of all pairs."""
    import resource

    lab = np.zeros((3, 20000), np.int64)
    lab[:, 5:17] = 1
    lab[1:, 17:60] = 2
    lab[2] = 3
    soft, hard = resource.getrlimit(resource.RLIMIT_AS)
    with open("/proc/self/statm") as f:
        now = int(f.read().split()[0]) * resource.getpagesize()
    resource.setrlimit(resource.RLIMIT_AS, (now + (1 << 30), hard))
    try:
        d = k.label_distance(lab)
    finally:
        resource.setrlimit(resource.RLIMIT_AS, (soft, hard))
    assert np.array_equal(d[:, :300], k.label_distance(lab[:, :300]))
    assert d[0, 5:11].tolist() == [1, 2, 2, 2, 2, 2] and d[1, 30] == 1 and (d[2] == 1).all()


@pytest.mark.parametrize("seed", range(4))
def test_distance_brute(seed):
    rng = np.random.default_rng(seed)
    lab = np.kron(rng.integers(seed % 2, 3, (3, 2, 4)), np.ones((2, 3, 2), int))[:, :, : 3 + seed]
    lab[seed] = 1
    want = np.zeros(lab.shape)
    for p in np.argwhere(lab > 0):
        other = np.argwhere(lab != lab[tuple(p)])
        want[tuple(p)] = np.sqrt(((other - p) ** 2).sum(axis=1).min())
    assert np.array_equal(k.label_distance(lab), want)


@pytest.mark.parametrize("factor", [None, 0.5, -0.1, -3.0])
def test_planes_are_cut(spark, monkeypatch, factor):
    from voxloom.operators import flows as fl

    shape = (2, 40, 70)
    z, y, x = np.indices(shape)
    lab = np.zeros(shape, np.int64)
    for i, (cy, cx) in enumerate([(5, 5), (8, 30), (20, 12), (30, 40), (20, 60), (34, 66)]):
        lab[(y - cy) ** 2 + (x - cx) ** 2 <= 16 + 5 * i] = i + 1
    lab[1] = lab[1, ::-1]
    rows = rows2(spark, lab)

    def result():
        flow = fl.slice_flows(rows.selectExpr("'xy' as view", "*"), shape, "edt")
        ends = pn.advect_planes(rows.select("slice", "r", "c"), flow, shape[1:], n_iter=12)
        return sorted(map(tuple, flow.collect())), sorted(map(tuple, ends.collect())), sorted(map(tuple, pn.cluster_planes(ends, shape[1:], factor=factor).collect()))

    whole = result()
    for m in (fl, pn):
        monkeypatch.setattr(m, "PIECE", 16)
    cut = result()
    assert "_tc" in plan(fl.slice_flows(rows.selectExpr("'xy' as view", "*"), shape, "edt"))
    assert cut == whole
    # and as one array
    for s in (0, 1):
        votes = np.zeros(shape[1:])
        at = {(r, c): (int(er), int(ec)) for z, r, c, er, ec in whole[1] if z == s}
        for p in at.values():
            votes[p] = 1
        votes = k.gaussian(votes, 1.0)
        c = k.component_labels(votes > votes.mean() + (factor or 0.0) * votes.std(), 1)
        keep = [i for i in range(1, c.max() + 1) if (c == i).sum() > 1]
        want = {(r, q): keep.index(c[p]) + 1 for (r, q), p in at.items() if c[p] in keep}
        assert {(r, q): l for z, r, q, l in whole[2] if z == s} == want
