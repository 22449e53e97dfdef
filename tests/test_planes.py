"""Slices: a stand-in model, its diameter, and watersheds in the plane."""

import numpy as np

from voxloom.operators import kernels as k
from voxloom.operators import planes as pn


def dense(spark, a):
    return spark.createDataFrame([(*map(int, i), float(v)) for i, v in np.ndenumerate(a)], "z int, y int, x int, v double")


def made():
    def model(image, diameter):
        """Flows that vary most when the diameter is 20."""
        y, x = np.indices(image.shape)
        amp = np.exp(-(((diameter - 20) / 6) ** 2))
        return image / (image.max() + 1e-9), amp * np.stack([np.sin(y), np.cos(x)])

    return model


model = made()  # a closure, which goes to the workers by value


def test_model_and_diameter(spark):
    a = np.random.default_rng(1).random((3, 20, 24)) * np.array([0.2, 1.0, 0.5])[:, None, None]
    df = dense(spark, a)
    means = {r.z: r.score for r in pn.slice_contrast(df).collect()}
    assert all(abs(means[z] - a[z].mean()) < 1e-12 for z in range(3))
    edges = {r.z: r.score for r in pn.slice_contrast(df, True).collect()}
    assert max(edges, key=edges.get) == 1
    scores = pn.diameter_scores(df, model, [10, 15, 20, 25, 30], size=5, window=3)
    got = {r.diameter: r.score for r in scores.collect()}
    prob, flow = model(a[1], 15)
    var = np.mean([k.box_filter(f**2, 5) - k.box_filter(f, 5) ** 2 for f in flow], axis=0)
    assert abs(got[15] - (var * prob).mean()) < 1e-9
    assert pn.best_diameter(scores).first()[0] == 20
    assert [r[0] for r in pn.peak_diameters(scores).collect()] == [20]
    two = spark.createDataFrame([(float(i), v, v) for i, v in enumerate([0.0, 0.9, 0.8, 0.85, 0.1, 0.6, 0.0, 0.3])], "diameter double, score double, smoothed double")
    assert sorted(r[0] for r in pn.peak_diameters(two).collect()) == [1.0, 5.0, 7.0]
    out = pn.run_model(df, model, 20.0).where("z = 2").collect()
    prob, flow = model(a[2], 20.0)
    assert all(abs(r.prob - prob[r.y, r.x]) < 1e-12 and abs(r.d_row - flow[0][r.y, r.x]) < 1e-12 for r in out)
    turned = pn.run_model(df, lambda i, d: (i, np.zeros((2, *i.shape))), 1.0, invert=True).collect()
    assert all(abs(r.prob - (a.min() + a.max() - a[r.z, r.y, r.x])) < 1e-12 for r in turned)


def test_watershed_in_a_plane(spark):
    """Two discs with flow to their centres become two labels in each slice."""
    shape, centres = (24, 40), [(11, 10), (12, 28)]
    r, c = np.indices(shape)
    rows, flow = [], []
    for s in range(2):
        for y, x in centres[: 2 - s]:
            d = np.hypot(r - y, c - x)
            for i, j in np.argwhere(d <= 7).tolist():
                n = max(d[i, j], 1e-9)
                rows.append((s, i, j))
                flow.append((s, i, j, float((y - i) / n), float((x - j) / n)))
    mask = spark.createDataFrame(rows, "slice int, r int, c int")
    field = spark.createDataFrame(flow, "slice int, r int, c int, d_row double, d_col double")
    ends = pn.advect_planes(mask, field, shape, n_iter=30)
    out = pn.cluster_planes(ends, shape).collect()
    assert {(o.slice, o.label) for o in out} == {(0, 1), (0, 2), (1, 1)} and len(out) == len(rows)
    left = {o.label for o in out if o.slice == 0 and o.c < 20}
    assert len(left) == 1
    assert pn.cluster_planes(ends, shape, min_area=10_000).count() == 0
    steps = pn.advect_planes(mask, field, shape, n_iter=3, interp=False, tracks=True)
    assert steps.groupBy("step").count().count() == 4 and steps.where("step = 0 and (er <> r or ec <> c)").count() == 0
    still = pn.advect_planes(mask, field.limit(0), shape).where("er <> r or ec <> c")
    assert still.count() == 0
