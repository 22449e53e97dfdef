"""Matching at ties, numbering by ranges, components across cubes, scratch tables and the entry module without its optional parts."""

import shutil
import subprocess
import sys
from pathlib import Path

import numpy as np
import pytest

from voxloom.operators import kernels as k
from voxloom.operators import labels as lb
from voxloom.operators import metrics as mt


def rows(spark, a, name="label"):
    return spark.createDataFrame([(*map(int, i), int(v)) for i, v in np.ndenumerate(a) if v], f"z int, y int, x int, {name} int")


def test_average_precision_ties(spark):
    """One label cut in halves, beside two labels merged into one: two pairs match at 0.5, not three."""
    ref, pred = np.zeros((1, 4, 20), int), np.zeros((1, 4, 20), int)
    ref[0, :, 0:4], pred[0, :, 0:2], pred[0, :, 2:4] = 1, 1, 2
    ref[0, :, 10:12], ref[0, :, 12:14], pred[0, :, 10:14] = 2, 3, 3
    got = {r.threshold: (r.tp, r.fp, r.fn) for r in mt.average_precision(rows(spark, ref), rows(spark, pred), (0.2, 0.5, 0.75)).collect()}
    assert got == {0.2: (2, 1, 1), 0.5: (2, 1, 1), 0.75: (0, 3, 3)}


def test_average_precision_curve(spark):
    a = np.zeros((1, 2, 8), int)
    a[0, :, :3], a[0, :, 4:7] = 1, 2
    r = rows(spark, a)
    ref = r.selectExpr("*", "'p' as image").union(r.selectExpr("*", "'q' as image")).union(r.selectExpr("*", "'none' as image"))
    pred = r.selectExpr("*", "'p' as image").union(r.where("label = 1").selectExpr("*", "'q' as image"))
    got = {x.threshold: (round(x.ap, 6), x.images) for x in mt.average_precision_curve(ref, pred, "image", (0.6, 0.9)).collect()}
    assert got == {0.6: (0.5, 3), 0.9: (0.5, 3)}


@pytest.mark.parametrize("connectivity,reach", [(6, 1), (18, 2), (26, 3)])
def test_components_across_cubes(spark, connectivity, reach):
    a = np.random.default_rng(connectivity).random((9, 10, 11)) < {6: 0.3, 18: 0.12, 26: 0.08}[connectivity]
    want = k.component_labels(a, reach)
    got = lb.components(rows(spark, a, "one").drop("one"), connectivity, tile=4).collect()
    assert {(r.z, r.y, r.x): r.comp for r in got} == {tuple(map(int, i)): int(want[tuple(i)]) for i in np.argwhere(a)}
    two = lb.components(rows(spark, a, "one").selectExpr("z", "y", "x", "'v' as vol").union(rows(spark, a, "one").selectExpr("z", "y", "x", "'w' as vol")), connectivity, by=("vol",), tile=4)
    assert all(r.comp == want[r.z, r.y, r.x] for r in two.collect())
    assert lb.components(rows(spark, a, "one").limit(0), connectivity).count() == 0


def test_ranked(spark):
    df = spark.createDataFrame([(i % 3, (i * 37) % 101) for i in range(101)], "g int, v int")
    assert {r.v: r.n for r in lb.ranked(df, ["v"], "n").collect()} == {v: v + 1 for v in range(101)}
    own = lb.ranked(df, ["v"], "n", ("g",)).collect()
    for g in range(3):
        part = sorted((r.v, r.n) for r in own if r.g == g)
        assert [n for _, n in part] == list(range(1, len(part) + 1))


def test_expand_and_truth(spark):
    mask = np.zeros((8, 8, 16), int)
    mask[1:5, 1:7, 1:7], mask[1:5, 1:7, 9:15] = 1, 1
    seeds = np.zeros_like(mask)
    seeds[2:4, 2, 2], seeds[2:4, 5, 5] = 3, 7
    got = {(r.z, r.y, r.x): r.label for r in lb.expand_labels(rows(spark, seeds), rows(spark, mask)).collect()}
    assert set(got) == {tuple(map(int, i)) for i in np.argwhere(mask) if i[2] < 8} and set(got.values()) == {3, 7}
    assert got[1, 1, 1] == 3 and got[1, 6, 6] == 7
    lab = mask.copy()
    lab[7, 0, 0] = 1
    out = lb.relabel_truth(rows(spark, lab), 10).collect()
    assert {r.label for r in out} == {1, 2} and len(out) == int(mask.sum())


def test_release(spark):
    from voxloom import scratch

    t = scratch.materialize(spark.range(3), "test")
    path = Path(t.inputFiles()[0].removeprefix("file:")).parent
    assert path.exists()
    scratch.release(spark)
    assert not path.exists()


@pytest.mark.parametrize("kind", ["gone", "empty", "cache", "pipeline"])
def test_entry_without_parts(tmp_path, kind):
    root = Path(__file__).resolve().parents[1]
    shutil.copytree(root / "voxloom", tmp_path / "voxloom", ignore=shutil.ignore_patterns("__pycache__", *([] if kind == "pipeline" else ["llm"])))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    if kind in ("empty", "cache"):
        (tmp_path / "voxloom" / "llm").mkdir()
    if kind == "cache":
        (tmp_path / "voxloom" / "llm" / "__pycache__").mkdir()
    if kind != "pipeline":
        shutil.copy(root / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()), any(k.startswith('op1_') for k in e.queries()))"
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, timeout=120)
    assert out.returncode == 0, out.stderr
    n, m, llm = out.stdout.split()
    assert int(n) > 60 and int(m) > 40 and llm == str(kind == "pipeline" and (root / "voxloom" / "llm").exists())
