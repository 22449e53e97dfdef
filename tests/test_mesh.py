"""Surfaces and their properties."""

import struct

import numpy as np
import pytest

from voxloom.operators import mesh


def volume(spark, a):
    return spark.createDataFrame([(*map(int, i), float(v)) for i, v in np.ndenumerate(a) if v], "z int, y int, x int, v double")


def ball(n, r, c):
    z, y, x = np.indices((n, n, n))
    return np.clip(r + 0.5 - np.sqrt((z - c) ** 2 + (y - c) ** 2 + (x - c) ** 2), 0, 1)


def test_ball_and_ring(spark):
    row = mesh.mesh_properties(*mesh.surface(volume(spark, ball(21, 7, 10)), tile=8)).first()
    assert row.watertight and row.winding and row.euler == 2 and row.genus == 0
    assert abs(row.volume / (4 / 3 * np.pi * 7**3) - 1) < 0.03 and abs(row.area / (4 * np.pi * 49) - 1) < 0.05
    z, y, x = np.indices((9, 25, 25))
    d = np.sqrt((np.sqrt((y - 12) ** 2 + (x - 12) ** 2) - 7) ** 2 + (z - 4) ** 2)
    row = mesh.mesh_properties(*mesh.surface(volume(spark, np.clip(3 - d, 0, 1)), tile=6)).first()
    assert row.watertight and row.winding and row.genus == 1 and not row.convex


def test_one_voxel_and_border(spark):
    a = np.zeros((2, 2, 2))
    a[0, 0, 0] = 1
    v, f = mesh.surface(volume(spark, a))
    row = mesh.mesh_properties(v, f).first()
    assert row.watertight and row.winding and row.convex and row.euler == 2
    assert row.n_vertices == 14 and row.n_faces == 24  # a vertex on each edge that leaves the voxel
    none = mesh.mesh_properties(*mesh.surface(volume(spark, a).limit(0))).first()
    assert none.n_faces == 0 and not none.watertight and none.volume is None


def test_largest_part_and_mask(spark):
    a = np.zeros((12, 12, 24))
    a[3:8, 3:8, 3:8], a[4:6, 4:6, 16:18] = 1, 1
    parts = mesh.surface(volume(spark, a))
    row = mesh.mesh_properties(*mesh.largest_part(*parts)).first()
    assert mesh.mesh_properties(*parts).first().euler == 4 and row.euler == 2
    mask = volume(spark, a).drop("v")
    row = mesh.mesh_properties(*mesh.mesh_of_mask(mask, a.shape)).first()
    assert row.euler == 2 and 60 < row.volume < 130


def test_read_mesh(spark, tmp_path):
    box = [(0, 0, 0), (1, 0, 0), (1, 1, 0), (0, 1, 0), (0, 0, 1), (1, 0, 1), (1, 1, 1), (0, 1, 1)]
    quads = [(4, 3, 2, 1), (5, 6, 7, 8), (1, 2, 6, 5), (2, 3, 7, 6), (3, 4, 8, 7), (4, 1, 5, 8)]
    (tmp_path / "box.obj").write_text("# box\n" + "".join(f"v {x} {y} {z}\n" for x, y, z in box) + "".join("f " + " ".join(f"{i}/1" for i in q) + "\n" for q in quads))
    tri = [(q[0], q[k], q[k + 1]) for q in quads for k in (1, 2)]
    raw = bytes(80) + struct.pack("<I", len(tri)) + b"".join(struct.pack("<12fH", 0, 0, 0, *(c for i in t for c in box[i - 1]), 0) for t in tri)
    (tmp_path / "box.stl").write_bytes(raw)
    for name in ("box.obj", "box.stl"):
        v, f = mesh.read_mesh(spark, f"{tmp_path}/{name}")
        row = mesh.mesh_properties(v, f).first()
        assert (row.n_vertices, row.n_edges, row.n_faces, row.genus) == (8, 18, 12, 0) and row.convex and row.winding
        assert row.volume == pytest.approx(1) and row.area == pytest.approx(6)
