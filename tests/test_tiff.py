"""TIFF files: round trips of the encoder, hand-made files of each layout, and the label sink."""

import struct
import zlib

import numpy as np
import pytest

from voxloom.sources import tiff


@pytest.mark.parametrize("kind", ["u1", "u2", "u4", "i2", "f4", "f8"])
def test_round_trip(kind):
    a = (np.random.default_rng(1).random((7, 11)) * 200).astype(kind)
    (got,) = tiff.pages(tiff.encode(a))
    assert got.dtype == a.dtype and (got[:, :, 0] == a).all()
    rgb = np.random.default_rng(2).integers(0, 255, (5, 4, 3)).astype("u1")
    assert (next(tiff.pages(tiff.encode(rgb))) == rgb).all()


def made(blocks, tags, e="<", big=False):
    """A file of one page from its blocks and tags (tag, type, values); offsets are filled in."""
    head = (b"II" if e == "<" else b"MM") + struct.pack(e + "HHH", 43, 8, 0) if big else (b"II" if e == "<" else b"MM") + struct.pack(e + "H", 42)
    body, at, starts = b"", 16 if big else 8, []
    for b in blocks:
        starts.append(at + len(body))
        body += b
    word, room = ("Q", 8) if big else ("I", 4)
    extra_at, entries, extra = at + len(body), b"", b""
    for tag, kind, values in sorted([*tags, (tags_at(tags), 4, starts), (tags_at(tags) + (1 if tags_at(tags) == 324 else 6), 4, [len(b) for b in blocks])]):
        raw = struct.pack(e + tiff._TYPES[kind][0] * len(values), *values)
        if len(raw) > room:
            raw, extra = struct.pack(e + word, extra_at + len(extra)), extra + raw
        entries += struct.pack(e + "HH" + word, tag, kind, len(values)) + raw.ljust(room, b"\0")
    n = len(tags) + 2
    ifd = extra_at + len(extra)
    return head + struct.pack(e + word, ifd) + body + extra + struct.pack(e + ("Q" if big else "H"), n) + entries + struct.pack(e + word, 0)


def tags_at(tags):
    return 324 if any(t[0] == 322 for t in tags) else 273


def lzw(data):
    table, out, w, width = {bytes([i]): i for i in range(256)}, [(256, 9)], b"", 9
    n = 258
    for c in data:
        k = w + bytes([c])
        if k in table:
            w = k
            continue
        out.append((table[w], width))
        table[k] = n
        n += 1
        width = max(9, min(12, n.bit_length()))
        w = bytes([c])
        if n >= 4094:
            out.append((table[w], width))
            out.append((256, width))
            table, n, width, w = {bytes([i]): i for i in range(256)}, 258, 9, b""
    if w:
        out.append((table[w], width))
        n += 1
        width = max(9, min(12, n.bit_length()))
    out.append((257, width))
    bits = "".join(format(c, f"0{k}b") for c, k in out)
    return int(bits.ljust(-(-len(bits) // 8) * 8, "0"), 2).to_bytes(-(-len(bits) // 8), "big")


def test_layouts():
    a = np.random.default_rng(3).integers(0, 60000, (6, 10)).astype("u2")
    base = [(256, 3, [10]), (257, 3, [6]), (258, 3, [16]), (277, 3, [1])]
    for e in "<>":
        for big in (False, True):
            rows = [a[i : i + 4].astype(e + "u2").tobytes() for i in (0, 4)]
            got = next(tiff.pages(made(rows, [*base, (259, 3, [1]), (278, 3, [4])], e, big)))
            assert (got[:, :, 0] == a).all()
    tiles = []
    for y in (0, 4):
        for x in (0, 8):
            t = np.zeros((4, 8), "<u2")
            part = a[y : y + 4, x : x + 8]
            t[: part.shape[0], : part.shape[1]] = part
            tiles.append(zlib.compress(np.diff(t, axis=1, prepend=np.zeros((4, 1), "<u2")).astype("<u2").tobytes()))
    got = next(tiff.pages(made(tiles, [*base, (259, 3, [8]), (317, 3, [2]), (322, 3, [8]), (323, 3, [4])])))
    assert (got[:, :, 0] == a).all()
    b = np.repeat(np.arange(30, dtype="u1"), 400).reshape(60, 200)
    base = [(256, 3, [200]), (257, 3, [60]), (258, 3, [8]), (277, 3, [1]), (278, 3, [60])]
    assert (next(tiff.pages(made([lzw(b.tobytes())], [*base, (259, 3, [5])])))[:, :, 0] == b).all()
    noise = np.random.default_rng(4).integers(0, 255, (60, 200)).astype("u1")
    assert (next(tiff.pages(made([lzw(noise.tobytes())], [*base, (259, 3, [5])])))[:, :, 0] == noise).all()
    packed = b"".join(bytes([257 - 100, v, 257 - 100, v]) for row in b for v in row[::200]) if (b[:, :1] == b).all() else b""
    if packed:
        assert (next(tiff.pages(made([packed], [*base, (259, 3, [32773])])))[:, :, 0] == b).all()
    with pytest.raises(ValueError):
        next(tiff.pages(b"no tiff at all"))
    with pytest.raises(ValueError):
        next(tiff.pages(made([b"x"], [*base, (259, 3, [7])])))


def test_read_and_write(spark, tmp_path):
    a = np.random.default_rng(5).integers(0, 255, (12, 5, 6)).astype("u1")
    for z, p in enumerate(a):
        (tmp_path / f"s{z}.tif").write_bytes(tiff.encode(p))
    got = tiff.stacked(tiff.read_tiff(spark, f"{tmp_path}/*.tif")).collect()
    assert {(r.z, r.y, r.x): r.v for r in got} == {(*i, 0)[:3]: float(v) for i, v in np.ndenumerate(a)}
    crop = tiff.read_tiff(spark, f"{tmp_path}/s3.tif", (0, 1, 2), (1, 4, 5)).collect()
    assert {(r.y, r.x): r.v for r in crop} == {(y, x): float(a[3, y, x]) for y in range(1, 4) for x in range(2, 5)}
    for top, kind in ((9, "uint16"), (70_000, "uint32")):
        lab = spark.createDataFrame([(0, 1, 2, 1), (0, 4, 5, top), (2, 0, 0, 3)], "z int, y int, x int, label int")
        out = tiff.write_labels(lab, f"{tmp_path}/out{top}", (3, 5, 6)).collect()
        assert sorted((r.z, r.n) for r in out) == [(0, 2), (2, 1)]
        page = next(tiff.pages((tmp_path / f"out{top}" / "labels_00000.tif").read_bytes()))[:, :, 0]
        assert page.dtype == kind and page[4, 5] == top and page[1, 2] == 1 and (page > 0).sum() == 2
        rgb = next(tiff.pages((tmp_path / f"out{top}" / "colours_00000.tif").read_bytes()))
        assert rgb.shape == (5, 6, 3) and (rgb.max(axis=2) > 0).sum() == 2
    assert tiff.write_labels(lab.limit(0), f"{tmp_path}/none", (3, 5, 6)).count() == 0
