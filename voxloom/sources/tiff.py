"""TIFF volumes: decoded from files that Spark reads, and label slices written as TIFF.

A file is one record of Spark's ``binaryFile`` reader, so any store that Spark reaches serves, path
globs make a series, and one file has 2 GB at most. Pages are decoded one at a time.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.fields import natural_order, palette

# Fixed values of the format: field type, its struct code and bytes.
_TYPES = {1: ("B", 1), 2: ("c", 1), 3: ("H", 2), 4: ("I", 4), 5: ("II", 8), 6: ("b", 1), 7: ("B", 1), 8: ("h", 2), 9: ("i", 4), 11: ("f", 4), 12: ("d", 8), 13: ("I", 4), 16: ("Q", 8), 17: ("q", 8), 18: ("Q", 8)}
# Fixed values of the format: tags that are read.
WIDTH, HEIGHT, BITS, COMPRESSION, STRIPS, SAMPLES, ROWS, COUNTS, PLANAR, PREDICTOR, TILE_W, TILE_H, TILES, TILE_COUNTS, FORMAT = (
    256, 257, 258, 259, 273, 277, 278, 279, 284, 317, 322, 323, 324, 325, 339,
)


def _unpack_bits(data: bytes) -> bytes:
    out, i = bytearray(), 0
    while i < len(data):
        n = data[i]
        if n < 128:
            out += data[i + 1 : i + 2 + n]
            i += n + 2
        else:
            out += data[i + 1 : i + 2] * (257 - n) if n > 128 else b""
            i += 2 if n > 128 else 1
    return bytes(out)


def _unpack_lzw(data: bytes) -> bytes:
    """Codes of 9 to 12 bits, high bit first; 256 clears the table, 257 ends; the width grows one code early."""
    first = [bytes([i]) for i in range(256)] + [b"", b""]
    table, last, out = list(first), b"", bytearray()
    bits, held, width = 0, 0, 9
    for byte in data:
        held, bits = (held << 8 | byte) & 0xFFFFFF, bits + 8
        if bits < width:
            continue
        bits -= width
        code = held >> bits & (1 << width) - 1
        if code == 257:
            break
        if code == 256:
            table, last, width = list(first), b"", 9
            continue
        own = table[code] if code < len(table) else last + last[:1]
        if last:
            table.append(last + own[:1])
        out += own
        last = own
        width = max(9, min(12, (len(table) + 1).bit_length())) if last else 9
    return bytes(out)


def _decoded(data: bytes, kind: int) -> bytes:
    if kind == 1:
        return data
    if kind in (8, 32946):
        return zlib.decompress(data)
    if kind == 32773:
        return _unpack_bits(data)
    if kind == 5:
        return _unpack_lzw(data)
    raise ValueError(f"TIFF compression {kind} is not supported")


def pages(raw: bytes) -> Iterator[np.ndarray]:
    """The pages of a TIFF or BigTIFF file as (y, x, sample) arrays."""
    if raw[:2] not in (b"II", b"MM"):
        raise ValueError("no TIFF file")
    e = "<" if raw[:2] == b"II" else ">"
    big = struct.unpack_from(e + "H", raw, 2)[0] == 43
    at = struct.unpack_from(e + ("Q" if big else "I"), raw, 8 if big else 4)[0]
    head, entry, room = ("Q", 20, 8) if big else ("H", 12, 4)
    seen = set()
    while at and at not in seen:
        seen.add(at)
        n = struct.unpack_from(e + head, raw, at)[0]
        tags = {}
        for k in range(n):
            p = at + struct.calcsize(head) + k * entry
            tag, kind = struct.unpack_from(e + "HH", raw, p)
            count = struct.unpack_from(e + ("Q" if big else "I"), raw, p + 4)[0]
            if kind not in _TYPES:
                continue
            code, size = _TYPES[kind]
            where = p + entry - room
            if count * size > room:
                where = struct.unpack_from(e + ("Q" if big else "I"), raw, where)[0]
            tags[tag] = struct.unpack_from(e + code * count, raw, where) if kind != 2 else ()
        yield _page(raw, e, tags)
        at = struct.unpack_from(e + ("Q" if big else "I"), raw, at + struct.calcsize(head) + n * entry)[0]


def _page(raw: bytes, e: str, t: dict) -> np.ndarray:
    w, h, s = t[WIDTH][0], t[HEIGHT][0], t.get(SAMPLES, (1,))[0]
    bits, form = t.get(BITS, (1,))[0], t.get(FORMAT, (1,))[0]
    if bits not in (8, 16, 32, 64):
        raise ValueError(f"{bits} bits a sample are not supported")
    kind = np.dtype(e + {1: "u", 2: "i", 3: "f"}[form] + str(bits // 8))
    apart = t.get(PLANAR, (1,))[0] == 2 and s > 1
    tiled = TILES in t
    bw, bh = (t[TILE_W][0], t[TILE_H][0]) if tiled else (w, min(h, t.get(ROWS, (h,))[0]))
    starts, counts = (t[TILES], t[TILE_COUNTS]) if tiled else (t[STRIPS], t[COUNTS])
    across, down, per = -(-w // bw), -(-h // bh), 1 if apart else s
    out = np.zeros((h, w, s), kind.newbyteorder("="))
    for k, (a, n) in enumerate(zip(starts, counts)):
        plane, rest = divmod(k, across * down)
        row, col = divmod(rest, across)
        rows = bh if tiled else min(bh, h - row * bh)
        block = np.frombuffer(_decoded(raw[a : a + n], t.get(COMPRESSION, (1,))[0]), kind, rows * bw * per).reshape(rows, bw, per)
        if t.get(PREDICTOR, (1,))[0] == 2:
            block = np.cumsum(block, axis=1, dtype=kind.newbyteorder("="))
        y, x = row * bh, col * bw
        part = block[: h - y, : w - x]
        out[y : y + part.shape[0], x : x + part.shape[1], plane : plane + per] = part
    return out


def read_tiff(spark: SparkSession, path: str, low: tuple = (0, 0, 0), high: tuple | None = None) -> DataFrame:
    """(file, z, y, x, c, v) of the TIFF files at a path, folder or glob; z is the page, c the sample.

    ``low`` and ``high`` (z, y, x, half-open) crop while decoding. A file that is no TIFF is an
    error. Values become doubles.
    """
    files = spark.read.format("binaryFile").load(path).select(F.col("path").alias("file"), "content")
    names = ["file", "z", "y", "x", "c", "v"]

    def run(batches):
        for b in batches:
            for i in range(b.num_rows):
                file = b.column(0)[i].as_py()
                for z, p in enumerate(pages(b.column(1)[i].as_py())):
                    if z < low[0] or high is not None and z >= high[0]:
                        continue
                    own = p[low[1] :, low[2] :] if high is None else p[low[1] : high[1], low[2] : high[2]]
                    rows = max(1, (1 << 20) // max(1, own.shape[1] * own.shape[2]))
                    for r in range(0, own.shape[0], rows):
                        v = own[r : r + rows]
                        y, x, c = (k.ravel().astype(np.int32) for k in np.indices(v.shape))
                        yield pa.RecordBatch.from_arrays([pa.array([file] * v.size), pa.array(np.full(v.size, z, np.int32)), pa.array(y + r + low[1]), pa.array(x + low[2]), pa.array(c), pa.array(v.ravel().astype(float))], names)

    return files.mapInArrow(run, "file string, z int, y int, x int, c int, v double")


def stacked(planes: DataFrame) -> DataFrame:
    """A series of one-page files as one volume (z, y, x, c, v): z is the file's place by name, file2 before file10."""
    order = planes.select("file").distinct().collect()  # a row for each file of a series
    spark = planes.sparkSession
    names = spark.createDataFrame([(r.file,) for r in order], "file string")
    from pyspark.sql import Window

    at = names.withColumn("_z", F.row_number().over(Window.orderBy(*natural_order(F.col("file")))) - 1)
    return planes.join(F.broadcast(at), "file").select(F.col("_z").alias("z"), "y", "x", "c", "v")


def encode(page: np.ndarray) -> bytes:
    """One page (y, x) or (y, x, sample) as a deflated little-endian TIFF file of one strip."""
    a = page if page.ndim == 3 else page[:, :, None]
    h, w, s = a.shape
    data = zlib.compress(np.ascontiguousarray(a).astype(a.dtype.newbyteorder("<")).tobytes())
    form = {"u": 1, "i": 2, "f": 3}[a.dtype.kind]
    bits = a.dtype.itemsize * 8
    entries = [(WIDTH, 4, [w]), (HEIGHT, 4, [h]), (BITS, 3, [bits] * s), (COMPRESSION, 3, [8]), (262, 3, [2 if s == 3 else 1]), (STRIPS, 4, [0]), (SAMPLES, 3, [s]), (ROWS, 4, [h]), (COUNTS, 4, [len(data)]), (PLANAR, 3, [1]), (FORMAT, 3, [form] * s)]
    table, extra = 8 + 2 + 12 * len(entries) + 4, b""
    out = b""
    for tag, kind, values in entries:
        code, size = _TYPES[kind]
        if tag == STRIPS:
            values = [table + sum(_TYPES[k][1] * len(v) for _, k, v in entries if _TYPES[k][1] * len(v) > 4)]
        packed = struct.pack("<" + code * len(values), *values)
        if len(packed) > 4:
            packed, extra = struct.pack("<I", table + len(extra)), extra + packed
        out += struct.pack("<HHI", tag, kind, len(values)) + packed.ljust(4, b"\0")
    return b"II*\0" + struct.pack("<IH", 8, len(entries)) + out + b"\0\0\0\0" + extra + data


def store(path: str):
    """(file system, path inside it) by pyarrow: file, hdfs, s3 and gs URIs, or plain paths."""
    from pyarrow import fs

    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path[5:].lstrip("/")
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def write_labels(labels: DataFrame, path: str, shape: tuple[int, int, int], colours: int = 16) -> DataFrame:
    """Write label slices as ``labels_00000.tif`` … and their colours as ``colours_00000.tif`` … in a folder that all executors reach.

    Labels are 16 bits wide if all are below 65536, else 32. Returns (z, file, n), a row for each
    slice with labels; slices without any get no file. A task that is repeated writes its
    files again, each moved into place whole.
    """
    top = labels.agg(F.max("label")).first()[0]
    kind = np.uint16 if (top or 0) < 1 << 16 else np.uint32
    rows = palette(labels.select("z", "y", "x", "label"), "label", colours)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        fs, root = store(path)
        fs.create_dir(root, recursive=True)
        z = int(pdf["z"].iloc[0])
        ids, rgb = np.zeros(shape[1:], kind), np.zeros((*shape[1:], 3), np.uint8)
        ids[pdf["y"], pdf["x"]] = pdf["label"]
        rgb[pdf["y"], pdf["x"]] = pdf[["red", "green", "blue"]]
        for name, a in (("colours", rgb), ("labels", ids)):
            part, to = f"{root}/_{uuid.uuid4().hex}", f"{root}/{name}_{z:05d}.tif"
            with fs.open_output_stream(part) as f:
                f.write(encode(a))
            fs.move(part, to)
        return pd.DataFrame({"z": [z], "file": [f"{path.rstrip('/')}/labels_{z:05d}.tif"], "n": [len(pdf)]})

    done = rows.groupBy("z").applyInPandas(run, "z int, file string, n long")
    return labels.sparkSession.createDataFrame(done.collect(), "z int, file string, n long")  # a row for each slice
