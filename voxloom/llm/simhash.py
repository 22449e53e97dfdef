"""SimHash near-duplicates by anchor-point covering.

A fingerprint is cut into two halves of 31 bits (two bits are left out, which only
lowers distances). Of two fingerprints at distance 3 or less one half differs in at
most one bit. The codewords of the perfect Hamming code [31, 26] are the anchors:
covering radius 1, so each half is replicated to every anchor within 1 + 1 = 2 bits
(one anchor for a codeword, sixteen else), and two halves that differ in at most one
bit meet at an anchor. Whole fingerprints are compared per anchor, and a spanning
forest of the links found there is emitted, never all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, materialize, trimmed
from .components import connected_components

#: Fingerprints of one anchor that a task compares at once; beyond, the anchor is cut into a grid.
CELL = 4096


def fingerprint(text: bytes | None, width: int = 3) -> int:
    """Unsigned 64-bit SimHash of UTF-8 bytes; no words: 0."""
    import xxhash

    w = (text or b"").lower().split()  # bytes: A-Z and ASCII white space only
    if not w:
        return 0
    grams = map(b" ".join, zip(*(w[i:] for i in range(width)))) if len(w) >= width else [b" ".join(w)]
    n = max(1, len(w) - width + 1)
    h = np.fromiter((xxhash.xxh64_intdigest(g, 42) for g in grams), np.uint64, n)
    ones = np.zeros(64, np.int64)
    for i in range(0, n, 1 << 15):
        part = h[i : i + (1 << 15)].astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, width: int = 3) -> DataFrame:
    """(doc_id, h, fp): h is the text's hash, fp the signed form of the fingerprint."""
    bound_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            text = b.column(2).cast(pa.binary())
            fp = np.fromiter((fingerprint(x.as_py(), width) for x in text), np.uint64, len(text)).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(fp)], ["doc_id", "h", "fp"])

    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("h"), F.col("text").cast("string").alias("text"))
    return src.mapInArrow(lambda batches: trimmed(run(batches)), "doc_id long, h long, fp long")


def _anchor_masks() -> tuple[np.ndarray, np.ndarray]:
    """By syndrome: the bit flips that lead to an anchor within two bits, and how many."""
    masks, many = np.zeros((32, 16), np.int64), np.full(32, 16)
    many[0] = 1
    for s in range(1, 32):
        masks[s] = [1 << (s - 1), *((1 << (i - 1)) | (1 << ((i ^ s) - 1)) for i in range(1, 32) if i < i ^ s)]
    return masks, many


def anchors(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row of fp, anchor key) for each replica of unsigned 64-bit fingerprints."""
    masks, many = _anchor_masks()
    rows, keys = [], []
    for half in (0, 1):
        x = ((fp >> np.uint64(32 * half)) & np.uint64(0x7FFFFFFF)).astype(np.int64)
        syn = np.zeros(len(x), np.int64)
        for i in range(31):
            syn ^= ((x >> i) & 1) * (i + 1)
        r = np.repeat(np.arange(len(x)), many[syn])
        first = np.repeat(np.cumsum(many[syn]) - many[syn], many[syn])
        keys.append((x[r] ^ masks[syn[r], np.arange(len(r)) - first]) | (half << 32))
        rows.append(r)
    return np.concatenate(rows), np.concatenate(keys)


def _forest(fp: np.ndarray, bits: int) -> tuple[list, list]:
    """Spanning links among distinct fingerprints, breadth first."""
    left, us, vs = fp, [], []
    while len(left) > 1:
        todo, left = [left[0]], left[1:]
        while todo and len(left):
            x = todo.pop()
            near = np.bitwise_count(left ^ x) <= bits
            if near.any():
                new, left = left[near], left[~near]
                us.append(np.full(len(new), x))
                vs.append(new)
                todo.extend(new)
    return us, vs


def _compare(bits: int):
    def links(key: np.ndarray, cell: np.ndarray, fp: np.ndarray):
        edge = np.flatnonzero((np.diff(key) != 0) | (np.diff(cell) != 0)) + 1
        start, end = np.r_[0, edge], np.r_[edge, len(key)]
        size, us, vs = end - start, [], []
        for n in range(2, 9):  # groups of a few: all at once
            s = start[size == n]
            for i in range(n):
                for j in range(i + 1, n):
                    a, b = fp[s + i], fp[s + j]
                    near = (np.bitwise_count(a ^ b) <= bits) & (a != b)
                    us.append(a[near])
                    vs.append(b[near])
        for s, e in zip(start[size > 8], end[size > 8]):
            a, b = _forest(np.unique(fp[s:e]), bits)
            us += a
            vs += b
        u, v = (np.concatenate(x) if x else np.zeros(0, np.uint64) for x in (us, vs))
        if len(u):
            u, v = np.unique(np.stack([np.minimum(u, v), np.maximum(u, v)]), axis=1)
        return pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(v.view(np.int64))], ["u", "v"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)]
        for b in batches:
            new = [b.column(i).to_numpy() for i in range(3)]
            key, cell, fp = (np.concatenate([x, y]) for x, y in zip(held, [new[0], new[1], new[2].view(np.uint64)]))
            if not len(key):
                continue
            cut = np.flatnonzero((key != key[-1]) | (cell != cell[-1]))
            cut = cut[-1] + 1 if len(cut) else 0
            if cut:
                yield links(key[:cut], cell[:cut], fp[:cut])
            held = [key[cut:], cell[cut:], fp[cut:]]
        if len(held[0]):
            yield links(*held)

    return run


def fingerprint_links(distinct: DataFrame, bits: int = 3, cell: int = CELL) -> DataFrame:
    """Spanning (u, v) links among the distinct fingerprints in column ``fp``.

    An anchor with more than ``cell`` fingerprints is cut into chunks of half that
    size by hash, and each pair of chunks is compared in a group of its own.
    """
    if bits > 3:
        raise ValueError("two halves at radius one cover three differing bits at most")
    spark = distinct.sparkSession

    def replicate(batches):
        for b in batches:
            fp = b.column(0).to_numpy().view(np.uint64)
            r, k = anchors(fp)
            yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(fp[r].view(np.int64))], ["key", "fp"])

    def replicas():
        return distinct.select("fp").mapInArrow(replicate, "key long, fp long")

    hot = materialize(
        replicas().groupBy("key").count().where(F.col("count") > cell).select("key", F.ceil(F.col("count") * 2 / cell).alias("m")),
        "simhash-hot",
    )
    if hot.limit(1).count():
        # the join's side is chosen by Spark from the written table's size
        r = replicas().join(hot, "key", "left").withColumn("i", F.when(F.col("m").isNotNull(), F.pmod(F.xxhash64("fp"), F.col("m"))))
        pairs = F.when(
            F.col("m").isNotNull(),
            F.transform(F.sequence(F.lit(0).cast("long"), F.col("m") - 1), lambda j: F.least(j, F.col("i")) * F.col("m") + F.greatest(j, F.col("i"))),
        ).otherwise(F.array(F.lit(-1).cast("long")))
        cells = r.select("key", F.explode(pairs).alias("cell"), "fp")
    else:
        cells = replicas().select("key", F.lit(-1).cast("long").alias("cell"), "fp")
    return cells.repartition("key", "cell").sortWithinPartitions("key", "cell").mapInArrow(_compare(bits), "u long, v long")


def simhash_components(docs: DataFrame, bits: int = 3, width: int = 3) -> DataFrame:
    """(doc_id, h, fingerprint, component_id) per row of ``docs``.

    Fingerprints link at ``bits`` or fewer differing bits; component_id is the
    smallest doc_id reachable. Null or blank texts have fingerprint zero and link like
    any other. Rows without doc_id keep it null and never name a component (one made
    of such rows alone has a null component_id). Repeated rows stay repeated.
    """
    fps = materialize(fingerprints(docs, width), "simhash-fp")
    groups = materialize(fps.groupBy("fp").agg(F.min("doc_id").alias("rep")), "simhash-groups")
    links = materialize(fingerprint_links(groups, bits), "simhash-links")
    roots = connected_components(links).withColumnRenamed("node", "fp")
    rooted = groups.join(roots, "fp", "left").select("fp", "rep", F.coalesce("root", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("rep").alias("component_id"))
    named = rooted.join(least, "root").select("fp", "component_id", "root")
    return fps.join(named, "fp").select(
        "doc_id", "h", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "root"
    )


def keep_one(docs: DataFrame, bits: int = 3, width: int = 3) -> DataFrame:
    """``docs`` with one row of each component: that of the smallest doc_id.

    Rows without doc_id stand behind those with one; of rows that agree in doc_id
    and text one stays.
    """
    comp = simhash_components(docs, bits, width)
    best = comp.groupBy("root").agg(F.min(F.struct(F.isnull("doc_id").alias("a"), F.coalesce("doc_id", F.lit(0)).alias("b"), F.col("h").alias("c"))).alias("k"))
    keys = best.select(F.col("k.a").alias("_vl_a"), F.col("k.b").alias("_vl_b"), F.col("k.c").alias("_vl_c"))
    d = docs.withColumns({"_vl_a": F.isnull("doc_id"), "_vl_b": F.coalesce(F.col("doc_id").cast("long"), F.lit(0)), "_vl_c": F.xxhash64("text")})
    from pyspark.sql import Window

    w = Window.partitionBy("_vl_a", "_vl_b", "_vl_c").orderBy("_vl_b")
    cols = docs.columns
    return d.join(keys, ["_vl_a", "_vl_b", "_vl_c"]).withColumn("_vl_n", F.row_number().over(w)).where("_vl_n = 1").select(*cols)
