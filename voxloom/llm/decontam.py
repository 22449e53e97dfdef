"""Benchmark decontamination by a prefix-filtered set join.

An item's windows are sets of positioned word shingles. Shingles are ordered by their
frequency in the documents; as a window has to be contained whole, its prefix is one
shingle, the rarest. Documents send only shingles that a fixed-size bitmap says may be
a prefix, with the words around them; the join on the shingle applies the positional
and length bounds and then compares the words themselves.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bound_batches, materialize, trimmed
from .words import shingles, words

#: Bits of the bitmap of shingles, whatever the benchmark's size: 2 MB to each executor.
BITS = 1 << 24
SHINGLE = 3
_I64 = np.int64


def item_windows(benchmark: DataFrame, size: int = 10) -> DataFrame:
    """(item_id, win, n, sh, off): each item's windows, once per shingle of theirs."""

    def run(batches):
        for b in batches:
            rows = [[], [], [], [], []]
            for item, text in zip(b.column(0), b.column(1)):
                low = (text.as_py() or "").encode().lower()
                s, e, h = words(low)
                n = min(size, len(s))
                seen = set()
                for i in range(len(s) - n + 1 if n else 0):
                    win = " ".join(low[x:y].decode() for x, y in zip(s[i : i + n], e[i : i + n]))
                    if win in seen:
                        continue
                    seen.add(win)
                    for off, sh in enumerate(shingles(h[i : i + n], min(SHINGLE, n)).view(_I64).tolist()):
                        for col, v in zip(rows, (item.as_py(), win, n, sh, off)):
                            col.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(rows[0], pa.string()), pa.array(rows[1], pa.string()), pa.array(rows[2], pa.int32()), pa.array(rows[3], pa.int64()), pa.array(rows[4], pa.int32())], ["item_id", "win", "n", "sh", "off"])

    src = benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text"))
    return src.mapInArrow(run, "item_id string, win string, n int, sh long, off int")


def _bitmap(df: DataFrame) -> np.ndarray:
    """Bits of column ``sh``; at most BITS / 64 rows come to the driver."""
    pos = F.pmod(F.col("sh"), F.lit(BITS))
    got = df.select((pos / 64).cast("int").alias("w"), F.expr(f"shiftleft(1L, cast(pmod(sh, {BITS}) % 64 as int))").alias("b")).groupBy("w").agg(F.bit_or("b").alias("b")).toArrow()
    out = np.zeros(BITS // 64, np.uint64)
    out[got["w"].to_numpy()] = got["b"].to_numpy().view(np.uint64)
    return out


def _in(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    pos = h & np.uint64(BITS - 1)
    return (bits[(pos >> np.uint64(6)).astype(_I64)] >> (pos & np.uint64(63))) & np.uint64(1) == 1


def find_hits(docs: DataFrame, benchmark: DataFrame, size: int = 10) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(documents, hits, items).

    documents: doc_id, the row's key d, z, h, and n_words, one row per row of ``docs``.
    hits: d, z, h, start, n, win, distinct. items: item_id, win.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    wins = materialize(item_windows(benchmark, size), "decontam-windows")
    widths = [r[0] for r in wins.select(F.least("n", F.lit(SHINGLE)).alias("k")).distinct().collect()]  # three values at most
    text = docs.select(F.col("text").cast("string").alias("text"))
    all_bits = spark.sparkContext.broadcast(_bitmap(wins.select("sh").distinct()))

    def count(batches):
        for b in batches:
            found = [np.zeros(0, np.uint64)]
            for x in b.column(0).cast(pa.binary()):
                h = words((x.as_py() or b"").lower())[2]
                for k in widths:
                    sh = shingles(h, k)
                    found.append(sh[_in(all_bits.value, sh)])
            sh, n = np.unique(np.concatenate(found), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(sh.view(_I64)), pa.array(n.astype(_I64))], ["sh", "c"])

    freq = text.mapInArrow(lambda batches: trimmed(count(batches)), "sh long, c long").groupBy("sh").agg(F.sum("c").alias("c"))
    rare = wins.select("win", "n", "sh", "off").distinct().join(freq, "sh", "left")
    prefix = materialize(
        rare.groupBy("win", "n").agg(F.min(F.struct(F.coalesce("c", F.lit(0)).alias("c"), "off", "sh")).alias("p")).where("p.c > 0").select("win", "n", "p.off", "p.sh"),
        "decontam-prefix",
    )
    bits = spark.sparkContext.broadcast(_bitmap(prefix.select("sh")))

    def probe(batches):
        for b in batches:
            rows = [[] for _ in range(9)]
            for i, x in enumerate(b.column(4).cast(pa.binary())):
                low = (x.as_py() or b"").lower()
                s, e, h = words(low)
                own = [b.column(j)[i].as_py() for j in range(4)]
                new = [(None, 0, 0, None)]
                for k in widths:
                    sh = shingles(h, k)
                    for p in np.flatnonzero(_in(bits.value, sh)).tolist():
                        a, z = max(0, p - size + k), min(len(s), p + size)
                        new.append((int(sh[p].view(_I64)), p, a, [low[u:v].decode() for u, v in zip(s[a:z], e[a:z])]))
                for sh, p, a, ctx in new:
                    for col, v in zip(rows, (*own, len(s), sh, p, a, ctx)):
                        col.append(v)
            kinds = [pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.string())]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, kinds)], ["doc_id", "d", "z", "h", "n_words", "sh", "pos", "first", "ctx"])

    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("d"), F.isnull("doc_id").alias("z"), F.xxhash64("text").alias("h"), F.col("text").cast("string").alias("text"))
    found = materialize(src.mapInArrow(lambda batches: trimmed(probe(batches)), "doc_id long, d long, z boolean, h long, n_words long, sh long, pos long, first long, ctx array<string>"), "decontam-found")
    cand = found.where("sh is not null").drop("doc_id")
    at = F.col("pos") - F.col("off")
    hits = (
        cand.join(prefix, "sh")
        .withColumn("start", at)
        .where("start >= 0 and start + n <= n_words and start >= first and array_join(slice(ctx, cast(start - first + 1 as int), n), ' ') = win")
        .select("d", "z", "h", "start", "n", "win")
        .distinct()
    )
    return found.where("sh is null").select("doc_id", "d", "z", "h", "n_words"), materialize(hits, "decontam-hits"), wins.select("item_id", "win").where("item_id is not null").distinct()


def contamination(docs: DataFrame, benchmark: DataFrame, size: int = 10) -> DataFrame:
    """(doc_id, d, z, h, n_words, n_hit, n_items, items_sha256, contaminated) per row of ``docs``.

    Null and blank texts have no words, and items without words no windows. An item
    without item_id still marks words but is neither counted nor named. Rows of one
    item_id count as one item. Repeated documents each get their own row.
    """
    rows, hits, items = find_hits(docs, benchmark, size)
    key = ["d", "z", "h"]
    w = Window.partitionBy(*key).orderBy("start", "end")
    spans = hits.select(*key, "start", (F.col("start") + F.col("n")).alias("end")).distinct()
    before = F.coalesce(F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    n_hit = spans.withColumn("m", before).groupBy(*key).agg(F.sum(F.greatest(F.lit(0), F.col("end") - F.greatest("start", "m"))).alias("n_hit"))
    named = hits.select(*key, "win").distinct().join(items, "win").groupBy(*key).agg(F.array_sort(F.collect_set("item_id")).alias("names"))
    out = rows.join(n_hit, key, "left").join(named, key, "left")
    names = F.coalesce("names", F.array().cast("array<string>"))
    return out.select(
        "doc_id", *key, "n_words", F.coalesce("n_hit", F.lit(0)).alias("n_hit"), F.size(names).cast("long").alias("n_items"),
        F.sha2(F.array_join(names, ","), 256).alias("items_sha256"), (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"),
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, size: int = 10) -> DataFrame:
    """``docs`` without the rows that hold a window of the benchmark; null texts hold none and stay, repeated rows go or stay alike."""
    _, hits, _ = find_hits(docs, benchmark, size)
    bad = hits.selectExpr("d as _vl_d", "z as _vl_z", "h as _vl_h").distinct()
    d = docs.withColumns({"_vl_d": F.coalesce(F.col("doc_id").cast("long"), F.lit(0)), "_vl_z": F.isnull("doc_id"), "_vl_h": F.xxhash64("text")})
    return d.join(bad, ["_vl_d", "_vl_z", "_vl_h"], "left_anti").select(*docs.columns)
