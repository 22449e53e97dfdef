"""Mixing sources to target weights over fixed-length blocks of words.

Each source's words, documents one after another, are cut into blocks. The targets are
shares of the mix, topped up to whole slots; output shards draw their source counts
(a multinomial draw given the totals, split down a binary tree of shards, so that every
shard finds its own counts and first slots alone). A source's slot goes through a
Feistel permutation of its blocks, anew for each pass, and is joined to the documents'
parts by block number.
"""

from __future__ import annotations

import hashlib
from fractions import Fraction

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, bound_batches, materialize

WEIGHTS, SHARE, CAP = (5, 2, 1), Fraction(3, 2), 2
#: Words of a block, and slots of an output shard.
BLOCK, SHARD_SLOTS = 256, 4096
#: A source's running size is summed in so many chunks, so a hot source fills no single task.
CHUNKS = 1024
#: The mix is specified by source; with more the sources' table would not be fit to send around.
MAX_SOURCES = 100_000


def targets(sizes: list[int], weights=WEIGHTS, share: Fraction = SHARE, cap: int = CAP) -> list[float]:
    """Targets by source, in order: shares by weight, cut at ``cap`` sizes, the rest shared anew."""
    rest, left, out = share * sum(sizes), dict(enumerate(weights[i % len(weights)] for i in range(len(sizes)))), [0.0] * len(sizes)
    while left:
        unit = Fraction(rest) / sum(left.values())
        full = [i for i, w in left.items() if unit * w > cap * sizes[i]]
        for i in full or left:
            out[i] = float(cap * sizes[i] if full else unit * left[i])
        if not full:
            break
        rest -= sum(cap * sizes[i] for i in full)
        for i in full:
            del left[i]
    return out


class Permutation:
    """A keyed permutation of range(n): four Feistel rounds, walking cycles back into range."""

    def __init__(self, n: int, *key: int) -> None:
        self.n, self.half = n, max(1, (max(n - 1, 1).bit_length() + 1) // 2)
        d = hashlib.sha256(repr(key).encode()).digest()
        self.keys = np.frombuffer(d, "<u8")
        self.mask = np.uint64((1 << self.half) - 1)

    def _f(self, r: np.ndarray, k: np.uint64) -> np.ndarray:
        x = (r + k) * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        return (x >> np.uint64(32)) & self.mask

    def _once(self, x: np.ndarray, back: bool) -> np.ndarray:
        l, r = x >> np.uint64(self.half), x & self.mask
        for k in self.keys[::-1] if back else self.keys:
            l, r = (r ^ self._f(l, k), l) if back else (r, l ^ self._f(r, k))
        return (l << np.uint64(self.half)) | r

    def __call__(self, i, back: bool = False) -> np.ndarray:
        x = self._once(np.atleast_1d(np.asarray(i, np.uint64)), back)
        while (out := x >= self.n).any():
            x[out] = self._once(x[out], back)
        return x.astype(np.int64)


class Plan:
    """What is fixed for a mix: sizes and targets by source, hence blocks and slots."""

    def __init__(self, names: list, sizes: list[int], goal: list[float], block: int, shard_slots: int, seed: int) -> None:
        self.names, self.sizes, self.goal, self.block, self.seed = names, sizes, goal, block, seed
        self.blocks = [-(-s // block) for s in sizes]
        self.words = [min(round(g), CAP * s) for g, s in zip(goal, sizes)]
        self.slots = [self._slots(i) for i in range(len(sizes))]
        self.shards = max(1, -(-sum(self.slots) // shard_slots))

    def order(self, i: int, turn: int) -> Permutation:
        return Permutation(self.blocks[i], self.seed, i, turn)

    def _short(self, i: int, turn: int) -> tuple[int, int]:
        """Position of the source's last block in a pass, and the words it lacks."""
        return int(self.order(i, turn)(self.blocks[i] - 1, back=True)[0]), self.blocks[i] * self.block - self.sizes[i]

    def _slots(self, i: int) -> int:
        if not self.words[i]:
            return 0
        turn, rest = divmod(self.words[i], self.sizes[i])
        if not rest:
            return turn * self.blocks[i]
        q, lack = self._short(i, turn)
        k = -(-(rest + lack) // self.block) if rest > self.block * (q + 1) - lack else min(-(-rest // self.block), q + 1)
        return turn * self.blocks[i] + k

    def draw(self, shard: int) -> tuple[np.ndarray, np.ndarray]:
        """(counts, first slots) by source of an output shard."""
        counts, first, lo, hi, node = np.array(self.slots, np.int64), np.zeros(len(self.slots), np.int64), 0, self.shards, 1
        while hi - lo > 1:
            mid = (lo + hi) // 2
            rng = np.random.default_rng([self.seed, node])
            total, want = int(counts.sum()), int(counts.sum()) * (mid - lo) // (hi - lo)
            left = np.zeros_like(counts)
            for i, c in enumerate(counts.tolist()):  # a multivariate hypergeometric draw, source by source
                if c and want:
                    if total < 10**9:
                        left[i] = rng.hypergeometric(c, total - c, want) if total > c else want
                    else:  # beyond numpy's range, by its normal approximation
                        p = want / total
                        left[i] = np.clip(round(rng.normal(c * p, (c * p * (1 - p) * (1 - c / total)) ** 0.5)), max(0, want - (total - c)), min(c, want))
                total -= c
                want -= int(left[i])
            if shard < mid:
                counts, hi, node = left, mid, 2 * node
            else:
                first, counts, lo, node = first + left, counts - left, mid, 2 * node + 1
        return counts, first

    def shard(self, shard: int) -> pd.DataFrame:
        """The shard's slots: source, slot, turn, block, words (fewer than a block at a source's ends)."""
        out = []
        for i, (n, a) in enumerate(zip(*self.draw(shard))):
            if not n:
                continue
            slot = np.arange(a, a + n)
            turns, at = np.divmod(slot, self.blocks[i])
            for t in np.unique(turns).tolist():
                s, j = slot[turns == t], at[turns == t]
                q, lack = self._short(i, t)
                b = self.order(i, t)(j)
                size = np.where(b == self.blocks[i] - 1, self.block - lack, self.block)
                need = min(self.words[i] - t * self.sizes[i], self.sizes[i])
                out.append(pd.DataFrame({"shard": shard, "source_no": i, "slot": s, "turn": t, "block": b, "words": np.clip(need - (j * self.block - np.where(j > q, lack, 0)), 0, size)}))
        cols = ["shard", "source_no", "slot", "turn", "block", "words"]
        return (pd.concat(out) if out else pd.DataFrame(columns=cols))[cols].astype("int64")


def sized(docs: DataFrame) -> DataFrame:
    """doc_id, the row's key d, z, h, rn (1, 2, … among equal rows), source, size in words."""
    base = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("d"), F.isnull("doc_id").alias("z"),
        F.xxhash64("text", "source").alias("h"), F.col("source").cast("string").alias("source"), F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
    )
    return base.withColumn("rn", F.row_number().over(Window.partitionBy("d", "z", "h").orderBy("size")))


def mix_plan(rows: DataFrame, block: int, shard_slots: int, seed: int) -> Plan:
    found = rows.groupBy("source").agg(F.sum("size").alias("s")).limit(MAX_SOURCES + 1).collect()
    if len(found) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources; a mix is specified for fewer")
    found.sort(key=lambda r: (r["source"] is None, (r["source"] or "").encode()))
    sizes = [r["s"] for r in found]
    return Plan([r["source"] for r in found], sizes, targets(sizes), block, shard_slots, seed)


def mix(docs: DataFrame, block: int = BLOCK, shard_slots: int = SHARD_SLOTS, seed: int = 11) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows, slots, pieces).

    rows: per row of ``docs`` doc_id, d, z, h, rn, size, source_size, target, source_no, off (its
    first word's place in the source). slots: the mix, by shard. pieces: what each slot takes
    of a row: turn, slot, lo and hi (words of the document). Null texts have size 0 and are not
    taken; a null source is a source, the last. Equal rows are told apart by rn.
    """
    spark = docs.sparkSession
    rows = materialize(sized(docs), "mix-sizes")
    plan = mix_plan(rows, block, shard_slots, seed)
    spec = spark.createDataFrame([(i, n, s, g) for i, (n, s, g) in enumerate(zip(plan.names, plan.sizes, plan.goal))], "source_no int, name string, source_size long, target double")
    chunk = F.pmod(F.xxhash64("d", "h"), F.lit(CHUNKS))
    # at most MAX_SOURCES rows, checked above
    r = rows.join(F.broadcast(spec), F.col("source").eqNullSafe(F.col("name"))).withColumn("chunk", chunk)
    inside = Window.partitionBy("source_no", "chunk").orderBy("d", "z", "h", "rn").rowsBetween(Window.unboundedPreceding, -1)
    base = r.groupBy("source_no", "chunk").agg(F.sum("size").alias("s"))
    base = base.withColumn("base", F.coalesce(F.sum("s").over(Window.partitionBy("source_no").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("s")
    placed = materialize(
        r.withColumn("before", F.coalesce(F.sum("size").over(inside), F.lit(0))).join(base, ["source_no", "chunk"])
        .select("doc_id", "d", "z", "h", "rn", "size", "source_size", "target", "source_no", (F.col("base") + F.col("before")).alias("off")),
        "mix-rows",
    )
    held = spark.sparkContext.broadcast(plan)

    def slots_of(batches):
        for b in batches:
            for s in b["id"]:
                yield held.value.shard(int(s))

    tasks = min(plan.shards, 10_000)
    slots = spark.range(0, plan.shards, 1, tasks).mapInPandas(slots_of, "shard long, source_no long, slot long, turn long, block long, words long")
    L = F.lit(block)
    parts = placed.where("size > 0").select("d", "z", "h", "rn", "off", "size", F.col("source_no").cast("long").alias("source_no"), F.explode(F.sequence(F.floor(F.col("off") / L), F.floor((F.col("off") + F.col("size") - 1) / L))).alias("block"))
    lo = F.greatest(F.col("block") * L, F.col("off"))
    hi = F.least(F.col("block") * L + F.col("words"), F.col("off") + F.col("size"))
    # a slot's row count is not in the plan's estimates, so without the hint the whole mix would be sent round
    pieces = parts.join(slots.hint("merge"), ["source_no", "block"]).where(hi > lo).select("d", "z", "h", "rn", "shard", "turn", "slot", (lo - F.col("off")).alias("lo"), (hi - F.col("off")).alias("hi"))
    return placed, slots, pieces


def mix_report(docs: DataFrame, block: int = BLOCK, shard_slots: int = SHARD_SLOTS, seed: int = 11) -> DataFrame:
    """(doc_id, size, source_size, target, taken) per row of ``docs``."""
    rows, _, pieces = mix(docs, block, shard_slots, seed)
    key = ["d", "z", "h", "rn"]
    taken = pieces.groupBy(*key).agg(F.sum(F.col("hi") - F.col("lo")).alias("taken"))
    return rows.join(taken, key, "left").select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


def mixed_documents(docs: DataFrame, block: int = BLOCK, shard_slots: int = SHARD_SLOTS, seed: int = 11) -> DataFrame:
    """The mix as documents: a row for each pass over a document, holding the words taken then.

    Columns are those of ``docs``; text holds the taken stretches, with their own white
    space inside and a line end between stretches, and n_chars (if there) its length. Texts
    without words, null ones among them, give no row; repeated rows are taken each on its own;
    an empty table gives no rows.
    """
    import re

    import pyarrow as pa

    bound_batches(docs.sparkSession)
    _, _, pieces = mix(docs, block, shard_slots, seed)
    key = ["d", "z", "h", "rn"]
    per = pieces.groupBy(*key, "turn").agg(F.array_sort(F.collect_list(F.struct("lo", "hi"))).alias("_vl_spans"))
    cols = docs.columns
    # the row's own columns stand in a struct, so that none clashes with those added here
    d = docs.select(F.struct(*cols).alias("row"), F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("d"), F.isnull("doc_id").alias("z"), F.xxhash64("text", "source").alias("h"))
    d = d.withColumn("rn", F.row_number().over(Window.partitionBy("d", "z", "h").orderBy("d")))
    j = d.join(per, key).select("row.*", F.col("_vl_spans"))
    word, at, has = re.compile(WORD.encode()), cols.index("text"), "n_chars" in cols

    def cut(batches):
        for b in batches:
            texts = []
            for t, spans in zip(b.column(at).cast(pa.binary()), b.column(len(cols)).to_pylist()):
                raw = t.as_py()
                se = [m.span() for m in word.finditer(raw)]
                texts.append(b"\n".join(raw[se[s["lo"]][0] : se[s["hi"] - 1][1]] for s in spans).decode())
            arrays = list(b.columns[: len(cols)])
            arrays[at] = pa.array(texts, pa.string())
            if has:
                k = cols.index("n_chars")
                arrays[k] = pa.array([len(x) for x in texts], pa.int64()).cast(arrays[k].type)
            yield pa.RecordBatch.from_arrays(arrays, names=cols)

    return j.mapInArrow(cut, docs.schema)
