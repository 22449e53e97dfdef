"""Quality rules and an isolation forest over their statistics.

The rules fail short and repetitive documents. The rest is judged by an isolation
forest (Liu, Ting and Zhou): random splits isolate odd rows early, so short paths mean
anomalies. Trees are grown on a bounded sample of labelled good rows, but cut the range of
all rows, so that junk falls into empty parts even where it is common. The threshold on the
score comes from all labelled rows, good and bad.
"""

from __future__ import annotations

import operator
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, materialize, trimmed

#: Rows the forest is grown on at most (by a hash of doc_id and text), its trees and the rows of each.
FIT_ROWS, TREES, TREE_ROWS = 8192, 100, 256
#: The most labelled good documents, of a thousand, that the forest may reject.
LOST_PER_MILLE = 2
BINS = 10_000

_SPACE = bytes([0x20, *range(0x09, 0x0E)])
_SYMBOLS = b"#*$%&|<>"
_ONE_SYMBOL = bytes(0x23 if c in _SYMBOLS else c for c in range(256))
_TAIL = bytes(range(0x80, 0xC0))
_UPPER = bytes(range(0x41, 0x5B))
_LETTER = bytes([*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)])
_DIGIT = bytes(range(0x30, 0x3A))
FEATURES = ("f_words", "f_word_chars", "f_symbols", "f_dup_lines", "f_repeats", "f_upper", "f_letters", "f_digits", "f_distinct", "f_symbol_words", "f_symbol_lines", "f_doubled")
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def rule_statistics(text: bytes | None) -> tuple[list[int], list[float]]:
    """The base counts of a text in UTF-8, and the features made of them and of letter counts."""
    b = text or b""
    w = b.split()
    n = len(w)
    inside = b.translate(None, _SPACE + _TAIL)
    symbols = len(b) - len(b.translate(None, _SYMBOLS))
    lines = [x for x in b.split(b"\n") if x.strip()]
    dup = len(lines) - len(set(lines))
    repeats = 0
    if n >= 5:
        c = Counter(zip(w, w[1:], w[2:], w[3:], w[4:]))
        if len(c) < n - 4:
            hit = np.zeros(n + 1, np.int32)
            often = np.fromiter((c[g] > 1 for g in zip(w, w[1:], w[2:], w[3:], w[4:])), bool, n - 4)
            hit[: n - 4] += often
            hit[5 : n + 1] -= often
            repeats = int((np.cumsum(hit)[:n] > 0).sum())
    chars, m = len(inside), max(1, n)
    part = lambda table: (len(b) - len(b.translate(None, table))) / max(1, chars)
    letters = part(_LETTER) if chars else 0.0
    symbol_words = symbol_lines = 0
    if symbols:
        one = b.translate(_ONE_SYMBOL)
        symbol_words = sum(b"#" in x for x in one.split())
        symbol_lines = sum(b"#" in x for x in one.split(b"\n"))
    return [n, chars, symbols, dup, repeats], [
        float(np.log1p(n)), chars / m, symbols / m, dup / max(1, len(lines)), repeats / m,
        part(_UPPER), letters, part(_DIGIT), len(set(w)) / m ** 0.8,
        float(np.sqrt(symbol_words / m)), symbol_lines / max(1, len(lines)), float(np.sqrt(sum(map(operator.eq, w, w[1:])) / m)),
    ]


def statistics(docs: DataFrame) -> DataFrame:
    """doc_id, the row's key d, z, h, the base counts and the features, per row of ``docs``."""
    bound_batches(docs.sparkSession)

    def run(batches):
        for b in batches:
            got = [rule_statistics(x.as_py()) for x in b.column(4).cast(pa.binary())]
            base = np.array([g[0] for g in got], np.int64).reshape(-1, len(BASE))
            feat = np.array([g[1] for g in got], np.float64).reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([*b.columns[:4], *map(pa.array, base.T), *map(pa.array, feat.T)], ["doc_id", "d", "z", "h", *BASE, *FEATURES])

    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("d"), F.isnull("doc_id").alias("z"), F.xxhash64("text").alias("h"), F.col("text").cast("string").alias("text"))
    kinds = "doc_id long, d long, z boolean, h long, " + ", ".join([f"{c} long" for c in BASE] + [f"{c} double" for c in FEATURES])
    out = src.mapInArrow(lambda batches: trimmed(run(batches)), kinds)
    return out.withColumn("base_failed", F.expr("n_words < 10 or 100 * n_repeat_words > 20 * n_words"))


def _c(n: np.ndarray | float) -> np.ndarray:
    n = np.asarray(n, float)
    return np.where(n > 2, 2 * (np.log(np.maximum(n - 1, 1)) + 0.5772156649) - 2 * (n - 1) / np.maximum(n, 1), np.where(n == 2, 1.0, 0.0))


class IsolationForest:
    """Trees as arrays: feature (-1 at a leaf), cut, and the path length that a leaf stands for.

    Splits are drawn from the range of a node's rows or, with ``box`` (lowest and highest
    values), from the node's part of the box, where rows unlike those of ``x`` find no others.
    """

    def __init__(self, x: np.ndarray, seed: int = 7, trees: int = TREES, rows: int = TREE_ROWS, box: tuple[np.ndarray, np.ndarray] | None = None) -> None:
        rng = np.random.default_rng(seed)
        m = min(rows, len(x))
        self.depth = max(1, int(np.ceil(np.log2(max(2, m)))))
        self.norm = max(1e-9, float(_c(m)))
        nodes = (1 << (self.depth + 1)) - 1
        self.feature, self.cut, self.length = np.full((trees, nodes), -1), np.zeros((trees, nodes)), np.zeros((trees, nodes))
        for t in range(trees):
            todo = [(0, 0, rng.choice(len(x), m, replace=False), box)] if m else []
            while todo:
                k, deep, own, room = todo.pop()
                part = x[own]
                lo, hi = room or ((part.min(axis=0), part.max(axis=0)) if len(own) else (x[0], x[0]))
                split = np.flatnonzero(hi > lo)
                if deep == self.depth or len(own) < 2 or not len(split):
                    self.length[t, k] = deep + float(_c(len(own)))
                    continue
                f = rng.choice(split)
                c = rng.uniform(lo[f], hi[f])
                self.feature[t, k], self.cut[t, k] = f, c
                left = part[:, f] <= c
                below, above = hi.copy(), lo.copy()
                below[f] = above[f] = c
                todo += [(2 * k + 1, deep + 1, own[left], room and (lo, below)), (2 * k + 2, deep + 1, own[~left], room and (above, hi))]

    def score(self, x: np.ndarray) -> np.ndarray:
        """Between 0 and 1, more for odd rows."""
        total, row = np.zeros(len(x)), np.arange(len(x))
        for t in range(len(self.feature)):
            k = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                f = self.feature[t, k]
                k = np.where(f < 0, k, 2 * k + 1 + (x[row, np.maximum(f, 0)] > self.cut[t, k]))
            total += self.length[t, k]
        return 2.0 ** (-total / len(self.feature) / self.norm)


def fitted(docs: DataFrame, labels: DataFrame, fit_rows: int, lost_per_mille: int):
    """(scored rows, the broadcast forest, the highest bin that is kept)."""
    st = materialize(statistics(docs), "quality-stats")
    pool = st.where(~F.col("base_failed"))
    # a document with both labels counts as good; a missing doc_id has none
    known = labels.where("quality in (0, 1) and doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("d")).agg(F.max("quality").alias("quality"))

    def sample(rows: DataFrame) -> np.ndarray:
        # the hash's cut leaves about fit_rows rows in all, so no task sends the driver as many of its own
        cut = int(min(1.0, fit_rows / max(1, rows.count())) * (1 << 30)) + 1
        few = rows.where(F.pmod(F.xxhash64("d", "h"), F.lit(1 << 30)) < cut)
        fit = few.orderBy(F.xxhash64("d"), "h").limit(fit_rows).select(*FEATURES).toArrow()
        return np.stack([fit[c].to_numpy() for c in FEATURES], axis=1) if fit.num_rows else np.zeros((0, len(FEATURES)))

    every, x = sample(pool), sample(pool.where("not z").join(known.where("quality = 1"), "d", "left_semi"))
    both = np.concatenate([every, x])
    grown = IsolationForest(x, box=(both.min(axis=0), both.max(axis=0))) if len(x) else IsolationForest(every)
    forest = st.sparkSession.sparkContext.broadcast(grown)

    def run(batches):
        for b in batches:
            m = np.stack([b.column(b.schema.names.index(c)).to_numpy() for c in FEATURES], axis=1)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.round(forest.value.score(m) * BINS).astype(np.int64))], [*b.schema.names, "bin"])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in st.schema)
    scored = materialize(st.mapInArrow(run, kinds + ", bin long"), "quality-scores")
    seen = scored.where("not base_failed and not z").join(known, "d")
    by_bin = seen.groupBy("bin").agg(F.sum(F.expr("int(quality = 1)")).alias("good"), F.sum(F.expr("int(quality = 0)")).alias("bad")).orderBy(F.desc("bin")).collect()  # BINS + 1 rows at most
    return scored, forest, threshold([(r["bin"], r["good"], r["bad"]) for r in by_bin], lost_per_mille)


def threshold(by_bin: list[tuple[int, int, int]], lost_per_mille: int) -> int:
    """The highest bin to keep, from (bin, good rows, bad rows) by falling bin.

    Of the cuts that lose at most ``lost_per_mille`` of the good rows it is the one of best
    balanced accuracy (without bad rows the lowest, and without good ones there is none).
    """
    n_good, n_bad = (sum(r[i] for r in by_bin) for i in (1, 2))
    top, best, good, bad = BINS + 1, 0.0, 0, 0
    for i, (bin_, g, b) in enumerate(by_bin):
        good, bad = good + g, bad + b
        if not n_good or good * 1000 > n_good * lost_per_mille:
            return top if n_bad or not n_good else bin_
        gain = bad / max(1, n_bad) - good / n_good
        if gain > best:
            # halfway to the next bin with labelled rows
            best, top = gain, (bin_ + (by_bin[i + 1][0] if i + 1 < len(by_bin) else bin_ - 1)) // 2
    return top


def held_out(docs: DataFrame, labels: DataFrame, folds: int = 5, fold: int = 0) -> dict[str, int]:
    """Rows that pass the rules, of one fold of the labels, judged with the labels of the others.

    bad, bad_rejected, good, good_rejected: recall is bad_rejected / bad, precision
    bad_rejected / (bad_rejected + good_rejected).
    """
    mine = F.pmod(F.xxhash64(F.col("doc_id").cast("long")), F.lit(folds)) == fold
    kept = judged(docs, labels.where(~mine)).where("not base_failed").select(F.col("doc_id").alias("d"), "kept")
    held = labels.where(mine & F.col("quality").isin(0, 1)).groupBy(F.col("doc_id").cast("long").alias("d")).agg(F.max("quality").alias("quality"))
    cells = {"bad": "quality = 0", "bad_rejected": "quality = 0 and not kept", "good": "quality = 1", "good_rejected": "quality = 1 and not kept"}
    return kept.join(held, "d").agg(*[F.count_if(F.expr(c)).alias(k) for k, c in cells.items()]).first().asDict()


def judged(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS, lost_per_mille: int = LOST_PER_MILLE) -> DataFrame:
    """Per row of ``docs``: doc_id, key d, z, h, the base counts, base_failed, anomaly, kept.

    kept is false where the rules fail, or where the anomaly score is above the
    threshold: that of best balanced accuracy on the labelled documents that pass the rules
    (quality 1 and 0), of those that lose at most ``lost_per_mille`` of the good ones.
    Without good ones the forest rejects nothing, without bad ones as much as it may. Labels of unknown documents or of null quality do not count. Null texts
    have no words and fail. Repeated rows are judged alike.
    """
    scored, _, top = fitted(docs, labels, fit_rows, lost_per_mille)
    odd = F.col("bin") > top
    return scored.select("doc_id", "d", "z", "h", *BASE, "base_failed", (F.col("bin") / BINS).alias("anomaly"), (~F.col("base_failed") & ~odd).alias("kept"))


def keep_good(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS, lost_per_mille: int = LOST_PER_MILLE) -> DataFrame:
    """``docs`` without the rows that :func:`judged` rejects; null and empty texts go, repeated rows go or stay alike.

    A second pass over the texts applies the fitted forest, so no text is shuffled.
    """
    _, forest, top = fitted(docs, labels, fit_rows, lost_per_mille)
    at = docs.columns.index("text")

    def run(batches):
        for b in batches:
            got = [rule_statistics(None if x is None else x.encode()) for x in b.column(at).cast(pa.string()).to_pylist()]
            base = np.array([g[0] for g in got], np.int64).reshape(-1, len(BASE))
            feat = np.array([g[1] for g in got], np.float64).reshape(-1, len(FEATURES))
            n, again = base[:, 0], base[:, BASE.index("n_repeat_words")]
            ok = (n >= 10) & (100 * again <= 20 * n) & (np.round(forest.value.score(feat) * BINS).astype(np.int64) <= top)
            yield b.filter(pa.array(ok))

    bound_batches(docs.sparkSession)
    return docs.mapInArrow(lambda batches: trimmed(run(batches)), docs.schema)
