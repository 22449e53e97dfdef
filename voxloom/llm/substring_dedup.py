"""Substring dedup: MinHash banding over paragraphs, and common passages between them.

Paragraphs are lines of ``LEAST`` words or more (longer ones than ``LONG`` are cut at content-defined
places) and whole texts of fewer than ``WHOLE`` words. Distinct paragraphs are banded, those
that collide are compared by the exact Jaccard similarity of their shingle sets, links (a
spanning forest for each bucket) are clustered by connected components, and of each cluster
all but the first copy is marked for removal.

A passage that crosses lines, or is part of one, is found by windows of ``SEED`` words: winnowing
(Schleimer, Wilkerson and Aiken) picks those with the smallest five-word shingle hash of every
``WINDOW`` starts, so two documents with a common passage of WINDOW + SEED - 1 = 35 words
or more have a picked window in common, wherever the passage stands. Windows that occur in two
documents are extended word by word to what another document holds too: within a passage of 35
words picks are at most WINDOW apart, so REACH words suffice. What has fewer than ``PASSAGE`` words then
is no passage.

Texts are read in batches whose words lie in flat arrays. A row for each pick and paragraph is
written once; only those that a bitmap sized by the repeated ones lets through are joined.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bound_batches, discard, free_shuffles, materialize
from .components import connected_components
from .words import mix, powers, shingles, words

SEED, WINDOW, PASSAGE, SHINGLE, SIMILARITY = 8, 28, 20, 5, 0.8
#: At similarity 0.8 five bands of two rows find a pair with probability 1 - (1 - 0.8**2)**5 = 0.994.
BANDS, ROWS = 5, 2
#: Words from which a line is a paragraph, from which it is cut, and from which a text is none as a whole.
LEAST, LONG, WHOLE = 20, 200, 100
#: Words beside a window by which it may grow on either side.
REACH = WINDOW - 1
#: Paragraphs of one bucket that a task compares at once; a larger bucket is cut into a grid.
CELL = 2048
#: Bits of a bitmap for each row it stands for, and in all (32 MB to each executor); with more rows none is used.
BITS_EACH, BITS = 16, 1 << 28
_SEEDS = mix(np.arange(1, BANDS * ROWS + 1, dtype=np.uint64) * np.uint64(0xA24BAED4963EE407)) | np.uint64(1)
_LOW = np.uint64((1 << 24) - 1)
_TOP = np.uint64(2**64 - 1)
WINDOWS, PARAGRAPHS, ROW = 1, 2, 0


class Texts:
    """The words of some texts, one after another: hashes ``h``, five-word shingles ``sh``, and where each text's words begin and end."""

    def __init__(self, texts: list[bytes | None]) -> None:
        low = [(t or b"").lower() for t in texts]
        raw = b"\n".join(low)
        start, _, self.h = words(raw)
        size = np.array([len(t) + 1 for t in low], np.int64)
        at = np.cumsum(size) - size
        self.begin = np.searchsorted(start, at)
        self.end = np.searchsorted(start, at + size)
        self.sh = shingles(self.h, SHINGLE)
        breaks = np.flatnonzero(np.frombuffer(raw, np.uint8) == 10)
        self.lines = np.unique(np.r_[self.begin, self.end, np.searchsorted(start, breaks)])

    def picks(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, place among all words, pid) of the windows that winnowing picks."""
        n = self.end - self.begin - SEED + 1  # starts of each text
        some = np.flatnonzero(n > 0)
        if not len(some):
            return some, some, self.h[:0]
        text = np.full(len(self.h), -1)
        inside = np.arange(int(n[some].sum())) - np.repeat(np.cumsum(n[some]) - n[some], n[some])
        text[np.repeat(self.begin[some], n[some]) + inside] = np.repeat(some, n[some])
        # the place in the low bits makes the first of equal hashes the smallest
        key = np.full(-(-len(text) // WINDOW) * WINDOW, _TOP)
        ok = np.flatnonzero(text >= 0)
        key[ok] = (self.sh[ok] & ~_LOW) | (ok.astype(np.uint64) & _LOW)
        short = some[n[some] < WINDOW]
        found = [np.zeros(0, np.int64)]
        if len(short):
            ends = np.stack([self.begin[short], self.begin[short] + n[short]], axis=1).ravel()
            low = np.minimum.reduceat(np.r_[key, _TOP], ends)[::2]
            found.append(self.begin[short] + ((low - self.begin[short].astype(np.uint64)) & _LOW).astype(np.int64))
        # minima of all WINDOW starts in a row, from those of blocks before and behind
        block = key.reshape(-1, WINDOW)
        ahead = np.minimum.accumulate(block[:, ::-1], axis=1)[:, ::-1].ravel()
        behind = np.minimum.accumulate(block, axis=1).ravel()
        i = ok[ok + WINDOW - 1 < len(text)]
        i = i[text[i + WINDOW - 1] == text[i]]
        low = np.minimum(ahead[i], behind[i + WINDOW - 1])
        new = np.r_[True, low[1:] != low[:-1]] if len(low) else np.zeros(0, bool)
        found.append(i[new] + ((low[new] - i[new].astype(np.uint64)) & _LOW).astype(np.int64))
        at = np.unique(np.concatenate(found))
        pid = np.full(len(at), 17, np.uint64)
        for k in (0, SEED - SHINGLE):
            pid = mix(pid * np.uint64(0x9E3779B97F4A7C15) + self.sh[at + k])
        return text[at], at, mix(pid)

    def paragraphs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, first word, last word + 1) of the paragraphs."""
        a, b = self.lines[:-1], self.lines[1:]
        text = np.searchsorted(self.end, a, "right")
        keep = b - a >= LEAST
        a, b, text = a[keep], b[keep], text[keep]
        first, last, of = [], [], []
        for i in np.flatnonzero(b - a > LONG).tolist():  # cut where a shingle's hash is smallest
            at, end = int(a[i]), int(b[i])
            cuts = []
            while end - at > LONG:
                at += LONG // 2 + int(self.sh[at + LONG // 2 : at + LONG - LEAST].argmin())
                cuts.append(at)
            first += cuts
            last += [*cuts[1:], end]
            of += [text[i]] * len(cuts)
            b[i] = cuts[0]
        a, b, text = (np.concatenate([x, np.array(y, np.int64)]) for x, y in ((a, first), (b, last), (text, of)))
        n = self.end - self.begin
        whole = np.flatnonzero((n > 0) & (n < WHOLE))
        # a line that is all of its text stands here once
        line = np.flatnonzero(~((n[text] < WHOLE) & (b - a == n[text])))
        text, a, b = np.r_[text[line], whole], np.r_[a[line], self.begin[whole]], np.r_[b[line], self.end[whole]]
        order = np.lexsort((b, a))
        return text[order], a[order], b[order]

    def sets(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(shingles one after another, their number) of the paragraphs; one of fewer than five words has one."""
        n = np.maximum(b - a - SHINGLE + 1, 1)
        first = np.cumsum(n) - n
        at = np.repeat(a, n) + np.arange(int(n.sum())) - np.repeat(first, n)
        few = np.flatnonzero(b - a < SHINGLE)
        out = np.r_[self.sh, np.zeros(SHINGLE, np.uint64)][at] if len(at) else self.sh[:0]
        for i in few.tolist():
            out[first[i]] = shingles(self.h[a[i] : b[i]], int(b[i] - a[i]))[0]
        return out, n


def _names(sets: np.ndarray, n: np.ndarray) -> np.ndarray:
    """64-bit names of paragraphs by their shingles in order."""
    if not len(n):
        return np.zeros(0, np.uint64)
    first = np.cumsum(n) - n
    place = np.arange(len(sets)) - np.repeat(first, n)
    return mix(np.add.reduceat(mix(sets) * powers(int(n.max()))[place], first) + n.astype(np.uint64))


def _bands(sets: np.ndarray, n: np.ndarray) -> np.ndarray:
    out = np.zeros((len(n), BANDS), np.uint64)
    if not len(n):
        return out
    first = np.cumsum(n) - n
    for k in range(BANDS):
        v = np.full(len(n), k + 1, np.uint64)
        for r in range(ROWS):
            seed = _SEEDS[k * ROWS + r]
            v = mix(v * np.uint64(0x9E3779B97F4A7C15) + np.minimum.reduceat((sets ^ (seed >> np.uint64(7))) * seed, first))
        out[:, k] = v
    return out


def _source(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(2**63 - 1)).alias("d"), F.xxhash64("text").alias("h"), F.col("text").cast("string").alias("text"))


def _grouped(batches, columns):
    """Whole groups of equal first two columns, from batches sorted by them."""
    held = None
    for b in batches:
        new = columns(b)
        cols = new if held is None else [np.concatenate(x) for x in zip(held, new)]
        if not len(cols[0]):
            continue
        cut = np.flatnonzero((cols[0] != cols[0][-1]) | (cols[1] != cols[1][-1]))
        cut = cut[-1] + 1 if len(cut) else 0
        if cut:
            yield [c[:cut] for c in cols]
        held = [c[cut:] for c in cols]
    if held is not None and len(held[0]):
        yield held


def _jaccard_forest(sets: np.ndarray, similarity: float) -> list[tuple[int, int]]:
    """Spanning links among rows, breadth first; sets hold sorted distinct values, then zeros."""
    left, out = np.arange(len(sets)), []
    size = (sets != 0).sum(axis=1)
    while len(left) > 1:
        todo, left = [left[0]], left[1:]
        while todo and len(left):
            x = todo.pop()
            own = sets[x][: size[x]]
            at = np.minimum(np.searchsorted(own, sets[left]), len(own) - 1)
            both = ((own[at] == sets[left]) & (sets[left] != 0)).sum(axis=1)
            near = both >= similarity * (size[x] + size[left] - both) - 1e-9
            if near.any():
                new, left = left[near], left[~near]
                out += [(int(x), int(y)) for y in new]
                todo.extend(new)
    return out


def _reach(x: np.ndarray, y: np.ndarray) -> tuple[int, int]:
    """The first and last place of ``x`` whose value ``y`` has too."""
    at = np.flatnonzero(np.isin(x, y))
    return int(at[0]), int(at[-1])


class Marks:
    """A broadcast bitmap of some pids: whether others may be among them. It grows with their number, and beyond BITS lets all through."""

    def __init__(self, pids: DataFrame) -> None:
        n = pids.count()
        self.bits = min(BITS, 1 << max(20, (n * BITS_EACH - 1).bit_length())) if n else 64
        if n * BITS_EACH > 2 * BITS:
            self.map = None
            return
        word = F.expr(f"cast(pmod(pid, {self.bits}) div 64 as int)")
        got = pids.select(word.alias("w"), F.expr(f"shiftleft(1L, cast(pmod(pid, {self.bits}) % 64 as int))").alias("b")).groupBy("w").agg(F.bit_or("b").alias("b")).toArrow()
        bits = np.zeros(self.bits // 64, np.uint64)
        bits[got["w"].to_numpy()] = got["b"].to_numpy().view(np.uint64)
        self.map = pids.sparkSession.sparkContext.broadcast(bits)

    def __call__(self, pid: np.ndarray) -> np.ndarray:
        if self.map is None:
            return np.ones(len(pid), bool)
        pos = pid & np.uint64(self.bits - 1)
        return (self.map.value[(pos >> np.uint64(6)).astype(np.int64)] >> (pos & np.uint64(63))) & np.uint64(1) == 1


def _beside(h: np.ndarray, low: np.ndarray, high: np.ndarray, back: bool) -> list[bytes]:
    """Word hashes of h[low:high] of each row, 32 bits each, outwards."""
    h = (h >> np.uint64(32)).astype("<u4")
    return [h[a:b][::-1].tobytes() if back else h[a:b].tobytes() for a, b in zip(low.tolist(), high.tolist())]


def _common(group: np.ndarray, d: np.ndarray, h: np.ndarray, beside: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per row: words that it has in common with a row of its group of another document, with one of
    a smaller d, and the smallest d of those (its own where there is none). A word is 32 bits of its hash."""
    size = np.array([len(x) // 4 for x in beside])
    first = np.cumsum(size) - size
    flat = np.frombuffer(b"".join(beside), "<u4").astype(np.uint64)
    doc = mix(mix(d.view(np.uint64)) + h.view(np.uint64))
    any_, less, least = np.zeros(len(d), np.int64), np.zeros(len(d), np.int64), d.copy()
    prefix, left = group.view(np.uint64).copy(), np.arange(len(d))
    for k in range(REACH):
        left = left[size[left] > k]
        if not len(left):
            break
        prefix[left] = mix(prefix[left] * np.uint64(0x9E3779B97F4A7C15) + flat[first[left] + k])
        left = left[np.argsort(prefix[left], kind="stable")]
        new = np.r_[True, prefix[left][1:] != prefix[left][:-1]]
        at, run = np.flatnonzero(new), np.cumsum(new) - 1
        shared = (np.minimum.reduceat(doc[left], at) != np.maximum.reduceat(doc[left], at))[run]
        low = np.minimum.reduceat(d[left], at)[run]
        any_[left[shared]] = k + 1
        gone = low < d[left]
        less[left[gone]], least[left[gone]] = k + 1, low[gone]
        left = left[shared]
    return any_, less, least


def units(docs: DataFrame) -> DataFrame:
    """d, h, kind, n, pos, pid, b0…: a row for each picked window, paragraph (n words, with its bands) and row of ``docs`` (n words)."""
    bound_batches(docs.sparkSession)
    names = ["d", "h", "kind", "n", "pos", "pid", *[f"b{i}" for i in range(BANDS)]]

    def run(batches):
        for b in batches:
            d, h = b.column(0).to_numpy(), b.column(1).to_numpy()
            t = Texts(b.column(2).cast(pa.binary()).to_pylist())
            none = lambda k: pa.nulls(k, pa.int64())
            row = lambda i, kind, n, pos, pid, bands: pa.RecordBatch.from_arrays([pa.array(d[i]), pa.array(h[i]), pa.array(np.full(len(i), kind)), n, pos, pid, *bands], names)
            long = lambda x: pa.array(np.ascontiguousarray(x).view(np.int64))
            text, at, pid = t.picks()
            yield row(text, WINDOWS, none(len(text)), long(at - t.begin[text]), long(pid), [none(len(text))] * BANDS)
            text, a, e = t.paragraphs()
            sets, n = t.sets(a, e)
            yield row(text, PARAGRAPHS, long(e - a), long(a - t.begin[text]), long(_names(sets, n)), [long(x) for x in _bands(sets, n).T])
            every = np.arange(len(d))
            yield row(every, ROW, long(t.end - t.begin), none(len(d)), none(len(d)), [none(len(d))] * BANDS)

    return materialize(_source(docs).mapInArrow(run, ", ".join(f"{c} long" for c in names)), "substring-units")


def extended(docs: DataFrame, repeats: DataFrame) -> DataFrame:
    """Spans d, h, start, end, first, gone: the paragraphs of ``repeats``, and its windows with what other documents have beside them too.

    gone: a document of smaller d, ``first``, holds the span too.
    """
    seeds = repeats.where(F.col("kind") == WINDOWS)
    marked = Marks(seeds.select("pid").distinct())
    bound_batches(docs.sparkSession)

    def run(batches):
        for b in batches:
            t = Texts(b.column(2).cast(pa.binary()).to_pylist())
            text, at, pid = t.picks()
            m = marked(pid)
            text, at, pid = text[m], at[m], pid[m]
            d, h = b.column(0).to_numpy()[text], b.column(1).to_numpy()[text]
            pos = at - t.begin[text]
            sides = (_beside(t.h, np.maximum(t.begin[text], at - REACH), at, True), -1), (_beside(t.h, at + SEED, np.minimum(t.end[text], at + SEED + REACH), False), 1)
            for s, way in sides:
                some = np.array([len(x) > 0 for x in s], bool)
                first = np.array([int.from_bytes(x[:4], "little") for x in s], np.uint64)
                # rows of one key have the word next to the window in common
                key = mix(mix(pid + first) * np.uint64(3) + np.uint64(way + 1)).view(np.int64)
                yield pa.RecordBatch.from_arrays([*(pa.array(x[some]) for x in (key, d, h, pos, np.full(len(s), way))), pa.array([x for x in s if x], pa.binary())], ["key", "d", "h", "pos", "way", "s"])

    def columns(b):
        beside = np.empty(b.num_rows, object)
        beside[:] = b.column(5).to_pylist()
        longs = [b.column(i).to_numpy() for i in range(5)]
        return [longs[0], *longs, beside]

    def grow(batches):
        for key, _, d, h, pos, way, beside in _grouped(batches, columns):
            any_, less, least = _common(key, d, h, beside)
            m = any_ > 0
            yield pa.RecordBatch.from_arrays([pa.array(x[m]) for x in (d, h, pos, way, any_, less, least)], ["d", "h", "pos", "way", "n", "less", "least"])

    # a window that the bitmap lets through by chance has no equal in another document
    sides = _source(docs).mapInArrow(run, "key long, d long, h long, pos long, way long, s binary").repartition("key").sortWithinPartitions("key")
    sides = sides.mapInArrow(grow, "d long, h long, pos long, way long, n long, less long, least long")
    none = [F.lit(None).cast("long").alias(c) for c in ("way", "n", "less", "least")]
    both = sides.select("*", F.lit(None).cast("long").alias("first_d")).unionByName(seeds.select("d", "h", "pos", *none, "first_d"))
    pick = lambda c, way: F.coalesce(F.max(F.when(F.col("way") == way, F.col(c))), F.lit(0))
    at = both.groupBy("d", "h", "pos").agg(F.max("first_d").alias("first_d"), *[pick(c, w).alias(f"{c}_{k}") for c in ("n", "less", "least") for w, k in ((-1, "l"), (1, "r"))])
    at = at.where((F.col("first_d").isNotNull()) & (F.col("n_l") + F.col("n_r") + SEED >= PASSAGE))
    end = F.col("pos") + SEED
    span = lambda a, b, first, gone: F.when(a < b, F.struct(a.alias("start"), b.alias("end"), first.alias("first"), gone.alias("gone")))
    own_first = lambda k: F.when(F.col(f"less_{k}") > 0, F.col(f"least_{k}")).otherwise(F.col("d"))
    spans = F.array(
        span(F.col("pos"), end, F.col("first_d"), F.expr("d <> first_d")),
        span(F.col("pos") - F.col("n_l"), F.col("pos"), own_first("l"), F.lit(False)), span(end, end + F.col("n_r"), own_first("r"), F.lit(False)),
        span(F.col("pos") - F.col("less_l"), F.col("pos"), F.col("least_l"), F.lit(True)), span(end, end + F.col("less_r"), F.col("least_r"), F.lit(True)),
    )
    grown = at.select("d", "h", F.explode(F.filter(spans, lambda x: x.isNotNull())).alias("x")).select("d", "h", "x.*")
    own = repeats.where(F.col("kind") == PARAGRAPHS).select("d", "h", F.col("pos").alias("start"), (F.col("pos") + F.col("n")).alias("end"), F.col("first_d").alias("first"), F.expr("d <> first_d").alias("gone"))
    return materialize(own.union(grown), "substring-spans")


def paragraph_links(docs: DataFrame, paragraphs: DataFrame, similarity: float = SIMILARITY, cell: int = CELL) -> DataFrame:
    """Spanning links (u, v, u0, u1, v0, v1) among distinct paragraphs whose shingle sets are that similar.

    u0, u1: the first and last place among the shingles of u that v has too, and so on.
    """

    def colliding(batches):
        """Rows of buckets with two paragraphs or more (pid is distinct within a band)."""
        last, sent = None, False  # the row before, and whether it was passed on
        for b in batches:
            band, pid = b.column(0).to_numpy(), b.column(1).to_numpy()
            if not len(band):
                continue
            same = np.diff(band) == 0
            before, after = np.r_[last is not None and last[0] == band[0], same], np.r_[same, False]
            m = before | after
            if before[0] and not sent:
                yield pa.RecordBatch.from_arrays([pa.array([last[0]]), pa.array([last[1]])], ["band", "pid"])
            yield pa.RecordBatch.from_arrays([pa.array(band[m]), pa.array(pid[m])], ["band", "pid"])
            last, sent = (band[-1], pid[-1]), bool(m[-1])

    distinct = paragraphs.groupBy("pid").agg(*[F.min(f"b{i}").alias(f"b{i}") for i in range(BANDS)])
    banded = distinct.select(F.explode(F.array(*[f"b{i}" for i in range(BANDS)])).alias("band"), "pid")
    hits = materialize(banded.repartition("band").sortWithinPartitions("band").mapInArrow(colliding, "band long, pid long"), "substring-hits")
    wanted = hits.select("pid").distinct()
    marked = Marks(wanted)
    bound_batches(docs.sparkSession)

    def sets_of(batches):
        for b in batches:
            t = Texts(b.column(0).cast(pa.binary()).to_pylist())
            _, a, e = t.paragraphs()
            sets, n = t.sets(a, e)
            pid = _names(sets, n)
            i = np.flatnonzero(marked(pid))
            i = i[np.unique(pid[i], return_index=True)[1]]
            end = np.cumsum(n)
            yield pa.RecordBatch.from_arrays([pa.array(pid[i].view(np.int64)), pa.array([sets[x - k : x].tobytes() for x, k in zip(end[i].tolist(), n[i].tolist())], pa.binary())], ["pid", "s"])

    held = materialize(docs.select(F.col("text").cast("string").alias("text")).mapInArrow(sets_of, "pid long, s binary").groupBy("pid").agg(F.min("s").alias("s")), "substring-sets")
    hot = materialize(hits.groupBy("band").count().where(F.col("count") > cell).select("band", F.ceil(F.col("count") * 2 / cell).alias("m")), "substring-hot")
    rows = hits.join(hot, "band", "left").withColumn("i", F.when(F.col("m").isNotNull(), F.pmod(F.xxhash64("pid"), F.col("m"))))
    grid = F.transform(F.sequence(F.lit(0).cast("long"), F.col("m") - 1), lambda j: F.least(j, F.col("i")) * F.col("m") + F.greatest(j, F.col("i")))
    cells = rows.select("band", F.explode(F.when(F.col("m").isNotNull(), grid).otherwise(F.array(F.lit(-1).cast("long")))).alias("cell"), "pid")
    cells = cells.join(held, "pid").select("band", "cell", "pid", "s")

    def columns(b):
        sets = np.empty(b.num_rows, object)
        sets[:] = b.column(3).to_pylist()
        return [b.column(0).to_numpy(), b.column(1).to_numpy(), b.column(2).to_numpy(), sets]

    names = ["u", "v", "u0", "u1", "v0", "v1"]

    def links(batches):
        for band, cell_no, pid, raw in _grouped(batches, columns):
            start = np.r_[0, np.flatnonzero((np.diff(band) != 0) | (np.diff(cell_no) != 0)) + 1]
            found = {}
            for s, e in zip(start.tolist(), [*start[1:].tolist(), len(band)]):
                if e - s < 2:
                    continue
                lists = [np.frombuffer(x, np.uint64) for x in raw[s:e]]
                sets = [np.unique(x) for x in lists]
                flat = np.zeros((len(sets), max(map(len, sets))), np.uint64)
                for row, x in zip(flat, sets):
                    row[: len(x)] = x
                for i, j in _jaccard_forest(flat, similarity):
                    i, j = (i, j) if pid[s + i] < pid[s + j] else (j, i)
                    found[int(pid[s + i]), int(pid[s + j])] = (*_reach(lists[i], lists[j]), *_reach(lists[j], lists[i]))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*(k + v for k, v in found.items()))], names)

    return cells.repartition("band", "cell").sortWithinPartitions("band", "cell").mapInArrow(links, ", ".join(f"{c} long" for c in names))


def repeated_passages(docs: DataFrame, similarity: float = SIMILARITY) -> tuple[DataFrame, DataFrame]:
    """(repeats, documents).

    repeats: d, h, kind, pos, n, pid and first_d (of the copy that
    stays), for the windows that occur in two documents or more, and the paragraphs of clusters that do. documents:
    d, h, n_words per row.
    """
    all_ = units(docs)
    rows = materialize(all_.where(F.col("kind") == ROW).select("d", "h", F.col("n").alias("n_words")), "substring-rows")
    links = materialize(paragraph_links(docs, all_.where(F.col("kind") == PARAGRAPHS), similarity), "substring-links")
    free_shuffles(docs.sparkSession)
    roots = materialize(connected_components(links).select(F.col("node").alias("pid"), "root"), "substring-roots")
    sig = F.xxhash64("d", "h")
    # in plain longs, so that the aggregation stays in generated code
    many = lambda df, c: df.groupBy(c).agg(F.min("d").alias("first_d"), F.min(sig).alias("s1"), F.max(sig).alias("s2")).where("s1 <> s2").select(c, "first_d")
    same = materialize(many(all_.where("pid is not null"), "pid"), "substring-same")
    free_shuffles(docs.sparkSession)
    wanted = Marks(same.select("pid").union(roots.select("pid")))

    def few(batches):
        for b in batches:
            m = wanted(b.column(4).to_numpy().view(np.uint64))
            yield b.filter(pa.array(m))

    held = all_.where("pid is not null").select("d", "h", "kind", F.coalesce("n", F.lit(SEED)).alias("n"), "pid", "pos").mapInArrow(few, "d long, h long, kind long, n long, pid long, pos long")
    own = materialize(held.join(roots, "pid", "left").join(same, "pid", "left").where("root is not null or first_d is not null"), "substring-own")
    # a paragraph similar to others counts from the first to the last shingle that one of them has too
    ends = links.select(F.explode(F.array(*[F.struct(F.col(c).alias("pid"), F.col(f"{c}0").alias("from"), F.col(f"{c}1").alias("to")) for c in "uv"])).alias("x")).select("x.*")
    ends = ends.groupBy("pid").agg(F.min("from").alias("from"), F.max("to").alias("to"))
    linked = own.where((F.col("kind") == PARAGRAPHS) & F.col("root").isNotNull()).drop("first_d").join(ends, "pid")
    linked = linked.withColumns({"n": F.least(F.col("n"), F.col("to") + SHINGLE) - F.col("from"), "pos": F.col("pos") + F.col("from")})
    repeats = own.where("first_d is not null").unionByName(linked.join(many(linked, "root"), "root"), allowMissingColumns=True)
    repeats = materialize(repeats.select("d", "h", "kind", "pos", "n", "pid", "first_d"), "substring-repeats")
    # the rows of picks and paragraphs are the largest table, and the windows' sides are shuffled next
    discard(own)
    discard(all_)
    free_shuffles(docs.sparkSession)
    return repeats, rows


def _covered(rows: DataFrame, name: str) -> DataFrame:
    """d, h and the number of words that the spans cover."""
    w = Window.partitionBy("d", "h").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    fresh = F.greatest(F.lit(0), F.col("end") - F.greatest("start", F.coalesce(F.max("end").over(w), F.lit(0))))
    return rows.withColumn("_n", fresh).groupBy("d", "h").agg(F.sum("_n").alias(name))


def substring_report(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """Per row of ``docs``: doc_id, n_words, n_repeated, n_removed, component_id, first_docs.

    n_repeated: words in passages that other documents hold too, to the last common word; n_removed:
    those of them that a document of smaller doc_id holds too.
    first_docs: the doc_ids that keep the document's passages, itself among them where it
    does. component_id: the smallest of first_docs, or the document itself if nothing repeats.

    Words are lower-cased runs of letters and digits; null texts and texts without words have no
    paragraphs. Rows without doc_id come last, and one of them keeps a passage only if no
    other row holds it. Rows that agree in doc_id and text count as one document here.
    """
    rep, rows = repeated_passages(docs, similarity)
    rep = extended(docs, rep)
    some = _covered(rep.select("d", "h", "start", "end").distinct(), "n_repeated")
    gone = _covered(rep.where("gone").select("d", "h", "start", "end").distinct(), "n_removed")
    firsts = rep.groupBy("d", "h").agg(F.array_sort(F.collect_set("first")).alias("f"))
    out = rows.join(some, ["d", "h"], "left").join(gone, ["d", "h"], "left").join(firsts, ["d", "h"], "left")
    null = 2**63 - 1
    mine = F.nullif("d", F.lit(null))
    ids = F.coalesce(F.filter("f", lambda x: x != null), F.array().cast("array<long>"))
    return out.select(
        mine.alias("doc_id"), "n_words", F.coalesce("n_repeated", F.lit(0)).alias("n_repeated"), F.coalesce("n_removed", F.lit(0)).alias("n_removed"),
        F.coalesce(F.array_min(ids), mine).alias("component_id"), ids.alias("first_docs"),
    )


def dedup_passages(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """``docs`` with every repeated passage cut out of all texts but its first.

    Null texts and texts without words stay as they are; rows that agree in doc_id and text are one document, so
    neither is cut because of the other; rows without doc_id come last. A text may end up empty, its row stays.
    """
    rep, _ = repeated_passages(docs, similarity)
    cuts = extended(docs, rep).where("gone").groupBy("d", "h").agg(F.collect_set(F.struct("start", "end")).alias("_vl_cut")).withColumnsRenamed({"d": "_vl_d", "h": "_vl_h"})
    d = docs.withColumns({"_vl_d": F.coalesce(F.col("doc_id").cast("long"), F.lit(2**63 - 1)), "_vl_h": F.xxhash64("text")})
    cols = docs.columns
    j = d.join(cuts, ["_vl_d", "_vl_h"], "left").select(*cols, "_vl_cut")
    at = cols.index("text")

    def cut(batches):
        for b in batches:
            texts = []
            for t, c in zip(b.column(at), b.column(len(cols))):
                text, pos = t.as_py(), c.as_py()
                if text is not None and pos:
                    raw = text.encode()
                    s, e, _ = words(raw.lower())
                    gone = np.zeros(len(s) + 1, np.int64)
                    for p in pos:
                        gone[p["start"]] += 1
                        gone[p["end"]] -= 1
                    on = np.flatnonzero(np.diff(np.r_[0, np.cumsum(gone)[:-1] > 0, 0]))
                    out, last = [], 0
                    for x, y in zip(on[::2], on[1::2]):
                        out.append(raw[last : int(s[x])])
                        last = int(e[y - 1])
                    text = b"".join([*out, raw[last:]]).decode()
                texts.append(text)
            arrays = list(b.columns[: len(cols)])
            arrays[at] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays(arrays, names=cols)

    bound_batches(docs.sparkSession)
    return j.mapInArrow(cut, docs.schema)
