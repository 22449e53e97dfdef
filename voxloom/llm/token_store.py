"""Token ids in files of fixed-width bit packing, as a PySpark data source.

Each id takes the fewest bits that hold the vocabulary, least significant bit first.
Blocks of :data:`BLOCK` ids start on a byte, and the footer holds the blocks' offsets,
so a range of ids is read by seeking to its blocks and unpacking them with numpy.

    part file: blocks | doc_id int64[] | has_id uint8[] | n_tokens int64[] | offset int64[]
               | JSON footer | its length, uint32 | b"VXTOK1"
    _manifest.json: the part files in order, with the ids and documents of each
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain, islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from .common import bound_batches, scratch_path, trim_memory
from .files import Commit, filesystem
from .words import mix, powers

BLOCK, MAGIC, SUFFIX, FORMAT = 1 << 16, b"VXTOK1", ".tok", "voxloom_tokens"
#: Documents whose digests are handed on together.
READ_ROWS = 10_000


def pack(ids: np.ndarray, bits: int) -> bytes:
    ids = np.asarray(ids, "<u4")
    if bits in (8, 16, 32):  # whole bytes: the same layout, without a detour over single bits
        return ids.astype(f"<u{bits // 8}").tobytes()
    return np.packbits(((ids[:, None] >> np.arange(bits, dtype=np.uint32)) & 1).astype(np.uint8), bitorder="little").tobytes()


def unpack(data: bytes, bits: int, n: int) -> np.ndarray:
    if bits in (8, 16, 32):
        return np.frombuffer(data, f"<u{bits // 8}", n).astype("<u4")
    b = np.unpackbits(np.frombuffer(data, np.uint8), count=n * bits, bitorder="little").reshape(n, bits)
    return (b.astype(np.uint32) << np.arange(bits, dtype=np.uint32)).sum(axis=1, dtype=np.uint32)


_OPEN: dict[tuple[str, bool], "Encoder"] = {}
#: Characters of texts that are looked up together.
SPAN = 3 << 20
#: Chunks of these characters alone are cut into pieces here as the tokenizer's own pattern does.
_PLAIN = re.compile("[^\t-\r -~¡-±´-¸º»¿-ɏ‐-‧€]")
_PIECE = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")


_POWERS = powers(50), np.multiply.accumulate(np.r_[np.uint64(1), np.full(49, 0xD6E8FEB86659FD93, np.uint64)])


def _opens_piece(c: str) -> bool:
    """Whether a piece starts at any space before ``c``: ``c`` is no white space in anyone's view."""
    return "!" <= c <= "~" or c > "\xa0" and not c.isspace() and c not in "\u180e\u200b\ufeff"


class Encoder:
    """Ids by the tokenizers library, as ``encode(text, add_special_tokens=False)`` gives them.

    A byte-level pre-tokenizer starts a piece at each space before a visible character, so a
    text's ids are those of its chunks between such spaces. A batch's texts are cut there,
    each distinct chunk is looked up once, new ones are cut into pieces, and only new pieces
    go to the tokenizer. The ids of :data:`KEPT` chunks and pieces of at most :data:`WIDE` bytes
    are kept in a table of numpy arrays under 96 bits of hash (60 MB a worker at most).
    A text that holds the string of a special token goes to the tokenizer whole, unless
    ``special_as_text`` (their strings are then ordinary text).
    """

    KEPT, WIDE = 1_200_000, 48

    def __init__(self, path: str, special_as_text: bool = False) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        from tokenizers import Tokenizer

        self.t = Tokenizer.from_file(path)
        self.t.encode_special_tokens = special_as_text
        with open(path, encoding="utf-8") as f:
            j = json.load(f)
        pre, added = j.get("pre_tokenizer") or {}, j.get("added_tokens") or []
        self.by_chunk = j.get("normalizer") is None and pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space") and j["model"].get("type") == "BPE" and not j["model"].get("dropout")
        self.by_chunk = self.by_chunk and not any(" " in x["content"] for x in added)
        self.whole = [x["content"] for x in added if not (special_as_text and x.get("special"))]
        vocab = self.t.get_vocab()
        self.bits = max(1, (max(vocab.values())).bit_length())
        # a byte-level token has one character a byte
        self.n_bytes = np.zeros(max(vocab.values()) + 1, np.int64)
        for k, v in vocab.items():
            self.n_bytes[v] = len(k)
        self.ids, self.n_ids, self.n_kept = np.zeros(4096, "<u4"), 0, 0
        self._room(1 << 12)

    @classmethod
    def of(cls, path: str, special_as_text: bool = False) -> "Encoder":
        if (path, special_as_text) not in _OPEN:
            _OPEN[path, special_as_text] = cls(path, special_as_text)
        return _OPEN[path, special_as_text]

    def _each(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids one after another, their number for each text), each encoded on its own."""
        ids = [np.array(e.ids, "<u4") for e in self.t.encode_batch_fast(texts, add_special_tokens=False)]
        return np.concatenate(ids), np.array([len(x) for x in ids])

    def _joined(self, chunks: list[str], between: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, where each chunk's begin, their number) of chunks that piece alike with ``between`` between them.

        They are encoded as one text and parted by the tokens' bytes.
        """
        ids, _ = self._each([between.join(chunks)])
        n = pc.binary_length(pa.array(chunks, pa.large_string())).to_numpy().astype(np.int64) + len(between)
        at = np.r_[0, np.cumsum(self.n_bytes[ids])]
        ends = np.cumsum(n) - len(between)
        first, last = np.searchsorted(at, ends - n + len(between)), np.searchsorted(at, ends)
        if at[-1] == ends[-1] and (at[last] == ends).all() and (at[first] == ends - n + len(between)).all():
            return ids, first, last - first
        ids, size = self._each(chunks)
        return ids, np.cumsum(size) - size, size

    def _room(self, slots: int) -> None:
        """An empty table: two hashes, where the ids begin and their number; the first hash is 0 in a free slot."""
        self.h1, self.h2 = np.zeros(slots, np.uint64), np.zeros(slots, np.uint32)
        self.begin, self.size = np.zeros(slots, np.int32), np.zeros(slots, np.uint8)

    def _hashes(self, keys: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(64 bits, 32 bits, whether the key is short enough to be kept)."""
        off = np.frombuffer(keys.buffers()[1], np.int64, len(keys) + 1, keys.offset * 8)
        raw = np.frombuffer(keys.buffers()[2] or b"", np.uint8)[off[0] : off[-1]].astype(np.uint64) + np.uint64(1)
        n = np.diff(off)
        inside = np.minimum(np.arange(len(raw)) - np.repeat(off[:-1] - off[0], n), self.WIDE)
        sums = [np.r_[np.uint64(0), np.cumsum(raw * p[inside])] for p in _POWERS]
        a, b = (c[off[1:] - off[0]] - c[off[:-1] - off[0]] for c in sums)
        return np.maximum(mix(a + n.astype(np.uint64)), np.uint64(1)), (mix(b) >> np.uint64(32)).astype(np.uint32), n <= self.WIDE

    def _keep(self, ids: np.ndarray, begin: np.ndarray, size: np.ndarray, keys: pa.Array) -> None:
        h1, h2, ok = self._hashes(keys)
        few = np.flatnonzero(ok)[: max(0, self.KEPT - self.n_kept)]
        few = few[np.unique(h1[few], return_index=True)[1]]
        if not len(few):
            return
        while (self.n_kept + len(few)) * 5 > len(self.h1) * 3:
            old = self.h1, self.h2, self.begin, self.size
            self._room(len(self.h1) * 2)
            held = np.flatnonzero(old[0])
            self._put(*(x[held] for x in old))
        own = size[few]
        ids = _gather(ids, begin[few], own)
        while self.n_ids + len(ids) > len(self.ids):
            self.ids = np.r_[self.ids, self.ids * 0]
        self.ids[self.n_ids : self.n_ids + len(ids)] = ids
        self._put(h1[few], h2[few], (self.n_ids + np.cumsum(own) - own).astype(np.int32), own.astype(np.uint8))
        self.n_ids += len(ids)
        self.n_kept += len(few)

    def _put(self, h1: np.ndarray, h2: np.ndarray, begin: np.ndarray, size: np.ndarray) -> None:
        mask = np.uint64(len(self.h1) - 1)
        left, slot = np.arange(len(h1)), h1 & mask
        while len(left):
            free = np.flatnonzero(self.h1[slot] == 0)
            at, first = np.unique(slot[free], return_index=True)
            won = free[first]
            own = left[won]
            self.h1[at], self.h2[at], self.begin[at], self.size[at] = h1[own], h2[own], begin[own], size[own]
            rest = np.ones(len(left), bool)
            rest[won] = False
            left, slot = left[rest], slot[rest] + np.uint64(1) & mask

    def _known(self, keys: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(which have no ids here, where those of the others begin in self.ids, their number)."""
        h1, h2, ok = self._hashes(keys)
        mask, at = np.uint64(len(self.h1) - 1), np.full(len(h1), -1, np.int64)
        left = np.flatnonzero(ok)
        slot = h1[left] & mask
        while len(left):
            there = self.h1[slot]
            hit = (there == h1[left]) & (self.h2[slot] == h2[left])
            at[left[hit]] = slot[hit]
            on = ~hit & (there != 0)
            left, slot = left[on], slot[on] + np.uint64(1) & mask
        return np.flatnonzero(at < 0), np.where(at < 0, 0, self.begin[at]).astype(np.int64), np.where(at < 0, 0, self.size[at]).astype(np.int64)

    def _found(self, chunks: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, where each chunk's begin, their number); the chunks are distinct."""
        new, begin, size = self._known(chunks)
        if not len(new):
            return self.ids, begin, size
        missing = chunks.take(pa.array(new))
        # a text's first chunk, which has no space before it, goes to the library as it is
        cut = [_PIECE.findall(c) if c[:1] == " " and not c[1:].isalpha() and not _PLAIN.search(c) else (c,) for c in missing.to_pylist()]
        pieces = list(dict.fromkeys(chain.from_iterable(cut)))
        fresh, at, many = self._known(pa.array(pieces, pa.large_string()))
        pools, base = [self.ids], len(self.ids)
        kinds: tuple[list[int], list[int], list[int]] = [], [], []
        for i in fresh.tolist():
            p = pieces[i]
            kinds[0 if p[:1] == " " and _opens_piece(p[1:2] or " ") else 1 if p.isalpha() and not _PLAIN.search(p) else 2].append(i)
        kept = []
        for which, between in zip(kinds, ("", "\n", None)):
            if which:
                own = [pieces[i] for i in which]
                if between is None:
                    ids, n = self._each(own)
                    first = np.cumsum(n) - n
                else:
                    ids, first, n = self._joined(own, between)
                at[which], many[which] = base + first, n
                pools.append(ids)
                base += len(ids)
                kept.append((ids, first, n, pa.array(own, pa.large_string())))
        number = dict(zip(pieces, range(len(pieces))))
        flat = np.fromiter(map(number.__getitem__, chain.from_iterable(cut)), np.int64)
        n_pieces = np.fromiter(map(len, cut), np.int64, len(cut))
        start = np.cumsum(n_pieces) - n_pieces
        pool = np.concatenate(pools)
        own = _gather(pool, at[flat], many[flat])
        size[new] = np.add.reduceat(many[flat], start)
        begin[new] = base + np.cumsum(size[new]) - size[new]
        for x in kept:
            self._keep(*x)
        several = np.flatnonzero(n_pieces > 1)
        self._keep(own, begin[new[several]] - base, size[new[several]], missing.take(pa.array(several)))
        return np.concatenate([pool, own]), begin, size

    def _chunked(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids one after another, their number for each text)."""
        lists = pc.split_pattern(pa.array(texts, pa.large_string()), " ")
        first = lists.offsets.to_numpy()[:-1]  # of each text, the chunk with no space before it
        coded = lists.flatten().dictionary_encode()
        code = coded.indices.to_numpy().astype(np.int64)
        heads = pc.utf8_slice_codeunits(coded.dictionary, 0, 1).dictionary_encode()
        opens = np.array([_opens_piece(c or " ") for c in heads.dictionary.to_pylist()], bool)[heads.indices.to_numpy()][code]
        opens[first] = True
        n = len(coded.dictionary)
        # a chunk that opens no piece belongs to the one before it, space and all
        tails: dict[int, list[str]] = {}
        head = np.maximum.accumulate(np.where(opens, np.arange(len(opens)), 0))
        name = lambda at: coded.dictionary.take(pa.array(code[at])).to_pylist()
        loose = np.flatnonzero(~opens)
        for i, c in zip(head[loose].tolist(), name(loose)):
            tails.setdefault(i, []).append(c)
        named: dict[str, int] = {}
        starts = [(f, " ".join([c, *tails.pop(f, ())])) for f, c in zip(first.tolist(), name(first))]
        starts += [(i, " ".join(["", c, *tails[i]])) for i, c in zip(tails, name(list(tails)))]
        for i, key in starts:
            code[i] = n + named.setdefault(key, len(named))
        code = code[opens]
        used = np.zeros(n + len(named), bool)
        used[code] = True
        space = pa.scalar(" ", pa.large_string())
        keys = pc.binary_join_element_wise(space, coded.dictionary.filter(pa.array(used[:n])), pa.scalar("", pa.large_string()))
        pool, begin, size = self._found(pa.concat_arrays([keys, pa.array(list(named), pa.large_string())]))
        code = (np.cumsum(used) - 1)[code]
        n_chunks = np.add.reduceat(opens.astype(np.int64), first)
        each = size[code]
        return _gather(pool, begin[code], each), np.add.reduceat(each, np.cumsum(n_chunks) - n_chunks)

    def _long(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """A text of more than SPAN characters, cut where pieces open."""
        at, out = 0, []
        while at < len(text):
            to = text.find(" ", at + SPAN)
            while to >= 0 and not _opens_piece(text[to + 1 : to + 2] or " "):
                to = text.find(" ", to + 1)
            to = to if to >= 0 else len(text)
            out.append(self._chunked([text[at:to]])[0])
            at = to
        ids = np.concatenate(out)
        return ids, np.array([len(ids)])

    def encode(self, texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For some texts after another: (ids one after another, their number for each text)."""
        i = 0
        while i < len(texts):
            whole = not self.by_chunk or any(x in texts[i] for x in self.whole)
            j, size = i + 1, len(texts[i])
            while not whole and j < len(texts) and size + len(texts[j]) <= SPAN and not any(x in texts[j] for x in self.whole):
                size += len(texts[j])
                j += 1
            yield self._each(texts[i:j]) if whole else self._long(texts[i]) if size > SPAN else self._chunked(texts[i:j])
            i = j


def _gather(pool: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The runs of ``pool`` of these sizes that begin at these places, one after another."""
    where = np.repeat(begin - (np.cumsum(size) - size), size)
    where += np.arange(len(where))
    return pool[where]


@dataclass
class Part(WriterCommitMessage):
    partition: int
    file: str
    n_ids: int
    n_docs: int


def _spans(batches, docs: list[int], has: list[bool]) -> Iterator[list[str]]:
    """Texts of about SPAN characters at a time; their doc_ids are appended to ``docs``, and whether there is one to ``has``."""
    texts, size = [], 0
    for b in batches:
        names = b.schema.names
        for d, t in zip(b.column(names.index("doc_id")).to_pylist(), b.column(names.index("text")).to_pylist()):
            docs.append(d or 0)
            has.append(d is not None)
            texts.append(t or "")
            size += len(texts[-1])
            if size >= SPAN:
                yield texts
                texts, size = [], 0
    if texts:
        yield texts


class TokenWriter(DataSourceArrowWriter):
    """Writes (doc_id, text) batches; texts become ids here, so that ids cross no process."""

    def __init__(self, options: dict, overwrite: bool) -> None:
        self.o, self.commit_to = dict(options), Commit(options["path"], overwrite)

    def write(self, iterator) -> Part:
        from pyspark import TaskContext

        enc, end = Encoder.of(self.o["tokenizer"]), self.o.get("end")
        tail = np.array([int(end)] if end is not None else [], "<u4")
        bits = max([enc.bits, *(int(x).bit_length() for x in tail)])
        fs, name = self.commit_to.attempt(SUFFIX)
        docs, has, sizes, offsets, at, held, n_held, n_ids = [], [], [], [], 0, [], 0, 0
        with fs.open_output_stream(name) as out:

            def flush(last: bool) -> None:
                nonlocal at, held, n_held
                ids, i = np.concatenate(held) if held else np.zeros(0, "<u4"), 0
                while len(ids) - i >= BLOCK or last and i < len(ids):
                    offsets.append(at)
                    out.write(block := pack(ids[i : i + BLOCK], bits))
                    at += len(block)
                    i += BLOCK
                held, n_held = [ids[i:]], max(0, len(ids) - i)

            for texts in _spans(iterator, docs, has):
                for ids, own in enc.encode(texts):
                    ids = np.insert(ids, np.repeat(np.cumsum(own), len(tail)), np.tile(tail, len(own)))
                    sizes += (own + len(tail)).tolist()
                    held.append(ids)
                    n_ids += len(ids)
                    n_held += len(ids)
                    if n_held >= BLOCK * 4:
                        flush(False)
                trim_memory()
            flush(True)
            index = [np.array(docs, "<i8"), np.array(has, np.uint8), np.array(sizes, "<i8"), np.array(offsets, "<i8")]
            for x in index:
                out.write(x.tobytes())
            foot = json.dumps({"bits": bits, "block": BLOCK, "n_ids": n_ids, "n_docs": len(docs), "n_blocks": len(offsets), "index": at}).encode()
            out.write(foot + len(foot).to_bytes(4, "little") + MAGIC)
        ctx = TaskContext.get()
        return Part(ctx.partitionId() if ctx else 0, name, n_ids, len(docs))

    def commit(self, messages) -> None:
        parts = sorted((m for m in messages if m is not None), key=lambda m: m.partition)
        files = self.commit_to.place([m.file for m in parts], SUFFIX)
        fs, root = filesystem(self.o["path"])
        with fs.open_output_stream(f"{root}/_manifest.json") as out:
            out.write(json.dumps([{"file": f.rpartition("/")[2], "n_ids": m.n_ids, "n_docs": m.n_docs} for f, m in zip(files, parts)]).encode())

    def abort(self, messages) -> None:
        self.commit_to.clear()


class TokenFile:
    """Random access to one part file."""

    def __init__(self, path: str) -> None:
        fs, p = filesystem(path)
        self.f = fs.open_input_file(p)
        end = self.f.size()
        self.f.seek(end - 10)
        tail = self.f.read(10)
        if tail[4:] != MAGIC:
            raise ValueError(f"{path} is no token file")
        n = int.from_bytes(tail[:4], "little")
        self.f.seek(end - 10 - n)
        h = json.loads(self.f.read(n))
        self.bits, self.block, self.n_ids, self.n_docs = h["bits"], h["block"], h["n_ids"], h["n_docs"]
        self.f.seek(h["index"])
        raw = self.f.read(end - 10 - n - h["index"])
        a, b = self.n_docs * 8, self.n_docs * 9
        self.doc_id, self.has_id = np.frombuffer(raw[:a], "<i8"), np.frombuffer(raw[a:b], np.uint8)
        self.sizes = np.frombuffer(raw[b : b + a], "<i8")
        self.offsets = np.r_[np.frombuffer(raw[b + a :], "<i8"), h["index"]]
        self.starts = np.r_[0, np.cumsum(self.sizes)]

    def ids(self, start: int, stop: int) -> np.ndarray:
        """ids[start:stop], reading the blocks that hold them and no others."""
        if stop <= start:
            return np.zeros(0, "<u4")
        a, b = start // self.block, (stop - 1) // self.block
        self.f.seek(int(self.offsets[a]))
        data = self.f.read(int(self.offsets[b + 1] - self.offsets[a]))
        out = []
        for k in range(a, b + 1):
            lo, hi = (int(self.offsets[i] - self.offsets[a]) for i in (k, k + 1))
            out.append(unpack(data[lo:hi], self.bits, min(self.block, self.n_ids - k * self.block)))
        return np.concatenate(out)[start - a * self.block : stop - a * self.block]

    def doc(self, i: int) -> np.ndarray:
        return self.ids(int(self.starts[i]), int(self.starts[i + 1]))


class TokenPartition(InputPartition):
    def __init__(self, file: str, base: int) -> None:
        self.file, self.base = file, base


class TokenReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.path, self.with_ids = options["path"], str(options.get("ids", "true")).lower() == "true"

    def partitions(self):
        fs, root = filesystem(self.path)
        with fs.open_input_stream(f"{root}/_manifest.json") as f:
            parts = json.loads(f.read())
        base, out = 0, []
        for p in parts:
            if p["n_docs"]:
                out.append(TokenPartition(f"{self.path.rstrip('/')}/{p['file']}", base))
            base += p["n_ids"]
        return out or [TokenPartition("", 0)]

    def read(self, partition) -> Iterator[tuple]:
        if not partition.file:
            return
        f = TokenFile(partition.file)
        i = 0
        while i < f.n_docs:
            j = max(i + 1, int(np.searchsorted(f.starts, f.starts[i] + 16 * BLOCK, "right")) - 1)
            ids, zero = f.ids(int(f.starts[i]), int(f.starts[j])), int(f.starts[i])
            for k in range(i, j):
                own = ids[int(f.starts[k]) - zero : int(f.starts[k + 1]) - zero]
                yield (int(f.doc_id[k]) if f.has_id[k] else None, partition.base + int(f.starts[k]), len(own), zlib.crc32(own.tobytes()), own.tolist() if self.with_ids else None)
            i = j


class TokenSource(DataSource):
    """Options: path; to write: tokenizer (its JSON file), end (an id after each document); to read: ids (false leaves them out)."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return "doc_id long, start long, n_tokens long, ids_crc32 long, ids array<int>"

    def reader(self, schema) -> TokenReader:
        return TokenReader(self.options)

    def writer(self, schema, overwrite: bool) -> TokenWriter:
        return TokenWriter(self.options, overwrite)


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end: int | None = None) -> None:
    """Write the ids of ``docs`` in ascending doc_id order.

    Rows without doc_id come first; rows of one doc_id stand in the order of their
    texts' hashes. Null texts count as empty and hold the end id alone. An empty table
    gives an empty manifest. Other columns are left out.
    """
    bound_batches(docs.sparkSession)
    options = {"path": path, "tokenizer": tokenizer} | ({"end": str(end)} if end is not None else {})
    writer = TokenWriter(options, False)

    def run(batches):
        part = writer.write(batches)
        yield pa.RecordBatch.from_pylist([vars(part)])

    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.xxhash64("text").alias("h"))
    src = src.repartitionByRange("doc_id", "h").sortWithinPartitions("doc_id", "h").select("doc_id", "text")
    # not through the data source: Spark would keep two Python processes in the driver for each step of its own
    try:
        parts = src.mapInArrow(run, "partition long, file string, n_ids long, n_docs long").collect()  # a row for each file
    except Exception:
        writer.abort([])
        raise
    writer.commit([Part(**r.asDict()) for r in parts])


def read_tokens(spark, path: str, ids: bool = True) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32, ids) per document of a token store."""
    spark.dataSource.register(TokenSource)
    return spark.read.format(FORMAT).option("ids", str(ids).lower()).load(path)


def token_digest(docs: DataFrame, tokenizer: str, end: int | None) -> DataFrame:
    """Write ``docs`` to a store in the shared folder and return its documents' digests."""
    spark = docs.sparkSession
    path = scratch_path(spark, "tokens")
    write_tokens(docs, path, tokenizer, end)
    reader = TokenReader({"path": path, "ids": "false"})

    def run(batches):
        for b in batches:
            for x in b.to_pylist():
                rows = reader.read(TokenPartition(x["file"], x["base"]))
                while some := list(islice(rows, READ_ROWS)):
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in list(zip(*some))[:4]], ["doc_id", "start", "n_tokens", "ids_crc32"])

    files = spark.createDataFrame([(x.file, x.base) for x in reader.partitions()], "file string, base long")
    return files.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")
