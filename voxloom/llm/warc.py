"""WARC files as a PySpark data source, and payload deduplication into revisit records.

Files hold one gzip member per record, each with the ``sl`` extra field of the WARC
annex on compression (compressed and full length), so a reader inflates a record's head,
decides, and seeks past the rest. Members without the field are inflated to their end.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, In, InputPartition, IsNotNull, StringStartsWith, WriterCommitMessage

from .common import bound_batches, materialize, scratch_path
from .files import Commit, filesystem, list_files

FORMAT, SUFFIX = "voxloom_warc", ".warc.gz"
DATE = "1970-01-01T00:00:00Z"
#: Payloads of fewer bytes are never made revisits.
LEAST = 1000
#: Compressed bytes after which a writer starts its next file; a file is one reader's task at least.
ROLL = 256 << 20
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"


def gzip_member(data: bytes, level: int = 5) -> bytes:
    z = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = z.compress(data) + z.flush()
    size = 10 + 2 + 12 + len(body) + 8
    head = b"\x1f\x8b\x08\x04\x00\x00\x00\x00\x00\xff" + struct.pack("<H", 12) + b"sl" + struct.pack("<HII", 8, size & 0xFFFFFFFF, len(data) & 0xFFFFFFFF)
    return head + body + struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)


def _clean(v: str) -> str:
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", v)


def record(kind: str, record_id: str, uri: str | None, refers_to: str | None, digest: str, size: int, payload: bytes, date: str = DATE) -> bytes:
    http = _HTTP % size
    body = http + payload if kind != "revisit" else http
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {record_id}", f"WARC-Date: {date}"]
    if uri is not None:
        head.append(f"WARC-Target-URI: {_clean(uri)}")
    if refers_to:
        head += [f"WARC-Refers-To: {refers_to}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    head += [f"WARC-Payload-Digest: sha1:{digest}", f"X-Payload-Length: {size}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(body)}", "", ""]
    return "\r\n".join(head).encode() + body + b"\r\n\r\n"


@dataclass
class Written(WriterCommitMessage):
    partition: int
    files: list


class WarcWriter(DataSourceArrowWriter):
    """Rows: record_id, record_type, target_uri, refers_to, payload_digest, payload_bytes, payload."""

    def __init__(self, options, overwrite: bool) -> None:
        self.commit_to, self.roll = Commit(options["path"], overwrite), int(options.get("roll", ROLL))

    def write(self, iterator) -> Written:
        from pyspark import TaskContext

        files, out, size = [], None, 0
        for b in iterator:
            col = {n: b.column(i) for i, n in enumerate(b.schema.names)}
            for i in range(b.num_rows):
                v = {n: c[i].as_py() for n, c in col.items()}
                if out is None or size >= self.roll:
                    if out is not None:
                        out.close()
                    fs, name = self.commit_to.attempt(SUFFIX)
                    out, size = fs.open_output_stream(name, compression=None), 0
                    files.append(name)
                data = gzip_member(record(v["record_type"], v["record_id"], v["target_uri"], v["refers_to"], v["payload_digest"], v["payload_bytes"], v["payload"] or b""))
                out.write(data)
                size += len(data)
        if out is not None:
            out.close()
        ctx = TaskContext.get()
        return Written(ctx.partitionId() if ctx else 0, files)

    def commit(self, messages) -> None:
        parts = sorted((m for m in messages if m is not None), key=lambda m: m.partition)
        self.commit_to.place([f for m in parts for f in m.files], SUFFIX)

    def abort(self, messages) -> None:
        self.commit_to.clear()


class _Buffer:
    """A file read forwards, with jumps; holds what is needed of it."""

    def __init__(self, f, size: int) -> None:
        self.f, self.size, self.base, self.data = f, size, 0, b""

    def get(self, at: int, n: int) -> bytes:
        """Up to n bytes from ``at``."""
        if at < self.base or at > self.base + len(self.data):
            self.base, self.data = at, b""
        if at + n > self.base + len(self.data) and self.base + len(self.data) < self.size:
            self.data, self.base = self.data[at - self.base :], at
            self.f.seek(self.base + len(self.data))
            self.data += self.f.read(max(n - len(self.data), 1 << 20))
        return self.data[at - self.base : at - self.base + n]


class _Record:
    """One record: its head first, the rest on demand."""

    def __init__(self, buf: _Buffer, at: int) -> None:
        self.buf, self.at, self.gz = buf, at, buf.get(at, 2) == b"\x1f\x8b"
        self.length = None
        if self.gz:
            h = buf.get(at, 12)
            skip = 10
            if h[3] & 4:
                n = struct.unpack("<H", h[10:12])[0]
                extra, skip = buf.get(at + 12, n), 12 + n
                k = 0
                while k + 4 <= len(extra):
                    size = struct.unpack("<H", extra[k + 2 : k + 4])[0]
                    if extra[k : k + 2] == b"sl" and size == 8:
                        self.length = struct.unpack("<I", extra[k + 4 : k + 8])[0]
                    k += 4 + size
            for flag in (8, 16):
                if h[3] & flag:
                    while buf.get(at + skip, 1) not in (b"\0", b""):
                        skip += 1
                    skip += 1
            self.z, self.next = zlib.decompressobj(-15), at + skip + (2 if h[3] & 2 else 0)
        else:
            self.next = at
        self.text = b""
        while b"\r\n\r\n" not in self.text:
            if not self._more(4096):
                raise ValueError(f"a record at byte {at} has no end of its head")
        head, _, self.text = self.text.partition(b"\r\n\r\n")
        self.head_bytes = len(head) + 4
        lines = head.decode("utf-8", "replace").split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no WARC record at byte {at}")
        self.headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        self.size = int(self.headers.get("content-length", 0))

    def _more(self, n: int) -> bool:
        raw = self.buf.get(self.next, n)
        self.next += len(raw)
        self.text += self.z.decompress(raw) if self.gz else raw
        return bool(raw)

    def block(self) -> bytes:
        while len(self.text) < self.size and not (self.gz and self.z.eof) and self._more(1 << 16):
            pass
        if len(self.text) < self.size:
            raise ValueError(f"the record at byte {self.at} is cut short")
        return self.text[: self.size]

    def end(self) -> int:
        """Where the next record starts; only a member without ``sl`` is inflated for it."""
        if not self.gz:
            return self.at + self.head_bytes + self.size + 4
        if self.length:
            return self.at + self.length
        while not self.z.eof:
            self.text = b""
            if not self._more(1 << 16):
                raise ValueError(f"the record at byte {self.at} is cut short")
        return self.next - len(self.z.unused_data) + 8


class WarcPartition(InputPartition):
    def __init__(self, files: list[tuple[str, int]]) -> None:
        self.files = files


#: Columns that come from a header, and so may be filtered before a payload is decoded.
_HEADER = {"record_type": "warc-type", "record_id": "warc-record-id", "target_uri": "warc-target-uri", "date": "warc-date", "refers_to": "warc-refers-to"}


class WarcReader(DataSourceReader):
    def __init__(self, options) -> None:
        self.path, self.payload = options["path"], options.get("payload", "full")
        self.task_bytes = int(options.get("taskBytes", 64 << 20))
        self.filters: list[tuple[str, str, object]] = []

    def pushFilters(self, filters):
        for f in filters:
            name = f.attribute[0] if getattr(f, "attribute", None) and len(f.attribute) == 1 else None
            kind = {EqualTo: "eq", In: "in", StringStartsWith: "starts", IsNotNull: "some"}.get(type(f))
            if name in _HEADER and kind:
                self.filters.append((_HEADER[name], kind, getattr(f, "value", None)))
            else:
                yield f

    def partitions(self):
        """Whole files, small ones together up to taskBytes."""
        out, now, size = [], [], 0
        for f, n in list_files(self.path, (SUFFIX, ".warc")):
            if now and size + n > self.task_bytes:
                out.append(WarcPartition(now))
                now, size = [], 0
            now.append((f, n))
            size += n
        return [*out, WarcPartition(now)]

    def _wanted(self, h: dict) -> bool:
        for name, kind, value in self.filters:
            x = h.get(name)
            if x is None or kind == "eq" and x != value or kind == "in" and x not in value or kind == "starts" and not x.startswith(value):
                return False
        return True

    def read(self, partition) -> Iterator[tuple]:
        fs, _ = filesystem(self.path)
        for name, size in partition.files:
            with fs.open_input_file(name) as f:
                buf, at = _Buffer(f, size), 0
                while at < size:
                    r = _Record(buf, at)
                    h = r.headers
                    if self._wanted(h):
                        digest, n, payload = h.get("warc-payload-digest", "").removeprefix("sha1:") or None, h.get("x-payload-length"), None
                        if self.payload != "none" and h.get("warc-type") in ("response", "resource", "conversion"):
                            block = r.block()
                            payload = block.partition(b"\r\n\r\n")[2] if h.get("content-type", "").startswith("application/http") else block
                            got = hashlib.sha1(payload).hexdigest()
                            if self.payload == "verify":
                                if digest and digest != got:
                                    raise ValueError(f"{name}: the payload at byte {at} does not match its digest")
                                digest, n, payload = got, len(payload), None
                        yield (h.get("warc-record-id"), h.get("warc-type"), h.get("warc-target-uri"), h.get("warc-date"), h.get("warc-refers-to"), digest, int(n) if n is not None else None, payload, name, at)
                    at = r.end()


class WarcSource(DataSource):
    """Options: path; to read: payload (full; verify: check digests and keep none; none: skip payloads), taskBytes; to write: roll."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return "record_id string, record_type string, target_uri string, date string, refers_to string, payload_digest string, payload_bytes long, payload binary, file string, offset long"

    def reader(self, schema) -> WarcReader:
        return WarcReader(self.options)

    def writer(self, schema, overwrite: bool) -> WarcWriter:
        return WarcWriter(self.options, overwrite)


def read_warc(spark, path: str, payload: str = "full") -> DataFrame:
    """Records of the files under ``path``; filters on record_type, record_id, target_uri, date
    and refers_to (=, IN, prefix, IS NOT NULL) are decided on a record's head."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)
    return spark.read.format(FORMAT).option("payload", payload).load(path)


_URN = "urn:voxloom:page:"


def write_pages(pages: DataFrame, path: str, least: int = LEAST) -> None:
    """Write (page_id, url, html) rows as WARC records, equal payloads once.

    Of the rows whose payloads are equal and have ``least`` bytes or more, those of the
    largest page_id are responses, all others revisit it. Null html is an empty payload;
    a null url leaves out the target; a row without page_id gets a record id of its
    payload's digest and revisits if any equal payload has a page_id. Other columns are ignored.
    """
    spark = pages.sparkSession
    bound_batches(spark)
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    p = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("target_uri"), html.cast("binary").alias("payload"))
    p = p.withColumns({"payload_digest": F.sha1("payload"), "payload_bytes": F.octet_length("payload").cast("long")})
    first = materialize(
        p.where(F.col("payload_bytes") >= least).groupBy("payload_digest", "payload_bytes").agg(F.max("page_id").alias("first"), F.count("*").alias("n")).where("n > 1 and first is not null").drop("n"),
        "warc-first",
    )
    # Spark sends `first` round only if the written table is below its broadcast threshold
    j = p.join(first, ["payload_digest", "payload_bytes"], "left")
    again = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    urn = lambda c: F.concat(F.lit(f"<{_URN}"), F.col(c).cast("string"), F.lit(">"))
    rows = j.select(
        F.coalesce(urn("page_id"), F.concat(F.lit("<urn:sha1:"), "payload_digest", F.lit(">"))).alias("record_id"), F.when(again, "revisit").otherwise("response").alias("record_type"),
        "target_uri", F.when(again, urn("first")).alias("refers_to"), "payload_digest", "payload_bytes", F.when(~again, F.col("payload")).alias("payload"),
    )
    spark.dataSource.register(WarcSource)
    rows.write.format(FORMAT).mode("append").save(path)


def warc_round_trip(pages: DataFrame, least: int = LEAST) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to, target_uri), read back from the archives."""
    path = scratch_path(pages.sparkSession, "warc")
    write_pages(pages, path, least)
    got = read_warc(pages.sparkSession, path, payload="verify")
    page = lambda c: F.expr(f"try_cast(nullif(regexp_extract({c}, '^<{_URN}(-?[0-9]+)>$', 1), '') as bigint)")
    return got.select(page("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", page("refers_to").alias("refers_to"), "target_uri")
