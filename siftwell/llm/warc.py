"""WARC archives (operator 1): a Python data source that writes and reads them, with payload deduplication.

Compressed files hold one gzip member a record. The members this module writes carry the skip lengths of the
WARC standard's annex on compression (extra field ``sl``), so a reader that has seen a record's headers jumps
over an unwanted payload without inflating it.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, In, InputPartition, IsNotNull, StringStartsWith, WriterCommitMessage

from siftwell.llm.common import shared_dir, spread, table, written

#: Payload bytes from which equal payloads are written once and revisited.
LEAST_BYTES = 1000
#: Bytes that a file is closed after, bytes of files that a read partition holds at least, and a read's step.
FILE_BYTES, PARTITION_BYTES, STEP = 1 << 30, 32 << 20, 1 << 16
#: Repeated payloads up to which their digests are broadcast, about 60 bytes each.
SENT_ROWS = 1 << 20
SCHEMA = "record_id string, record_type string, target_uri string, refers_to string, payload_digest string, payload_bytes long, headers map<string,string>, payload binary"
REVISIT = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"
NAMES = {"record_type": "warc-type", "target_uri": "warc-target-uri", "record_id": "warc-record-id", "refers_to": "warc-refers-to"}


def clean(value: str) -> str:
    return value.replace("\r", "%0D").replace("\n", "%0A")


def record(kind: str, record_id: str, uri: str | None, payload: bytes, digest: str, refers_to: str | None, date: str) -> bytes:
    """One record: a response with its HTTP head and payload, or a revisit with the head alone."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head if kind == "revisit" else head + payload
    fields = [("WARC-Type", kind), ("WARC-Record-ID", f"<{record_id}>"), ("WARC-Date", date), ("Content-Type", "application/http; msgtype=response"), ("WARC-Payload-Digest", f"sha1:{digest}"), ("X-Payload-Length", str(len(payload)))]
    if uri is not None:
        fields.append(("WARC-Target-URI", clean(uri)))
    if refers_to is not None:
        fields += [("WARC-Refers-To", f"<{refers_to}>"), ("WARC-Profile", REVISIT)]
    fields.append(("Content-Length", str(len(block))))
    return b"WARC/1.0\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields).encode() + b"\r\n" + block + b"\r\n\r\n"


def member(data: bytes) -> bytes:
    """A gzip member with skip lengths: its own size and that of its content."""
    deflate = zlib.compressobj(6, zlib.DEFLATED, -15)
    body = deflate.compress(data) + deflate.flush()
    size = 10 + 2 + 12 + len(body) + 8
    extra = b"sl" + struct.pack("<HII", 8, size, len(data)) if max(size, len(data)) < 1 << 32 else b""  # longer ones have none
    return b"\x1f\x8b\x08\x04\0\0\0\0\0\xff" + struct.pack("<H", len(extra)) + extra + body + struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)


class Plain:
    """Sequential reads and jumps in an uncompressed file."""

    def __init__(self, file):
        self.file, self.at, self.size = file, 0, file.size()

    def until(self, mark: bytes) -> bytes:
        """Bytes up to and with ``mark``, empty at the end."""
        found = b""
        while mark not in found:
            self.file.seek(self.at + len(found))
            more = self.file.read(4096)
            if not more:
                return b""
            found += more
        found = found[: found.index(mark) + len(mark)]
        self.at += len(found)
        return found

    def take(self, n: int) -> bytes:
        self.file.seek(self.at)
        self.at += n
        return self.file.read(n)

    def finish(self, n: int) -> None:
        self.at += n + 4

    def more(self) -> bool:
        return self.at < self.size


class Members:
    """The same of a file of gzip members, of one record or several each.

    ``finish`` jumps to the next member where skip lengths tell that the record is the last of its own.
    """

    def __init__(self, file):
        self.file, self.at, self.size = file, 0, file.size()
        self.inflate = None

    def open(self) -> None:
        self.file.seek(self.at)
        head = self.file.read(12)
        if head[:2] != b"\x1f\x8b":
            raise ValueError(f"no gzip member at byte {self.at}")
        flags, skip, self.next, self.whole = head[3], 10, None, None
        if flags & 4:
            extra = self.file.read(n := struct.unpack("<H", head[10:12])[0])
            skip = 12 + n
            while len(extra) >= 4:
                k = struct.unpack("<H", extra[2:4])[0]
                if extra[:2] == b"sl" and k == 8:
                    packed, self.whole = struct.unpack("<II", extra[4:12])
                    self.next = self.at + packed
                extra = extra[4 + k :]
        if flags & 24:  # a name or a comment, each up to a zero byte
            self.file.seek(self.at + skip)
            rest = self.file.read(STEP)
            for _ in range(bin(flags & 24).count("1")):
                cut = rest.index(b"\0") + 1
                skip, rest = skip + cut, rest[cut:]
        self.file.seek(self.at + skip + (2 if flags & 2 else 0))  # the header's own checksum
        self.inflate, self.done, self.used = zlib.decompressobj(-15), bytearray(), 0

    def grow(self) -> bool:
        if self.inflate.eof:
            return False
        data = self.inflate.unconsumed_tail or self.file.read(STEP)
        if not data:
            raise ValueError("a gzip member is cut short")
        self.done += self.inflate.decompress(data, STEP)
        return True

    def until(self, mark: bytes) -> bytes:
        if self.inflate is None:
            self.open()
        while mark not in self.done:
            if not self.grow():
                return b""
        return self.take(self.done.index(mark) + len(mark))

    def take(self, n: int) -> bytes:
        while len(self.done) < n and self.grow():
            pass
        found = bytes(self.done[:n])
        del self.done[:n]
        self.used += len(found)
        return found

    def finish(self, n: int) -> None:
        if self.next is not None and self.whole == self.used + n + 4:
            self.at, self.inflate = self.next, None
            return
        left = n + 4
        while left and (self.done or self.grow()):
            left -= len(self.take(min(left, STEP, len(self.done))))

    def more(self) -> bool:
        if self.inflate is not None:
            while not self.done and self.grow():
                pass
            if self.done:
                return True
            self.at = self.file.tell() - len(self.inflate.unused_data) + 8 if self.next is None else self.next
            self.inflate = None
        return self.at < self.size


def hex_digest(value: str | None) -> str | None:
    """A payload's SHA-1 in hexadecimal, whether the header has it so or in base 32; other digests as they are."""
    bare = (value or "").removeprefix("sha1:")
    if re.fullmatch("[A-Z2-7]{32}", bare):
        return base64.b32decode(bare).hex()
    return bare or None


def records(file, compressed: bool, wanted, payload: str) -> Iterator[tuple]:
    """Rows of SCHEMA of a file's records whose headers ``wanted`` accepts.

    Headers are parsed first; the block of an unwanted record, and of any with ``payload`` "skip", is jumped
    over. "digest" computes SHA-1 and length of the payload and drops it, "keep" returns it too.
    """
    source = Members(file) if compressed else Plain(file)
    while source.more():
        lines = source.until(b"\r\n\r\n").decode("utf-8", "replace").split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no WARC record at byte {source.at}")
        headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:] if x)}
        length = int(headers.get("content-length", 0))
        if not wanted(headers):
            source.finish(length)
            continue
        digest, size, body = hex_digest(headers.get("warc-payload-digest")), headers.get("x-payload-length"), None
        if payload != "skip" and headers.get("warc-type") != "revisit":
            body = source.take(length)
            source.finish(0)
            if headers.get("content-type", "").startswith("application/http"):
                body = body.partition(b"\r\n\r\n")[2]
            digest, size = hashlib.sha1(body).hexdigest(), len(body)
        else:
            source.finish(length)
        bare = lambda k: headers[k].strip("<>") if k in headers else None
        yield bare("warc-record-id"), headers.get("warc-type"), headers.get("warc-target-uri"), bare("warc-refers-to"), digest, int(size) if size is not None else None, headers, body if payload == "keep" else None


@dataclass
class Files(InputPartition):
    names: list[str]


@dataclass
class Done(WriterCommitMessage):
    names: list[str]


class WarcReader(DataSourceReader):
    def __init__(self, options: dict):
        self.options, self.tests = options, []

    def pushFilters(self, filters: list[Filter]):
        """Takes filters on the record type and the headers that stand in columns of their own."""
        for f in filters:
            if isinstance(f, (EqualTo, In, StringStartsWith)) and len(f.attribute) == 1 and f.attribute[0] in ("record_type", "target_uri"):
                self.tests.append((type(f).__name__, NAMES[f.attribute[0]], f.value if not isinstance(f, EqualTo) else (f.value,)))
            elif isinstance(f, IsNotNull) and f.attribute == ("record_type",):
                pass
            else:
                yield f

    def partitions(self) -> list[Files]:
        """Plans files, several small ones in a partition; a compressed file can't be split."""
        store, path = pafs.FileSystem.from_uri(self.options["path"])
        found = [x for x in store.get_file_info(pafs.FileSelector(path, recursive=True)) if x.is_file and x.path.endswith((".warc", ".warc.gz"))]
        parts: list[list[str]] = []
        size = PARTITION_BYTES
        for x in sorted(found, key=lambda x: x.path):
            if size >= PARTITION_BYTES:
                parts.append([])
                size = 0
            parts[-1].append(x.path)
            size += x.size
        return [Files(p) for p in parts] or [Files([])]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        store, _ = pafs.FileSystem.from_uri(self.options["path"])
        types = {x for x in self.options.get("recordtypes", "").split(",") if x}

        def wanted(headers: dict) -> bool:
            if types and headers.get("warc-type") not in types:
                return False
            for kind, name, value in self.tests:
                own = headers.get(name)
                if own is None or (not own.startswith(value) if kind == "StringStartsWith" else own not in value):
                    return False
            return True

        kinds = pa.schema([(n, pa.string()) for n in ("record_id", "record_type", "target_uri", "refers_to", "payload_digest")] + [("payload_bytes", pa.int64()), ("headers", pa.map_(pa.string(), pa.string())), ("payload", pa.binary())])
        keep_headers = self.options.get("headers", "true") == "true"
        rows: list[tuple] = []
        size = 0

        def batch() -> pa.RecordBatch:
            columns = list(zip(*rows))
            columns[6] = [list(h.items()) if keep_headers else None for h in columns[6]]
            return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(columns, kinds)], schema=kinds)

        for name in partition.names:
            with store.open_input_file(name) as file:
                for r in records(file, name.endswith(".gz"), wanted, self.options.get("payload", "keep")):
                    rows.append(r)
                    size += len(r[7] or b"") + 500
                    if len(rows) >= 1024 or size > 16 << 20:
                        yield batch()
                        rows, size = [], 0
        if rows:
            yield batch()


class WarcWriter(DataSourceArrowWriter):
    """Writes rows (record_id, record_type, target_uri, refers_to, payload_digest, payload).

    A task writes under a name of its own attempt; only committed files get their final names, so a task that
    is lost and run again leaves nothing behind that a reader sees.
    """

    def __init__(self, options: dict):
        self.options = options

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Done:
        from pyspark import TaskContext

        store, path = pafs.FileSystem.from_uri(self.options["path"])
        store.create_dir(path, recursive=True)
        context, names, out, size = TaskContext.get(), [], None, 0
        zipped = self.options.get("compression", "gzip") == "gzip"
        for batch in iterator:
            for row in batch.to_pylist():
                if out is None or size >= FILE_BYTES:
                    if out is not None:
                        out.close()
                    names.append(f"{path}/part-{context.partitionId():06d}-{len(names):04d}.warc{'.gz' if zipped else ''}.{context.taskAttemptId()}.tmp")
                    out, size = store.open_output_stream(names[-1], compression=None), 0
                data = record(row["record_type"], row["record_id"], row["target_uri"], row["payload"] or b"", row["payload_digest"], row["refers_to"], self.options.get("date", "1970-01-01T00:00:00Z"))
                data = member(data) if zipped else data
                out.write(data)
                size += len(data)
        if out is not None:
            out.close()
        return Done(names)

    def commit(self, messages) -> None:
        store, _ = pafs.FileSystem.from_uri(self.options["path"])
        for name in (n for m in messages if m for n in m.names):
            store.move(name, name.rsplit(".", 2)[0])

    def abort(self, messages) -> None:
        store, _ = pafs.FileSystem.from_uri(self.options["path"])
        for name in (n for m in messages if m for n in m.names):
            store.delete_file(name)


class WarcSource(DataSource):
    """``format("warc")``: see WarcReader and WarcWriter; options payload (keep, digest, skip), headers, recordTypes."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> WarcReader:
        return WarcReader({k.lower(): v for k, v in self.options.items()})

    def writer(self, schema, overwrite: bool) -> WarcWriter:
        return WarcWriter({k.lower(): v for k, v in self.options.items()})


def as_records(pages: DataFrame, least_bytes: int = LEAST_BYTES) -> DataFrame:
    """The rows that WarcWriter takes, one for each row of ``pages`` (page_id, url, html).

    Of the pages with one payload of ``least_bytes`` or more, those with the largest page_id are responses and the
    others revisit it; all others are responses. Rows without a page_id revisit one that has it, repeated rows of the
    largest id are responses all; null html is an empty payload; payloads of any size are kept whole; an empty table gives
    no rows; other columns are ignored, whatever their names. Only hashes are grouped; a payload that many pages share
    adds partial maxima, not rows, to one task. Up to SENT_ROWS repeated payloads are known by a broadcast of their
    digests, so that html stays where it is; more are joined.
    """
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    hashed = pages.select("page_id", "url", payload.alias("payload"), F.sha1(payload).alias("payload_digest"))
    large = F.octet_length("payload") >= least_bytes
    same = written(hashed.where(large).groupBy("payload_digest").agg(F.max("page_id").alias("first"), F.count("*").alias("pages")).where("pages > 1 AND first IS NOT NULL").select("payload_digest", "first"), "same")
    joined = hashed.join(F.broadcast(same) if same.count() <= SENT_ROWS else same, "payload_digest", "left")
    again = large & F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    urn = lambda c: F.concat(F.lit("urn:page:"), F.coalesce(c.cast("string"), F.lit("none")))
    return joined.select(urn(F.col("page_id")).alias("record_id"), F.when(again, "revisit").otherwise("response").alias("record_type"), F.col("url").alias("target_uri"), F.when(again, urn(F.col("first"))).alias("refers_to"), "payload_digest", "payload")


def archive(pages: DataFrame, path: str, least_bytes: int = LEAST_BYTES, compression: str = "gzip") -> None:
    """Writes a record for each row of ``pages`` to WARC files below ``path``; null html is an empty payload."""
    spark = pages.sparkSession
    spark.dataSource.register(WarcSource)
    as_records(pages, least_bytes).write.format("warc").option("compression", compression).mode("append").save(path)


def read_archive(spark: SparkSession, path: str, **options: str) -> DataFrame:
    """The records of the WARC files below ``path``; turns on filter pushdown to Python sources in the session."""
    spark.dataSource.register(WarcSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark.read.format("warc").options(**options).load(path)


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of every page, read back from archives.

    Pages without an id come back with a null one, as do references to none; repeated pages give repeated records.
    """
    path = shared_dir(spark, "warc")
    archive(spread(table(spark, sf_dir, "pages")), path)
    found = read_archive(spark, path, payload="digest", headers="false")
    page = lambda c: F.substring_index(c, ":", -1).try_cast("long")
    return found.select(page(F.col("record_id")).alias("page_id"), "payload_bytes", "payload_digest", "record_type", page(F.col("refers_to")).alias("refers_to"))


ORACLE = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, strlen(coalesce(html, '')) AS n, max(page_id) OVER (PARTITION BY coalesce(html, '')) AS first FROM pages)
SELECT page_id, n::BIGINT AS payload_bytes, sha1(html) AS payload_digest,
       CASE WHEN n >= 1000 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= 1000 AND page_id <> first THEN first END AS refers_to
FROM p
"""
