"""WARC archives as a PySpark Python data source, for reading and writing.

Writing: every task writes its own archives, one for each record type, one gzip member for each record,
with an index of block offsets and the record type beside each; the driver publishes them when all tasks
have succeeded. Reading: partitions are planned from the indexes (a whole file where there is none),
predicates on record_type and on the header columns are pushed down (archives of other record types are
not opened), and records are read headers first: the payload of a record that the predicates reject, or
that nobody asks for, is stepped over and never decoded.

Paths are folders or files that driver and executors share; schemes other than ``file`` go through
Arrow's file systems.
"""

from __future__ import annotations

import gzip
import json
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, In, InputPartition, IsNotNull, WriterCommitMessage

from quantloom.llm.common import join_hubs, materialize, scratch

VERSION = "WARC/1.1"
#: Raw bytes of records that one index entry, and so one input partition, covers.
BLOCK_BYTES = 32 << 20
SCHEMA = "record_id string, record_type string, target_uri string, date string, refers_to string, payload_digest string, payload_length long, content_type string, payload binary"
#: Columns that come from a header, and its name.
HEADERS = {"record_id": "WARC-Record-ID", "record_type": "WARC-Type", "target_uri": "WARC-Target-URI", "date": "WARC-Date", "refers_to": "WARC-Refers-To", "payload_digest": "WARC-Payload-Digest", "payload_length": "X-Full-Payload-Length", "content_type": "Content-Type"}
#: The revisit profile of the WARC 1.1 standard.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MIN_REVISIT = 100
#: Bytes of a record's headers at most.
MOST_HEADERS = 1 << 20


def _open(path: str):
    """The file system of a path, and the path in it."""
    if "://" in path or path.startswith("file:"):
        scheme, _, rest = path.partition(":")
        if scheme == "file":
            return fs.LocalFileSystem(), "/" + rest.lstrip("/")
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), path


def _escape(value: str) -> str:
    """A header value on one line: control characters and % before hex digits as %XX."""
    return re.sub(r"[\x00-\x1f\x7f]|%(?=[0-9A-Fa-f]{2})", lambda m: f"%{ord(m[0]):02X}", value)


def _unescape(value: str) -> str:
    return re.sub(r"%([01][0-9A-F]|7F|25)", lambda m: chr(int(m[1], 16)), value)


def record(row: dict) -> bytes:
    """A record with its headers, payload and end, uncompressed."""
    payload = row.get("payload") or b""
    lines = [VERSION]
    for column, name in HEADERS.items():
        if (value := row.get(column)) is not None:
            lines.append(f"{name}: {_escape(str(value))}")
    if row.get("record_type") == "revisit":
        lines.append(f"WARC-Profile: {PROFILE}")
    lines.append(f"Content-Length: {len(payload)}")
    return "\r\n".join(lines).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + payload + b"\r\n\r\n"


@dataclass
class _Done(WriterCommitMessage):
    #: (file name, record type, block offsets) of each archive.
    files: list


class _Archive:
    """A file of one record type that a task writes."""

    def __init__(self, store, folder: str):
        self.name = f"part-{uuid.uuid4().hex}.warc.gz"
        self.out = store.open_output_stream(f"{folder}/{self.name}", compression=None)
        self.blocks, self.raw, self.at = [], 0, 0

    def add(self, body: bytes) -> None:
        if not self.blocks or self.raw >= BLOCK_BYTES:
            self.blocks.append(self.at)
            self.raw = 0
        member = gzip.compress(body, 5, mtime=0)
        self.out.write(member)
        self.raw, self.at = self.raw + len(body), self.at + len(member)


class WarcWriter(DataSourceArrowWriter):
    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite = path, overwrite

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        store, root = _open(self.path)
        store.create_dir(f"{root}/_temporary")
        files: dict[str, _Archive] = {}
        for batch in iterator:
            for row in batch.to_pylist():
                kind = row.get("record_type") or ""
                if kind not in files:
                    files[kind] = _Archive(store, f"{root}/_temporary")
                files[kind].add(record(row))
        for f in files.values():
            f.out.close()
        return _Done([(f.name, kind, [*f.blocks, f.at]) for kind, f in files.items()])

    def commit(self, messages) -> None:
        """Publish what succeeded; files of lost or repeated attempts are never moved out. What is overwritten goes last."""
        store, root = _open(self.path)
        old = [i.path for i in store.get_file_info(fs.FileSelector(root)) if re.search(r"\.warc(\.gz)?(\.index)?$", i.path)] if self.overwrite else []
        for name, kind, blocks in (f for m in filter(None, messages) for f in m.files):
            with store.open_output_stream(f"{root}/{name}.index", compression=None) as out:
                out.write(json.dumps({"record_type": kind, "blocks": blocks}).encode())
            store.move(f"{root}/_temporary/{name}", f"{root}/{name}")
        for path in old:
            store.delete_file(path)
        if store.get_file_info(f"{root}/_temporary").type == fs.FileType.Directory:
            store.delete_dir(f"{root}/_temporary")
        store.create_dir(root)

    def abort(self, messages) -> None:
        store, root = _open(self.path)
        if store.get_file_info(f"{root}/_temporary").type == fs.FileType.Directory:
            store.delete_dir(f"{root}/_temporary")


@dataclass
class _Blocks(InputPartition):
    path: str
    begin: int
    end: int | None


class _Bytes:
    """Decompressed bytes of a file from one place to another, read or stepped over."""

    def __init__(self, raw, size: int | None, packed: bool):
        self.raw, self.left, self.packed = raw, size, packed
        self.held, self.inflate = b"", None

    def _more(self) -> bool:
        want = 1 << 18 if self.left is None else min(1 << 18, self.left)
        got = self.raw.read(want) if want else b""
        if not got:
            return False
        if self.left is not None:
            self.left -= len(got)
        out = []
        while got and self.packed:
            self.inflate = self.inflate or zlib.decompressobj(31)
            out.append(self.inflate.decompress(got))
            got = self.inflate.unused_data
            if self.inflate.eof:
                self.inflate = None
        self.held += b"".join(out) if self.packed else got
        return True

    def until(self, mark: bytes) -> bytes | None:
        """Bytes up to and with a mark; None at the end."""
        seen = 0
        while (k := self.held.find(mark, seen)) < 0:
            seen = max(0, len(self.held) - len(mark))
            if seen > MOST_HEADERS:
                raise ValueError(f"headers of over {MOST_HEADERS} bytes")
            if not self._more():
                return None
        out, self.held = self.held[: k + len(mark)], self.held[k + len(mark) :]
        return out

    def take(self, n: int, keep: bool) -> bytes | None:
        out = []
        while n:
            if not self.held and not self._more():
                raise ValueError("a record is cut off")
            part, self.held = self.held[:n], self.held[n:]
            n -= len(part)
            if keep:
                out.append(part)
        return b"".join(out) if keep else None


class WarcReader(DataSourceReader):
    def __init__(self, path: str, columns: list[str]):
        self.path, self.columns, self.rules = path, columns, []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Take equality and membership on header columns; all others are Spark's."""
        for f in filters:
            column = f.attribute[0] if isinstance(f, (EqualTo, In, IsNotNull)) and len(f.attribute) == 1 else None
            if column not in HEADERS or column == "payload_length":
                yield f
            else:
                self.rules.append((column, None if isinstance(f, IsNotNull) else {f.value} if isinstance(f, EqualTo) else set(f.value)))

    def partitions(self) -> list[InputPartition]:
        store, root = _open(self.path)
        info = store.get_file_info(root)
        found = [info] if info.type == fs.FileType.File else store.get_file_info(fs.FileSelector(root, recursive=True))
        names = {i.path for i in found}
        out = []
        for i in sorted(found, key=lambda i: i.path):
            if not re.search(r"\.warc(\.gz)?$", i.path) or "/_temporary/" in i.path:
                continue
            if f"{i.path}.index" in names:
                with store.open_input_stream(f"{i.path}.index", compression=None) as f:
                    index = json.loads(f.read())
                at = index["blocks"]
                if any(c == "record_type" and v is not None and index["record_type"] not in v for c, v in self.rules):
                    continue
                out += [_Blocks(i.path, a, b) for a, b in zip(at[:-1], at[1:], strict=True) if b > a]
            elif i.size:
                out.append(_Blocks(i.path, 0, None))
        return out or [_Blocks("", 0, 0)]

    def read(self, partition: _Blocks) -> Iterator[pa.RecordBatch]:
        if not partition.path:
            return
        store, _ = _open(self.path)
        rows, held = [], 0
        with store.open_input_file(partition.path) as raw:
            raw.seek(partition.begin)
            size = None if partition.end is None else partition.end - partition.begin
            for row in self._records(_Bytes(raw, size, partition.path.endswith(".gz"))):
                rows.append(row)
                held += len(row.get("payload") or b"") + 512
                if held > 4 << 20:
                    yield self._batch(rows)
                    rows, held = [], 0
        if rows:
            yield self._batch(rows)

    def _batch(self, rows: list[dict]) -> pa.RecordBatch:
        kinds = {"payload": pa.binary(), "payload_length": pa.int64()}
        return pa.RecordBatch.from_arrays([pa.array([r.get(c) for r in rows], kinds.get(c, pa.string())) for c in self.columns], self.columns)

    def _records(self, data: _Bytes) -> Iterator[dict]:
        while (head := data.until(b"\r\n\r\n")) is not None:
            if not head.strip():  # the end of the record before
                continue
            lines = head.decode("utf-8", "surrogatepass").lstrip("\r\n").split("\r\n")
            if not lines[0].startswith("WARC/"):
                raise ValueError(f"no WARC record at {lines[0][:40]!r}")
            named = {}
            for line in lines[1:]:
                name, colon, value = line.partition(":")
                if colon:
                    named[name.strip().lower()] = value.strip()
            row = {c: _unescape(named[h.lower()]) if h.lower() in named else None for c, h in HEADERS.items()}
            n = int(named.get("content-length", 0))
            if row["payload_length"] is not None:
                row["payload_length"] = int(row["payload_length"])
            good = all(row[c] is not None and (v is None or row[c] in v) for c, v in self.rules)
            payload = data.take(n, good and "payload" in self.columns)
            if good:
                yield row | {"payload": payload}


class WarcDataSource(DataSource):
    """``spark.read.format("warc").load(path)`` and ``df.write.format("warc").mode(...).save(path)``."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return WarcReader(self.options["path"], [f.name for f in schema])

    def writer(self, schema, overwrite: bool) -> WarcWriter:
        return WarcWriter(self.options["path"], overwrite)


def register(spark: SparkSession) -> None:
    """Make the format known to a session, with pushed-down filters."""
    spark.dataSource.register(WarcDataSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def _page_id(column: str):
    return F.nullif(F.regexp_extract(column, r"^<urn:page:(-?\d+)>$", 1), F.lit("")).cast("long")


def archive_pages(pages: DataFrame, path: str) -> None:
    """Write a record for each page; of equal payloads of 100 bytes or more, all but the smallest page_id's are revisits."""
    raw = F.encode(F.coalesce("html", F.lit("")), "utf-8")
    rows = pages.select("page_id", "url", raw.alias("payload"))
    digest = F.sha2("payload", 256)
    known = materialize(rows.select("page_id", digest.alias("digest"), F.length("payload").alias("length")).where(F.col("length") >= MIN_REVISIT), "payloads")
    first = materialize(known.groupBy("digest").agg(F.min("page_id").alias("first"), F.max("page_id").alias("last"), F.count(F.lit(1)).alias("n")).where("first < last").drop("last"), "first")
    later = join_hubs(known, first, ["digest"]).where("page_id > first").select("page_id", "digest", "first").distinct()
    revisit = F.col("first").isNotNull()
    urn = lambda c: F.concat(F.lit("<urn:page:"), F.col(c).cast("string"), F.lit(">"))
    out = rows.withColumn("digest", digest).join(later, ["page_id", "digest"], "left").select(
        urn("page_id").alias("record_id"),
        F.when(revisit, "revisit").otherwise("response").alias("record_type"),
        F.col("url").alias("target_uri"),
        F.lit("1970-01-01T00:00:00Z").alias("date"),
        F.when(revisit, urn("first")).alias("refers_to"),
        F.concat(F.lit("sha256:"), "digest").alias("payload_digest"),
        F.length("payload").cast("long").alias("payload_length"),
        F.lit("text/html; charset=utf-8").alias("content_type"),
        F.when(~revisit, F.col("payload")).alias("payload"),
    )
    register(pages.sparkSession)
    out.write.format("warc").mode("append").save(path)


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """What the archives say of each page; a response's length and digest are those of the payload as read."""
    register(spark)
    load = lambda: spark.read.format("warc").load(path)  # noqa: E731  a scan keeps the predicates that were pushed to it first
    response = load().where("record_type = 'response'").select(_page_id("record_id").alias("page_id"), F.length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_digest"), "record_type", F.lit(None).cast("long").alias("refers_to"))
    revisit = load().where("record_type = 'revisit'").select(_page_id("record_id").alias("page_id"), F.col("payload_length").alias("payload_bytes"), F.regexp_replace("payload_digest", "^sha256:", "").alias("payload_digest"), "record_type", _page_id("refers_to").alias("refers_to"))
    return response.unionByName(revisit)


def warc_round_trip(pages: DataFrame) -> DataFrame:
    """Write all pages to archives in the shared folder and read them back: page_id, payload_bytes, payload_digest, record_type, refers_to.

    Needs page_id (integers), url and html; null html is an empty payload, a null url is left out,
    control characters in urls are escaped. Each row is one record: repeated rows are repeated, a
    payload that one page_id has twice is a response both times if no smaller page_id has it, and a row
    of null page_id is a response with a null page_id that no revisit refers to. A revisit record has no payload of its own:
    its length and digest are those of its headers. Reading revisits decodes no payload. Empty
    payloads and those under 100 bytes are all responses. An empty table gives an empty table.
    """
    path = scratch(pages.sparkSession, "warc")
    archive_pages(pages.select("page_id", "url", "html"), path)
    return read_pages(pages.sparkSession, path)


