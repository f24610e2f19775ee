"""WARC archives as a Spark data source, and the archive of a page table with revisit records.

Writing: each task writes files of gzip members, one member per record and ``FILE_BYTES`` per file or a
little more, and the driver commits a manifest that names the files of the attempts that counted.  Every member carries its compressed and
its full length in a gzip extra field, so a reader can step over it without inflating it.

Reading: files, plain or gzip, are planned into partitions by size.  Predicates on record type and other headers are
pushed down; a record's headers are inflated and parsed first, and its payload is inflated only if the
record is wanted and the ``payload`` option asks for it ("read", "verify" or "skip").
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
    EqualNullSafe,
    EqualTo,
    Filter,
    In,
    InputPartition,
    IsNotNull,
    IsNull,
    StringContains,
    StringEndsWith,
    StringStartsWith,
    WriterCommitMessage,
)

from chronolane.llm.base import Workspace, fresh

SCHEMA = "record_id string, type string, target_uri string, date string, payload_digest string, refers_to string, payload_length long, payload binary"
HEADERS = {"record_id": "WARC-Record-ID", "type": "WARC-Type", "target_uri": "WARC-Target-URI", "date": "WARC-Date", "payload_digest": "WARC-Payload-Digest", "refers_to": "WARC-Refers-To"}
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "1970-01-01T00:00:00Z"
MANIFEST = "_manifest.json"
PARTITION_BYTES = 64 << 20
FILE_BYTES = 64 << 20
_STEP = 1 << 14


def _filesystem(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path: plain paths and any URI that pyarrow knows (file, hdfs, s3, gs)."""
    return fs.FileSystem.from_uri(re.sub(r"^file:/(?!/)", "file:///", path) if ":" in path else f"file://{path}")


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _clean(value: str) -> str:
    """A header value without line breaks."""
    return re.sub(r"[\r\n]", lambda m: f"%{ord(m[0]):02X}", value)


def encode_record(row: dict) -> bytes:
    """One record; a revisit has the HTTP head of its payload but not the payload."""
    payload = row["payload"] or b""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {row['payload_length']}\r\n\r\n".encode()
    lines = ["WARC/1.1", *(f"{name}: {_clean(row[c])}" for c, name in HEADERS.items() if row[c] is not None)]
    if row["type"] == "revisit":
        lines.append(f"WARC-Profile: {PROFILE}")
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(head) + len(payload)}", "", ""]
    return "\r\n".join(lines).encode() + head + payload + b"\r\n\r\n"


def gzip_member(record: bytes, level: int = 6) -> bytes:
    """A gzip member whose extra field "sl" holds its own length and the record's (0 where they don't fit)."""
    packer = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = packer.compress(record) + packer.flush()
    total = 10 + 2 + 12 + len(body) + 8
    fit = total < 1 << 32 and len(record) < 1 << 32
    extra = b"sl" + struct.pack("<HII", 8, total if fit else 0, len(record) if fit else 0)
    tail = struct.pack("<II", zlib.crc32(record), len(record) & 0xFFFFFFFF)
    return b"\x1f\x8b\x08\x04\0\0\0\0\0\xff" + struct.pack("<H", len(extra)) + extra + body + tail


class _Member:
    """One gzip member of an open file, inflated as far as asked."""

    def __init__(self, file, at: int):
        self.file, self.at = file, at
        file.seek(at)
        fixed = file.read(12)
        self.ended = len(fixed) < 12
        if self.ended:
            return
        self.length = 0
        if fixed[:2] == b"\x1f\x8b" and fixed[3] & 4:
            extra = file.read(struct.unpack("<H", fixed[10:12])[0])
            if extra[:2] == b"sl":
                self.length = struct.unpack("<I", extra[4:8])[0]
        file.seek(at)
        self.inflater, self.data, self.read = zlib.decompressobj(31), b"", 0

    def more(self) -> bool:
        if self.inflater.eof:
            return False
        raw = self.file.read(_STEP)
        if not raw:
            raise ValueError(f"record at {self.at} is cut off")
        self.read += len(raw)
        self.data += self.inflater.decompress(raw)
        return True

    def until(self, mark: bytes, start: int = 0) -> int:
        """Position after a mark, inflating no more than needed."""
        while (found := self.data.find(mark, start)) < 0:
            if not self.more():
                raise ValueError(f"record at {self.at} has no end of headers")
        return found + len(mark)

    def upto(self, size: int | None) -> bytes:
        """At least ``size`` bytes of the record, all of it for None."""
        parts, have = [self.data], len(self.data)
        while not self.inflater.eof and (size is None or have < size):
            raw = self.file.read(_STEP)
            if not raw:
                raise ValueError(f"record at {self.at} is cut off")
            self.read += len(raw)
            parts.append(self.inflater.decompress(raw))
            have += len(parts[-1])
        self.data = b"".join(parts)
        return self.data

    def end(self, size: int) -> int:
        """Where the next member begins; stepping over what wasn't inflated if the length is known."""
        if self.length:
            return self.at + self.length
        self.upto(None)
        return self.at + self.read - len(self.inflater.unused_data)


class _Plain:
    """One record of an open file that isn't compressed, read as far as asked."""

    def __init__(self, file, at: int):
        self.file, self.at, self.data = file, at, b""
        file.seek(at)
        self.ended = not self.more()

    def more(self) -> bool:
        raw = self.file.read(_STEP)
        self.data += raw
        return bool(raw)

    def until(self, mark: bytes, start: int = 0) -> int:
        while (found := self.data.find(mark, start)) < 0:
            if not self.more():
                raise ValueError(f"record at {self.at} has no end of headers")
        return found + len(mark)

    def upto(self, size: int) -> bytes:
        if len(self.data) < size:
            self.data += self.file.read(size - len(self.data))
        if len(self.data) < size:
            raise ValueError(f"record at {self.at} is cut off")
        return self.data

    def end(self, size: int) -> int:
        return self.at + size + 4


def _record(file, at: int) -> _Member | _Plain:
    file.seek(at)
    return _Member(file, at) if file.read(2) == b"\x1f\x8b" else _Plain(file, at)


def _fields(head: bytes) -> dict[str, str]:
    pairs = (line.partition(":") for line in head.decode("utf-8", "replace").split("\r\n")[1:] if line)
    return {k.strip().lower(): v.strip() for k, _, v in pairs}


def read_records(file, wanted, payload: str) -> Iterator[dict]:
    """Records of an open archive; ``wanted`` decides on the headers, before the payload is inflated."""
    at = 0
    while not (member := _record(file, at)).ended:
        stop = member.until(b"\r\n\r\n")
        named = _fields(member.data[:stop])
        row = {c: named.get(name.lower()) for c, name in HEADERS.items()}
        whole = stop + int(named["content-length"])
        if wanted(row):
            body = member.until(b"\r\n\r\n", stop) if "application/http" in named.get("content-type", "") else stop
            http = _fields(member.data[stop:body])
            size = whole - body
            row["payload_length"] = int(http.get("content-length", size))
            row["payload"] = None
            if payload != "skip" and row["type"] != "revisit":
                content = member.upto(whole)[body:whole]
                if payload == "read":
                    row["payload"] = content
                elif (row["payload_length"], row["payload_digest"]) != (len(content), f"sha1:{base32_sha1(content)}"):
                    raise ValueError(f"record {row['record_id']} doesn't hold the payload that its headers name")
            yield row
        at = member.end(whole)


@dataclass
class Files(InputPartition):
    paths: list[str]


def _test(f: Filter):
    """A predicate on parsed headers for a pushed filter, or None if it can't be decided there."""
    if len(f.attribute) != 1 or f.attribute[0] not in HEADERS:
        return None
    name, value = f.attribute[0], getattr(f, "value", None)
    match f:
        case EqualTo():
            return lambda row: row[name] is not None and row[name] == value
        case EqualNullSafe():
            return lambda row: row[name] == value
        case In():
            return lambda row: row[name] in value and row[name] is not None
        case IsNotNull():
            return lambda row: row[name] is not None
        case IsNull():
            return lambda row: row[name] is None
        case StringStartsWith():
            return lambda row: row[name] is not None and row[name].startswith(value)
        case StringEndsWith():
            return lambda row: row[name] is not None and row[name].endswith(value)
        case StringContains():
            return lambda row: row[name] is not None and value in row[name]
    return None


class WarcReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.payload = options["path"], options.get("payload", "read")
        self.most = int(options.get("partitionBytes", PARTITION_BYTES))
        self.tests: list = []
        if self.payload not in ("read", "verify", "skip"):
            raise ValueError(f"payload: {self.payload}")

    def pushFilters(self, filters: list[Filter]):
        for f in filters:
            if test := _test(f):
                self.tests.append(test)
            else:
                yield f

    def partitions(self) -> list[Files]:
        system, root = _filesystem(self.path)
        listed = {x.base_name: x for x in system.get_file_info(fs.FileSelector(root, allow_not_found=True))}
        if MANIFEST in listed:
            with system.open_input_stream(listed[MANIFEST].path) as f:
                files = [listed[x] for x in json.load(f)]
        else:
            every = system.get_file_info(fs.FileSelector(root, allow_not_found=True, recursive=True))
            files = sorted((x for x in every if x.base_name.endswith((".warc.gz", ".warc"))), key=lambda x: x.path)
        out, room = [], 0
        for x in files:
            if not out or room + x.size > self.most:
                out.append(Files([]))
                room = 0
            out[-1].paths.append(x.path)
            room += x.size
        return out or [Files([])]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        system, _ = _filesystem(self.path)
        wanted = lambda row: all(t(row) for t in self.tests)
        shape = pa.schema([*((c, pa.string()) for c in HEADERS), ("payload_length", pa.int64()), ("payload", pa.binary())])
        for path in partition.paths:
            with system.open_input_file(path) as file:
                rows, held = [], 0
                for row in read_records(file, wanted, self.payload):
                    rows.append(row)
                    held += len(row["payload"] or b"") + 500
                    if held > 4 << 20:
                        yield pa.RecordBatch.from_pylist(rows, shape)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, shape)


@dataclass
class Written(WriterCommitMessage):
    names: list[str]


class WarcWriter(DataSourceArrowWriter):
    def __init__(self, options: dict, overwrite: bool):
        self.path, self.overwrite = options["path"], overwrite
        self.most = int(options.get("fileBytes", FILE_BYTES))

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        system, root = _filesystem(self.path)
        names, out, size = [], None, 0
        try:
            for batch in iterator:
                for k in range(0, batch.num_rows, 256):
                    for row in batch.slice(k, 256).to_pylist():
                        if out is None:
                            system.create_dir(root, recursive=True)
                            names.append(f"part-{uuid.uuid4().hex}.warc.gz")
                            out, size = system.open_output_stream(f"{root}/{names[-1]}", compression=None), 0
                        size += out.write(gzip_member(encode_record(row)))
                        if size >= self.most:
                            out.close()
                            out = None
        except BaseException:
            if out is not None:
                out.close()
            self._remove(names)
            raise
        if out is not None:
            out.close()
        return Written(names)

    def _remove(self, names: list[str]) -> None:
        system, root = _filesystem(self.path)
        for name in names:
            system.delete_file(f"{root}/{name}")

    def commit(self, messages: list[Written | None]) -> None:
        system, root = _filesystem(self.path)
        system.create_dir(root, recursive=True)
        known: list[str] = []
        if not self.overwrite and system.get_file_info(f"{root}/{MANIFEST}").type == fs.FileType.File:
            with system.open_input_stream(f"{root}/{MANIFEST}") as f:
                known = json.load(f)
        with system.open_output_stream(f"{root}/{MANIFEST}", compression=None) as f:
            f.write(json.dumps(known + sorted(x for m in messages if m for x in m.names)).encode())

    def abort(self, messages: list[Written | None]) -> None:
        """Files of tasks that ended go; a failed task removed its own, and no manifest names those of a lost executor."""
        self._remove([x for m in messages if m for x in m.names])


class WarcSource(DataSource):
    """format("warc"): options path, payload ("read", "verify", "skip") and partitionBytes."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> WarcReader:
        return WarcReader(self.options)

    def writer(self, schema, overwrite: bool) -> WarcWriter:
        return WarcWriter(self.options, overwrite)


def register(spark: SparkSession) -> None:
    """Make format("warc") known to a session, with predicates pushed down to it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)


def _urn(id: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), F.coalesce(id.cast("string"), F.lit("")), F.lit(">"))


def page_records(pages: DataFrame, id: str = "page_id", url: str = "url", html: str = "html", least: int = 0) -> DataFrame:
    """A record per page, in the columns of the data source.

    The payload is the html in UTF-8, empty for null.  Of pages with equal payloads of at least
    ``least`` bytes the smallest id is a response and the others revisit it; pages below that are all
    responses.  A null id counts as larger than any other; pages that tie on payload and smallest id are
    all responses, as are equal pages without any id.  Payloads are equal if their SHA-256 and lengths are.
    Other columns, whatever their names, are left out; a very long payload is held whole by its task.  An
    empty table gives no records.
    """
    digest, size, body, n, first, same = fresh(pages, "digest", "size", "body", "n", "first", "same")
    keyed = pages.select(F.col(id), F.col(url), F.coalesce(F.col(html), F.lit("")).cast("binary").alias(body))
    keyed = keyed.withColumn(digest, F.sha1(body)).withColumn(same, F.sha2(body, 256)).withColumn(size, F.length(body).cast("long"))
    groups = keyed.filter(F.col(size) >= least).groupBy(same, size).agg(F.count("*").alias(n), F.min(id).alias(first)).filter(F.col(n) > 1).drop(n)
    # written, so that the join below has an exchange of its own that adaptive execution can split
    groups = Workspace(pages.sparkSession, "warc").table(groups, "groups")
    both = keyed.join(groups, [same, size], "left")
    again = F.col(first).isNotNull() & ~F.col(first).eqNullSafe(F.col(id))
    return both.select(
        _urn(F.col(id)).alias("record_id"),
        F.when(again, "revisit").otherwise("response").alias("type"),
        F.col(url).alias("target_uri"),
        F.lit(DATE).alias("date"),
        F.col(digest).alias("payload_digest"),
        F.when(again, _urn(F.col(first))).alias("refers_to"),
        F.col(size).alias("payload_length"),
        F.when(~again, F.col(body)).alias("payload"),
    ).mapInArrow(_to_base32, SCHEMA)


def _to_base32(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Hexadecimal digests as WARC writes them."""
    for batch in batches:
        new = pa.array([f"sha1:{base64.b32encode(bytes.fromhex(x)).decode()}" for x in batch.column(4).to_pylist()])
        columns = [new if k == 4 else c.cast(pa.string()) if k < 6 else c for k, c in enumerate(batch.columns)]
        yield pa.RecordBatch.from_arrays(columns, batch.schema.names)


def page_id(record: str) -> Column:
    """The page of a record id; null for a page without one."""
    return F.expr(f"try_cast(regexp_extract({record}, '<urn:page:(-?[0-9]*)>', 1) AS BIGINT)")


def read_warc(spark: SparkSession, path: str, payload: str = "read", where: str | Column | None = None) -> DataFrame:
    """The records under ``path``, of the files its manifest names or else of all .warc and .warc.gz files below it.

    ``where`` is pushed down as far as it speaks of headers.  A folder without archives gives no rows.

    Spark keeps pushed predicates with a loaded relation, so every call loads a new one; don't filter
    one loaded DataFrame in two different ways.
    """
    register(spark)
    found = spark.read.format("warc").option("payload", payload).load(path)
    return found if where is None else found.filter(where)


def archive_pages(pages: DataFrame, path: str, **options) -> None:
    """Write the records of a page table to archives under ``path``."""
    register(pages.sparkSession)
    page_records(pages, **options).write.format("warc").mode("append").save(path)
