"""Operator 4: WARC archives as a PySpark data source, with identical payloads written once.

``spark.read.format("warc").load(folder)`` gives a row per record; ``df.write.format("warc")`` writes one archive
per task.  Each record is a gzip member of its own whose header carries the member's length (the "sl" field that
the standard recommends).

Reading: the driver plans byte ranges of about ``splitBytes`` over the archives; a record belongs to the range in
which its member starts.  Filters on the record type and on header columns are pushed into the reader.  A member
is inflated up to the end of its WARC headers first; only if these pass the filters is its payload inflated, else
the reader seeks to the next member.  With option ``payload=false`` no payload is inflated at all.

A payload is the body behind the HTTP header of a response record; a revisit record has none, but names the
payload's digest and length and the record that holds it.

:func:`deduplicated` decides the types: of records with equal payloads (SHA-1) of at least ``min_bytes`` bytes the
one with the smallest id is the response and the others revisit it; smaller ones are all responses.  Null payloads
are empty.  Repeated rows with the smallest id are responses all of them; null ids are never the smallest, unless
a payload has no other, and then all of its records are responses.  An empty table writes no archive and reads as
no rows; columns that are not named are ignored.
"""
from __future__ import annotations

import base64
import hashlib
import os
import string
import uuid
import zlib
from dataclasses import dataclass
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, In, InputPartition,
    IsNotNull, IsNull, LessThan, LessThanOrEqual, StringContains, StringEndsWith, StringStartsWith,
    WriterCommitMessage,
)

from qualitas.llm.batches import BATCH_BYTES
from qualitas.llm.token_files import local_path
from qualitas.session import work_folder, written

SCHEMA = pa.schema([("record_id", pa.string()), ("record_type", pa.string()), ("target_uri", pa.string()),
                    ("refers_to", pa.string()), ("payload_digest", pa.string()), ("payload_bytes", pa.int64()),
                    ("payload", pa.binary())])
DDL = ("record_id string, record_type string, target_uri string, refers_to string, payload_digest string, "
       "payload_bytes long, payload binary")
SPLIT_BYTES = 64 << 20
_BLOCK = 1 << 16
_MEMBER = b"\x1f\x8b\x08\x04"                       # gzip, deflate, with an extra field
_END = b"\r\n\r\n"
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
#: Names of the header fields that hold a column (the length is an extension field).
FIELDS = {"record_id": "WARC-Record-ID", "record_type": "WARC-Type", "target_uri": "WARC-Target-URI",
          "refers_to": "WARC-Refers-To", "payload_digest": "WARC-Payload-Digest",
          "payload_bytes": "X-Payload-Length"}
_DATE = "1970-01-01T00:00:00Z"
_REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def base32_column(sha1_hex):
    """Spark's hexadecimal SHA-1 as upper-case base 32: 40 bits are ten digits of the one and eight of the other."""
    digits = [F.lpad(F.conv(F.substring(sha1_hex, at, 10), 16, 32), 8, "0") for at in (1, 11, 21, 31)]
    return F.translate(F.concat(*digits), string.digits + string.ascii_uppercase[:22], string.ascii_uppercase + "234567")


# -- records --------------------------------------------------------------------------------------------------

def member(row: dict) -> bytes:
    """One record as a gzip member that carries its own length."""
    revisit = row["record_type"] == "revisit"
    block = b"" if revisit else _HTTP + (row["payload"] or b"")
    lines = ["WARC/1.1", f"WARC-Type: {row['record_type']}", f"WARC-Record-ID: <{row['record_id']}>",
             f"WARC-Date: {_DATE}", f"WARC-Payload-Digest: sha1:{row['payload_digest']}",
             f"X-Payload-Length: {row['payload_bytes']}"]
    if row["target_uri"] is not None:
        lines.append(f"WARC-Target-URI: {quote(row['target_uri'], safe=string.punctuation.replace('%', ''))}")
    if revisit:
        lines += [f"WARC-Profile: {_REVISIT}", f"WARC-Refers-To: <{row['refers_to']}>"]
    lines += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    raw = "\r\n".join(lines).encode() + _END + block + _END
    squeeze = zlib.compressobj(4, zlib.DEFLATED, -15)
    body = squeeze.compress(raw) + squeeze.flush()
    size = 24 + len(body) + 8
    head = (_MEMBER + bytes(4) + b"\x00\xff" + (12).to_bytes(2, "little") + b"sl" + (8).to_bytes(2, "little")
            + min(size, 0xFFFFFFFF).to_bytes(4, "little") + (len(raw) & 0xFFFFFFFF).to_bytes(4, "little"))
    return head + body + zlib.crc32(raw).to_bytes(4, "little") + (len(raw) & 0xFFFFFFFF).to_bytes(4, "little")


def header_columns(head: bytes) -> dict:
    from urllib.parse import unquote
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:] if ": " in line)
    out = {column: fields.get(name) for column, name in FIELDS.items()}
    for column in ("record_id", "refers_to"):
        out[column] = out[column] and out[column].strip("<>")
    out["target_uri"] = out["target_uri"] and unquote(out["target_uri"])
    out["payload_digest"] = out["payload_digest"] and out["payload_digest"].removeprefix("sha1:")
    out["payload_bytes"] = out["payload_bytes"] and int(out["payload_bytes"])
    return out


class _Member:
    """A gzip member at a file's place, inflated no further than asked."""

    def __init__(self, f, at: int):
        self.f = f
        f.seek(at)
        head = f.read(24)
        self.size = int.from_bytes(head[16:20], "little") if head[12:14] == b"sl" else 0
        self.raw = zlib.decompressobj(31)
        self.data = self.raw.decompress(head, _BLOCK)

    def more(self) -> bool:
        """Inflate about a block more; False at the member's end."""
        if self.raw.eof:
            return False
        feed = self.raw.unconsumed_tail or self.f.read(_BLOCK)
        if not feed:
            raise ValueError("an archive ends within a record")
        self.data += self.raw.decompress(feed, _BLOCK)
        return True

    def head(self) -> bytes | None:
        """The WARC headers, or None if this is no record."""
        while (end := self.data.find(_END)) < 0:
            if len(self.data) >= 5 and self.data[:5] != b"WARC/" or not self.more():
                return None
        return self.data[:end] if self.data[:5] == b"WARC/" else None

    def whole(self) -> bytes:
        blocks = [self.data]
        while not self.raw.eof:
            self.data = b""
            self.more()
            blocks.append(self.data)
        return b"".join(blocks)

    def length(self, at: int) -> int:
        """The member's length in the file."""
        if self.size and self.size < 0xFFFFFFFF:
            return self.size
        while self.more():
            self.data = b""
        return self.f.tell() - len(self.raw.unused_data) - at


def members(path: str, start: int, stop: int, wanted, with_payload: bool):
    """Rows of the records that start in a byte range of an archive and whose headers are ``wanted``."""
    with open(path, "rb") as f:
        at = start
        if start:                                   # the first member at or behind the start
            at = _next_member(f, start, stop)
        while at is not None and at < stop:
            one = _Member(f, at)
            head = one.head()
            if head is None:
                raise ValueError(f"{path}: no record at {at}")
            row = header_columns(head)
            if wanted(row):
                row["payload"] = None
                if with_payload and row["record_type"] != "revisit":
                    block = one.whole()[len(head) + 4:-4]
                    row["payload"] = block[block.index(_END) + 4:]
                yield row
            at += one.length(at)


def _next_member(f, start: int, stop: int) -> int | None:
    at = start
    while at < stop:
        f.seek(at)
        window = f.read(_BLOCK + len(_MEMBER) - 1)
        found = window.find(_MEMBER)
        if found < 0:
            at += _BLOCK
            continue
        at += found
        try:
            if at < stop and _Member(f, at).head() is not None:
                return at
        except (zlib.error, ValueError):
            pass                                    # these bytes only look like a member's start
        at += 1
    return None


# -- the data source ------------------------------------------------------------------------------------------

#: Tests of header columns that the reader answers itself.
_TESTS = {
    EqualTo: lambda v, f: v is not None and v == f.value, In: lambda v, f: v is not None and v in f.value,
    IsNotNull: lambda v, f: v is not None, IsNull: lambda v, f: v is None,
    GreaterThan: lambda v, f: v is not None and v > f.value, LessThan: lambda v, f: v is not None and v < f.value,
    GreaterThanOrEqual: lambda v, f: v is not None and v >= f.value,
    LessThanOrEqual: lambda v, f: v is not None and v <= f.value,
    StringStartsWith: lambda v, f: v is not None and v.startswith(f.value),
    StringEndsWith: lambda v, f: v is not None and v.endswith(f.value),
    StringContains: lambda v, f: v is not None and f.value in v,
}


@dataclass
class Range(InputPartition):
    """Byte ranges (archive, start, stop) that one task reads."""

    spans: list


@dataclass
class Archive(WriterCommitMessage):
    """A complete archive under its temporary name, or None for a task without rows."""

    temporary: str | None


class WarcReader(DataSourceReader):
    def __init__(self, options: dict):
        self.folder = local_path(options["path"])
        self.split = int(options.get("splitBytes", SPLIT_BYTES))
        self.with_payload = options.get("payload", "true").lower() != "false"
        self.filters: list = []

    def pushFilters(self, filters):
        for f in filters:
            if type(f) in _TESTS and len(f.attribute) == 1 and f.attribute[0] in FIELDS:
                self.filters.append(f)
            else:
                yield f

    def partitions(self):
        names = sorted(n for n in os.listdir(self.folder) if n.endswith(".warc.gz")) if os.path.isdir(self.folder) else []
        ranges, held, size = [], [], 0
        for name in names:
            path = f"{self.folder}/{name}"
            end = os.path.getsize(path)
            for start in range(0, end, self.split):
                stop = min(end, start + self.split)
                if held and size + stop - start > self.split:
                    ranges.append(Range(held))
                    held, size = [], 0
                held.append((path, start, stop))
                size += stop - start
        return [*ranges, Range(held)]

    def read(self, partition):
        def wanted(row):
            return all(_TESTS[type(f)](row[f.attribute[0]], f) for f in self.filters)
        rows, size = [], 0
        for path, start, stop in partition.spans:
            for row in members(path, start, stop, wanted, self.with_payload):
                rows.append(row)
                size += len(row["payload"] or b"") + 300
                if size >= BATCH_BYTES:
                    yield pa.RecordBatch.from_pylist(rows, schema=SCHEMA)
                    rows, size = [], 0
        yield pa.RecordBatch.from_pylist(rows, schema=SCHEMA)


class WarcWriter(DataSourceArrowWriter):
    def __init__(self, options: dict):
        self.folder = local_path(options["path"])

    def write(self, iterator):
        name, archive = f"{self.folder}/.{uuid.uuid4().hex}", None
        for batch in iterator:
            for at in range(batch.num_rows):
                if archive is None:
                    os.makedirs(self.folder, exist_ok=True)
                    archive = open(name, "wb")  # noqa: SIM115
                archive.write(member(batch.slice(at, 1).to_pylist()[0]))
        if archive is not None:
            archive.close()
        return Archive(name if archive else None)

    def commit(self, messages):
        """Only archives of tasks that count get their names; what lost attempts left stays hidden."""
        for message in messages:
            if message and message.temporary:
                folder, name = os.path.split(message.temporary)
                os.replace(message.temporary, f"{folder}/{name[1:]}.warc.gz")

    def abort(self, messages):
        for message in messages:
            if message and message.temporary:
                os.unlink(message.temporary)


class WarcDataSource(DataSource):
    @classmethod
    def name(cls):
        return "warc"

    def schema(self):
        return DDL

    def reader(self, schema):
        return WarcReader(self.options)

    def writer(self, schema, overwrite):
        return WarcWriter(self.options)


def register(spark: SparkSession) -> None:
    """Make format "warc" known to the session and let it push filters."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcDataSource)


# -- types ----------------------------------------------------------------------------------------------------

def deduplicated(pages: DataFrame, min_bytes: int = 0, id_col: str = "page_id", url_col: str = "url",
                 html_col: str = "html") -> DataFrame:
    """Records, in the data source's columns, for rows of pages."""
    payload = F.encode(F.coalesce(F.col(html_col), F.lit("")), "UTF-8")
    rows = pages.select(F.col(id_col).cast("long").alias("page"), F.col(url_col).alias("target_uri"),
                        payload.alias("payload"), F.octet_length(payload).cast("long").alias("payload_bytes"),
                        F.sha1(payload).alias("sha1"))
    # pre-aggregated per task; written, so that a join can split the records of a very common payload
    firsts = written(rows.where(F.col("payload_bytes") >= min_bytes).groupBy("sha1")
                     .agg(F.min("page").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"),
                     work_folder(pages.sparkSession, "first-payloads"))
    revisit = (F.col("payload_bytes") >= min_bytes) & F.col("first").isNotNull() & ~F.col("first").eqNullSafe(F.col("page"))
    urn = lambda c: F.concat(F.lit("urn:page:"), F.coalesce(c.cast("string"), F.lit("")))
    return rows.join(firsts, "sha1", "left").select(
        urn(F.col("page")).alias("record_id"), F.when(revisit, "revisit").otherwise("response").alias("record_type"),
        "target_uri", F.when(revisit, urn(F.col("first"))).alias("refers_to"),
        base32_column(F.col("sha1")).alias("payload_digest"), "payload_bytes",
        F.when(~revisit, F.col("payload")).alias("payload"))


def page_of(urn):
    """The page id in a record id."""
    return F.substring(urn, len("urn:page:") + 1, 40).try_cast("long")
