"""Collection dumps: files of length-prefixed binary documents, read in ranges and decoded field by field.

A dump is documents one after another, each beginning with its length.  One task per file hops from length to length
and notes a border every ``split_bytes``; many tasks then decode the ranges between.  Fields that the schema doesn't
name, and documents that a filter on top-level fields rejects, are passed over by their lengths without decoding.
"""
from __future__ import annotations

import datetime as dt
import decimal
import os
import struct
import uuid

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from qualitas.sources.splits import SPLIT_BYTES, Opened, files

BLOCK = 1 << 20
_INT, _LONG, _DOUBLE = struct.Struct("<i"), struct.Struct("<q"), struct.Struct("<d")
_EPOCH = dt.datetime(1970, 1, 1)
# The type numbers of the format.
DOUBLE, STRING, DOCUMENT, ARRAY, BINARY, UNDEFINED, OBJECT_ID, BOOLEAN, DATETIME, NULL, REGEX = range(1, 12)
POINTER, CODE, SYMBOL, SCOPED_CODE, INT32, TIMESTAMP, INT64, DECIMAL128 = range(12, 20)
MIN_KEY, MAX_KEY = 255, 127
_FIXED = {DOUBLE: 8, UNDEFINED: 0, OBJECT_ID: 12, BOOLEAN: 1, DATETIME: 8, NULL: 0, INT32: 4, TIMESTAMP: 8, INT64: 8,
          DECIMAL128: 16, MIN_KEY: 0, MAX_KEY: 0}


class BrokenDumpError(ValueError):
    pass


def _size(raw: memoryview, kind: int, at: int) -> int:
    """The number of bytes of a value."""
    if kind in _FIXED:
        return _FIXED[kind]
    if kind in (STRING, CODE, SYMBOL):
        return 4 + _INT.unpack_from(raw, at)[0]
    if kind in (DOCUMENT, ARRAY, SCOPED_CODE):
        return _INT.unpack_from(raw, at)[0]
    if kind == BINARY:
        return 5 + _INT.unpack_from(raw, at)[0]
    if kind == POINTER:
        return 16 + _INT.unpack_from(raw, at)[0]
    if kind == REGEX:
        end = _zero(raw, _zero(raw, at) + 1) + 1
        return end - at
    raise BrokenDumpError(f"unknown type {kind}")


def _zero(raw: memoryview, at: int) -> int:
    while raw[at]:
        at += 1
    return at


def _decimal128(raw: bytes) -> str:
    low, high = struct.unpack("<QQ", raw)
    sign, combination = high >> 63, (high >> 58) & 31
    if combination >= 30:
        return "NaN" if combination == 31 else ("-" if sign else "") + "Infinity"
    exponent = ((high >> 49) & 0x3FFF) - 6176
    return str(decimal.Decimal((sign, tuple(map(int, str((high & ((1 << 49) - 1)) << 64 | low))), exponent)))


def _value(raw: memoryview, kind: int, at: int):
    if kind == DOUBLE:
        return _DOUBLE.unpack_from(raw, at)[0]
    if kind in (STRING, CODE, SYMBOL):
        return bytes(raw[at + 4:at + 3 + _INT.unpack_from(raw, at)[0]]).decode("utf-8", "replace")
    if kind in (DOCUMENT, ARRAY):
        inner = dict(fields(raw[at:at + _INT.unpack_from(raw, at)[0]]))
        return list(inner.values()) if kind == ARRAY else inner
    if kind == BINARY:
        return bytes(raw[at + 5:at + 5 + _INT.unpack_from(raw, at)[0]])
    if kind == OBJECT_ID:
        return bytes(raw[at:at + 12]).hex()
    if kind == BOOLEAN:
        return bool(raw[at])
    if kind == DATETIME:
        return _EPOCH + dt.timedelta(milliseconds=_LONG.unpack_from(raw, at)[0])
    if kind == INT32:
        return _INT.unpack_from(raw, at)[0]
    if kind in (INT64, TIMESTAMP):
        return _LONG.unpack_from(raw, at)[0]
    if kind == DECIMAL128:
        return _decimal128(bytes(raw[at:at + 16]))
    if kind == REGEX:
        return bytes(raw[at:_zero(raw, at)]).decode("utf-8", "replace")
    return None                                              # null, undefined, least and greatest key


def fields(document: memoryview, wanted=None):
    """``(name, value)`` of a document's fields, or of the ``wanted`` ones; the others are passed over by length."""
    at, end = 4, len(document) - 1
    while at < end:
        kind, stop = document[at], _zero(document, at + 1)
        name = bytes(document[at + 1:stop]).decode("utf-8", "replace")
        at = stop + 1
        if wanted is None or name in wanted:
            yield name, _value(document, kind, at)
        at += _size(document, kind, at)


def borders(file: Opened, size: int, split_bytes: int):
    """``(start, stop)`` of ranges of whole documents, found by hopping from length to length."""
    start = at = 0
    held, held_at = b"", 0
    while at < size:
        if at + 4 > held_at + len(held):
            held, held_at = file.read(at, min(size, at + BLOCK)), at
        if at + 4 > held_at + len(held):
            raise BrokenDumpError(f"the file ends within the document at byte {at}")
        length = _INT.unpack_from(held, at - held_at)[0]
        if length < 5 or at + length > size:
            raise BrokenDumpError(f"the document at byte {at} has a length of {length}")
        at += length
        if at - start >= split_bytes:
            yield start, at
            start = at
    if at > start:
        yield start, at


def documents(raw: bytes):
    at, view = 0, memoryview(raw)
    while at < len(raw):
        length = _INT.unpack_from(raw, at)[0]
        yield view[at:at + length]
        at += length


def _as(value, kind: T.DataType):
    """A value in the type that the schema asks for; what doesn't fit becomes NULL, as a reader in permissive mode does."""
    if value is None:
        return None
    try:
        if isinstance(kind, T.StringType):
            return value if isinstance(value, str) else str(value)
        if isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
            return int(value) if isinstance(value, (int, bool)) else None
        if isinstance(kind, (T.FloatType, T.DoubleType)):
            return float(value) if isinstance(value, (int, float)) else None
        if isinstance(kind, T.DecimalType):
            return decimal.Decimal(str(value)).quantize(decimal.Decimal(1).scaleb(-kind.scale))
        if isinstance(kind, T.BooleanType):
            return value if isinstance(value, bool) else None
        if isinstance(kind, T.DateType):
            return value.date() if isinstance(value, dt.datetime) else None
        if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
            return value if isinstance(value, dt.datetime) else None
        if isinstance(kind, T.BinaryType):
            return value if isinstance(value, bytes) else None
        if isinstance(kind, T.StructType):
            return {f.name: _as(value.get(f.name), f.dataType) for f in kind.fields} if isinstance(value, dict) else None
        if isinstance(kind, T.ArrayType):
            return [_as(v, kind.elementType) for v in value] if isinstance(value, list) else None
    except (ValueError, OverflowError, decimal.InvalidOperation):
        return None
    return None


def read_bson(spark: SparkSession, paths, schema: T.StructType, equals: dict | None = None,
              split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """The documents of all dumps at or below ``paths``, in the columns of ``schema``.

    ``equals`` (field to value) keeps the documents whose top-level fields have these values; the others aren't
    decoded.  A file that ends within a document, or whose lengths lead nowhere, fails the read with the place.
    """
    listed = files(spark, paths).where("size > 0")
    n = listed.count()
    cut = pa.schema([("path", pa.string()), ("start", pa.int64()), ("stop", pa.int64())])

    def hopped(batches):
        for batch in batches:
            for path, size in zip(batch["path"].to_pylist(), batch["size"].to_pylist(), strict=True):
                with Opened(path) as file:
                    try:
                        found = list(borders(file, size, split_bytes))
                    except BrokenDumpError as e:
                        raise BrokenDumpError(f"{path}: {e}") from None
                yield pa.RecordBatch.from_pydict({"path": [path] * len(found), "start": [a for a, _ in found],
                                                  "stop": [b for _, b in found]}, schema=cut)

    arrow = to_arrow_schema(schema)
    wanted = {*schema.fieldNames()}

    def decoded(batches):
        held: list[dict] = []
        for batch in batches:
            for path, start, stop in zip(*(batch[c].to_pylist() for c in ("path", "start", "stop")), strict=True):
                with Opened(path) as file:
                    raw = file.read(start, stop)
                for document in documents(raw):
                    if equals and dict(fields(document, equals)) != equals:
                        continue
                    found = dict(fields(document, wanted))
                    held.append({f.name: _as(found.get(f.name), f.dataType) for f in schema.fields})
                    if len(held) >= 2_000:
                        yield pa.RecordBatch.from_pylist(held, schema=arrow)
                        held = []
        if held:
            yield pa.RecordBatch.from_pylist(held, schema=arrow)

    total = listed.agg(F.sum(F.ceil(F.col("size") / split_bytes))).first()[0] or 1
    ranges = (listed.repartition(max(1, min(n, 10_000)), "path").mapInArrow(hopped, "path string, start long, stop long")
              .repartition(max(1, min(int(total), 50_000)), "path", "start"))
    return ranges.mapInArrow(decoded, schema)


# -- writing --------------------------------------------------------------------------------------------------

def _element(name: str, value) -> bytes:
    key = name.encode() + b"\0"
    if value is None:
        return bytes([NULL]) + key
    if isinstance(value, bool):
        return bytes([BOOLEAN]) + key + bytes([value])
    if isinstance(value, int):
        small = -(1 << 31) <= value < 1 << 31
        return bytes([INT32 if small else INT64]) + key + (_INT if small else _LONG).pack(value)
    if isinstance(value, float):
        return bytes([DOUBLE]) + key + _DOUBLE.pack(value)
    if isinstance(value, str):
        raw = value.encode() + b"\0"
        return bytes([STRING]) + key + _INT.pack(len(raw)) + raw
    if isinstance(value, bytes):
        return bytes([BINARY]) + key + _INT.pack(len(value)) + b"\0" + value
    if isinstance(value, decimal.Decimal):
        return _element(name, str(value))
    if isinstance(value, dt.datetime):
        wall = value.replace(tzinfo=None) - (value.utcoffset() or dt.timedelta())
        return bytes([DATETIME]) + key + _LONG.pack((wall - _EPOCH) // dt.timedelta(milliseconds=1))
    if isinstance(value, dt.date):
        return _element(name, dt.datetime(value.year, value.month, value.day))
    if isinstance(value, dict):
        return bytes([DOCUMENT]) + key + document_bytes(value)
    if isinstance(value, (list, tuple)):
        return bytes([ARRAY]) + key + document_bytes({str(i): v for i, v in enumerate(value)})
    raise TypeError(f"no type for {type(value).__name__}")


def document_bytes(document: dict) -> bytes:
    body = b"".join(_element(k, v) for k, v in document.items())
    return _INT.pack(len(body) + 5) + body + b"\0"


def write_bson(df: DataFrame, folder: str) -> None:
    """Write every row as a document; a dump file per task, in a mounted folder that all executors share."""
    if "://" in folder and not folder.startswith("file:"):
        raise ValueError(f"{folder} is not a mounted folder")
    local = "/" + folder[5:].lstrip("/") if folder.startswith("file:") else folder

    def write(batches):
        os.makedirs(local, exist_ok=True)
        name = f"{local}/part-{TaskContext.get().partitionId():06d}.bson"
        mine = f"{local}/.{uuid.uuid4().hex}"
        rows = 0
        with open(mine, "wb") as out:
            for batch in batches:
                for at in range(0, batch.num_rows, 1_000):
                    for row in batch.slice(at, 1_000).to_pylist():
                        out.write(document_bytes(row))
                        rows += 1
        os.replace(mine, name)                               # a repeated task replaces an equal file
        yield pa.RecordBatch.from_pydict({"rows": [rows]}, schema=pa.schema([("rows", pa.int64())]))

    df.mapInArrow(write, "rows long").agg(F.sum("rows")).collect()
