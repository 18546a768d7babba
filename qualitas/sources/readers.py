"""Readers for the audit sources: CSV files, JSON payloads and documents, tables.

Every reader returns a DataFrame.  Of CSV files only headers are looked at
beforehand; JSON payloads are split into their records once when they are read.
"""
from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from qualitas.functions import grammar as G
from qualitas.session import exists, work_folder
from qualitas.sources.splits import BYTE_ORDER_MARK, SPLIT_BYTES, csv_rows, files, json_elements

#: Column that holds a malformed row as it was found; NULL for sound rows.
CORRUPT = G.CORRUPT_COLUMN


class NotCsvError(ValueError):
    pass


def _not_csv(spark: SparkSession, path: str) -> str | None:
    """A data file at or below ``path`` whose name doesn't end in ``.csv``, found by one job over the store's listing."""
    name = F.lower(F.element_at(F.split("path", "/"), -1))
    return files(spark, path).where(~name.endswith(".csv")).agg(F.min("path")).first()[0]


def read_csv(spark: SparkSession, path: str, multiline: bool = False, schema: T.StructType | None = None,
             split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """Header row gives the names; every value stays text; all rows kept.

    A path or a folder holding anything but ``.csv`` files is refused.  All
    files must have the same header (a clash fails when the file is read),
    which ``schema`` can state beforehand.  Rows with more or fewer fields
    than the header keep what they have and are kept whole in
    ``_corrupt_record``, which an audit counts as malformed rows and doesn't
    profile.  Quotes are escaped by doubling them (RFC 4180).
    ``multiline=True`` accepts line breaks inside quoted fields; such files
    are read in ranges of ``split_bytes`` too (``splits.py``), empty fields
    as NULL.
    """
    other = _not_csv(spark, path)
    if other:
        raise NotCsvError(f"not a .csv file: {other}")
    options = dict(header=True, quote='"', escape='"', multiLine=multiline)
    names = schema.fieldNames() if schema else spark.read.csv(path, inferSchema=False, **options).columns
    if multiline:
        return _csv_by_ranges(spark, path, list(names), split_bytes)
    strings = T.StructType([T.StructField(n, T.StringType()) for n in (*names, CORRUPT)])
    return spark.read.schema(strings).csv(path, enforceSchema=False, mode="PERMISSIVE",
                                          columnNameOfCorruptRecord=CORRUPT, **options)


def _csv_by_ranges(spark: SparkSession, path: str, names: list[str], split_bytes: int) -> DataFrame:
    rows, fields = csv_rows(spark, path, split_bytes), F.col("fields")
    first = F.col("offset") <= len(BYTE_ORDER_MARK)              # a file's first row begins at 0 or behind the mark
    head = (F.col("offset") == 0) | (first & (F.col("offset") == len(BYTE_ORDER_MARK)) & (fields == F.array(*map(F.lit, names))))
    clash = F.raise_error(F.concat(F.lit("the CSV header of "), F.col("file"), F.lit(" is "), F.array_join(fields, ",")))
    data = rows.where(F.when(head & (fields != F.array(*map(F.lit, names))), clash.cast("boolean")).otherwise(~head))
    quoted = F.transform(fields, lambda f: F.when(f.rlike('[",\r\n]'), F.concat(
        F.lit('"'), F.replace(f, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(f))
    value = lambda i: F.nullif(F.get(fields, F.lit(i)), F.lit(""))
    return data.select(*[value(i).alias(n) for i, n in enumerate(names)],
                       F.when(F.size(fields) != len(names), F.array_join(quoted, ",")).alias(CORRUPT))


class NotAnArrayError(ValueError):
    pass


def read_json_array(spark: SparkSession, paths, schema: T.StructType | None = None, bad: str = "refuse",
                    split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """Landed REST payloads: each file holds JSON arrays of records (one, or several after one another).

    Values keep their text form (``primitivesAsString``); nested objects stay
    structs and are profiled through ``to_json``.  Files are read in ranges,
    so one large array is read by many tasks, and a record at a time is
    parsed.  An empty file has no records.

    What isn't a record is found with its file and offset: elements that
    aren't JSON or no objects, text outside arrays (a file that isn't an
    array), an array that its file cuts off.  ``bad="refuse"`` refuses the
    read with the first of them, whether ``schema`` is given or not;
    ``bad="keep"`` gives them as rows that have ``_corrupt_record`` alone
    (``file``, ``offset``, ``problem`` and ``text``, as JSON).

    The elements are written once into the shared folder, as JSON lines: the
    schema's inference and all later scans read those.
    """
    if bad not in ("refuse", "keep"):
        raise ValueError(f"bad must be refuse or keep, not {bad!r}")
    folder = work_folder(spark, "json-elements")
    elements = json_elements(spark, [paths] if isinstance(paths, str) else list(paths), split_bytes)
    broken = F.col("problem").isNotNull()
    # line breaks in a record stand between its tokens; within strings JSON has none
    value = F.when(broken, F.to_json(F.struct("file", "offset", "problem", "text"))).otherwise(
        F.translate("text", "\r\n", "  "))
    elements.select(value.alias("value"), broken.alias("broken")).write.partitionBy("broken").text(folder)
    problems = None
    if exists(spark, f"{folder}/broken=true"):
        problems = spark.read.text(f"{folder}/broken=true")
        if bad == "refuse":
            first = problems.select(F.from_json("value", "file string, offset long, problem string").alias("p")).agg(
                F.min(F.struct("p.file", "p.offset", "p.problem"))).first()[0]
            raise NotAnArrayError(f"{first['file']}: at byte {first['offset']}: {first['problem']}")
    if exists(spark, f"{folder}/broken=false"):
        reader = spark.read.schema(schema) if schema else spark.read
        records = reader.json(f"{folder}/broken=false", primitivesAsString=True)
    else:
        records = spark.createDataFrame([], schema or T.StructType())
    if bad == "refuse":
        return records
    lost = T.StructType([*records.schema.fields, T.StructField(CORRUPT, T.StringType())])
    kept = records.withColumn(CORRUPT, F.lit(None).cast("string"))
    return kept if problems is None else kept.unionByName(problems.select(
        *[F.lit(None).cast(f.dataType).alias(f.name) for f in records.schema.fields], F.col("value").alias(CORRUPT))).to(lost)


def read_json_documents(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """Exported document collection (JSON lines); ``schema`` saves the pass that infers it."""
    reader = spark.read.schema(schema) if schema else spark.read
    return reader.json(path, primitivesAsString=True)


class ConnectorMissingError(RuntimeError):
    pass


def read_mongo(spark: SparkSession, uri: str, database: str, collection: str) -> DataFrame:
    """Document collection through the MongoDB Spark connector, where that connector is deployed.

    Without the connector on the classpath a ``ConnectorMissingError`` says so;
    exported collections can always be read with ``read_json_documents``.
    """
    try:
        return (spark.read.format("mongodb").option("connection.uri", uri).option("database", database)
                .option("collection", collection).load())
    except Exception as e:  # noqa: BLE001
        if "mongodb" in str(e).lower() and ("not found" in str(e).lower() or "failed to find" in str(e).lower()):
            raise ConnectorMissingError("the MongoDB Spark connector is not on the classpath; "
                                        "read an export with read_json_documents instead") from e
        raise


def read_table(spark: SparkSession, name: str) -> DataFrame:
    """Catalog table by (possibly dotted) name; refuses names outside the table-name grammar."""
    if not re.fullmatch(G.TABLE_NAME_PATTERN, name):
        raise ValueError(f"invalid table name: {name!r}")
    return spark.table(name)


def read_jdbc(spark: SparkSession, url: str, table: str, properties: dict | None = None,
              partition_column: str | None = None, lower: int | None = None,
              upper: int | None = None, num_partitions: int | None = None,
              single_connection: bool = False) -> DataFrame:
    """Relational table over JDBC, read in parallel by ranges of a partition column.

    Without one the whole table comes over one connection into one task, which must be asked for.
    """
    if not re.fullmatch(G.TABLE_NAME_PATTERN, table):
        raise ValueError(f"invalid table name: {table!r}")
    if partition_column:
        return spark.read.jdbc(url, table, column=partition_column, lowerBound=lower,
                               upperBound=upper, numPartitions=num_partitions,
                               properties=properties or {})
    if not single_connection:
        raise ValueError("give a partition column, or single_connection=True for a small table")
    return spark.read.jdbc(url, table, properties=properties or {})
