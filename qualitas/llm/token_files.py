"""Operator 10: token ids in flat binary files with 64-bit document offsets, memory-mapped when read.

Format of a set in one folder, for each part ``p`` (parts follow one another in ascending document id):

* ``p.bin``  the ids of the part's documents, one after another, little-endian unsigned 16-bit where the
  vocabulary fits into them, else 32-bit;
* ``p.off``  little-endian signed 64-bit: the place of each document's first id within the part, and one more
  for the part's end;
* ``p.ids``  little-endian signed 64-bit document ids in the same order.

The folder's ``parts`` table holds each part's number of documents and ids and its base, the number of ids in all
parts before it: prefix sums of the counts.  A document starts at base + offset.

The folder must be one that every executor mounts (the session's ``spark.checkpoint.dir``).  A task writes under
a name of its own attempt and renames when complete, so a part written again after a lost executor replaces an
equal one.

Nulls and empty texts hold the end id alone.  Rows are ordered by document id (null first), equal ids by a hash of
the text; repeated rows each give an entry.  An empty table makes a set without parts.
"""
from __future__ import annotations

import mmap
import os
import uuid

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from qualitas.llm.batches import flat_map
from qualitas.llm.bpe import ID, encoder
from qualitas.session import written

OFFSET = np.dtype("<i8")
#: Written in place of a null document id.
NO_ID = np.iinfo(np.int64).min


def local_path(uri: str) -> str:
    """The mounted path of a shared folder."""
    if uri.startswith("file:"):
        return "/" + uri[len("file:"):].lstrip("/")
    if "://" in uri:
        raise ValueError(f"{uri} is not a mounted folder; memory-mapped files need one that all executors share")
    return uri


def id_type(vocabulary: int) -> np.dtype:
    return np.dtype("<u2") if vocabulary <= 1 << 16 else np.dtype("<u4")


def part_name(part: int) -> str:
    return f"part-{part:06d}"


def write(docs: DataFrame, folder: str, tokenizer: str, end_id: int, id_col: str = "doc_id",
          text_col: str = "text") -> DataFrame:
    """Encode every text, append ``end_id`` and write the file set; returns its ``parts`` table."""
    spark = docs.sparkSession
    local = local_path(folder)
    schema = pa.schema([("part", pa.int32()), ("docs", pa.int64()), ("ids", pa.int64()), ("width", pa.int32())])

    def files(batches):
        enc, part = encoder(tokenizer), TaskContext.get().partitionId()
        dtype = id_type(max(enc.size, end_id + 1))
        end = np.array([end_id], ID).tobytes()
        os.makedirs(local, exist_ok=True)
        name = f"{local}/{part_name(part)}"
        mine = f"{local}/.{part_name(part)}-{uuid.uuid4().hex}"
        n_docs = n_ids = 0
        with open(f"{mine}.bin", "wb") as ids, open(f"{mine}.off", "wb") as offsets, open(f"{mine}.ids", "wb") as keys:
            for batch in batches:
                for start in range(0, batch.num_rows, 1_000):
                    rows = batch.slice(start, 1_000)
                    for doc_id, text in zip(rows["doc_id"].to_pylist(), rows["text"].to_pylist(), strict=True):
                        made = np.frombuffer(enc.encode(text) + end, ID).astype(dtype)
                        ids.write(made.tobytes())
                        offsets.write(n_ids.to_bytes(8, "little", signed=True))
                        keys.write((NO_ID if doc_id is None else doc_id).to_bytes(8, "little", signed=True))
                        n_ids += len(made)
                        n_docs += 1
            offsets.write(n_ids.to_bytes(8, "little", signed=True))
        for kind in ("bin", "off", "ids"):
            if n_docs:
                os.replace(f"{mine}.{kind}", f"{name}.{kind}")
            else:
                os.unlink(f"{mine}.{kind}")
        if n_docs:
            yield pa.RecordBatch.from_pydict({"part": [part], "docs": [n_docs], "ids": [n_ids],
                                              "width": [dtype.itemsize]}, schema=schema)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    counts = written(
        rows.withColumn("tie", F.xxhash64("text")).withColumn("row", F.monotonically_increasing_id())
        .repartitionByRange(parts, "doc_id", "tie", "row").sortWithinPartitions("doc_id", "tie", "row")
        .select("doc_id", "text").mapInArrow(files, "part int, docs long, ids long, width int"),
        f"{folder}/counts")
    # one row a part: the running total over all parts is a small ordered sum
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return written(counts.withColumn("base", F.coalesce(F.sum("ids").over(before), F.lit(0))), f"{folder}/parts")


def read(spark: SparkSession, folder: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids``: every document of a file set, ids as little-endian unsigned 32-bit."""
    local = local_path(folder)
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary())])

    def documents(part, base, width):
        path = f"{local}/{part_name(part)}"
        offsets, keys = np.fromfile(f"{path}.off", OFFSET), np.fromfile(f"{path}.ids", OFFSET)
        with open(f"{path}.bin", "rb") as f, mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ) as ids:
            for i, key in enumerate(keys.tolist()):
                a, b = int(offsets[i]), int(offsets[i + 1])
                made = np.frombuffer(ids[a * width:b * width], f"<u{width}").astype(ID)
                yield (None if key == NO_ID else key, base + a, b - a, made.tobytes())

    parts = spark.read.parquet(f"{folder}/parts").select("part", "base", "width")
    # a task for each few parts: the table of parts is small, the files behind it are not
    spread = parts.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "part")
    return spread.mapInArrow(lambda batches: flat_map(batches, schema, documents),
                             "doc_id long, start long, n_tokens long, ids binary")
