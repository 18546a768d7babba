"""Operator 2: best-fit packing by large-item matching.

Documents become items of at most ``capacity`` tokens: a longer one is cut into full pieces, its first piece
takes what is left over.  Items are integers from 1 to ``capacity``, so the packing is planned on the histogram
of lengths, which has at most ``capacity`` rows however many documents there are:

1. full items fill a sequence each;
2. large items, above a third of the capacity, pair at most twice per sequence: from the longest down, each is
   matched with the longest other large item that still fits beside it, or stays alone;
3. small items, from the longest down, go into the smallest gap that holds them; new sequences open only when
   no gap does.

The plan is a list of runs: "of the items of length L, those ranked a to b go to sequences s, s+1, ..., each
taking q of them from offset o on".  Spark ranks the items of each length (counts by length and bucket, prefix
sums over the buckets, a row number within) and looks each one up in the runs.

Null and empty texts are items of the separator alone.  Repeated rows are items of their own; an empty table
gives an empty result.  Items of equal length are interchangeable, so ties need no order.
"""
from __future__ import annotations

import bisect
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from qualitas.llm.batches import flat_map
from qualitas.llm.bpe import encoder
from qualitas.session import work_folder, written

CAPACITY = 2048


@dataclass(frozen=True)
class Run:
    """Items of ``length`` ranked from ``first`` on: ``each`` of them a sequence, from ``sequence`` and ``offset``."""

    length: int
    first: int
    sequence: int
    each: int
    offset: int


class _Plan:
    """Packs a histogram; groups of sequences that look alike are handled together."""

    def __init__(self, counts: dict[int, int], capacity: int):
        self.capacity = capacity
        self.left = {n: c for n, c in counts.items() if c}
        self.ranked = dict.fromkeys(self.left, 0)
        self.runs: list[Run] = []
        self.sequences = 0
        self.gaps: list[int] = []                                 # sorted
        self.groups: dict[int, list[tuple[int, int]]] = {}        # gap: (first sequence, how many)

    def open(self, how_many: int) -> int:
        first, self.sequences = self.sequences, self.sequences + how_many
        return first

    def put(self, length: int, items: int, sequence: int, each: int, offset: int) -> None:
        self.runs.append(Run(length, self.ranked[length], sequence, each, offset))
        self.ranked[length] += items
        self.left[length] -= items

    def keep(self, gap: int, first: int, how_many: int) -> None:
        if gap and how_many:
            if gap not in self.groups:
                bisect.insort(self.gaps, gap)
            self.groups.setdefault(gap, []).append((first, how_many))

    def match_large(self) -> None:
        lengths = sorted(n for n in self.left if n * 3 > self.capacity)
        for n in reversed(lengths):
            while self.left[n]:
                at = bisect.bisect_right(lengths, self.capacity - n) - 1
                while at >= 0 and (not self.left[lengths[at]] or lengths[at] == n and self.left[n] < 2):
                    at -= 1
                if at < 0:
                    pairs, mate = self.left[n], None
                else:
                    mate = lengths[at]
                    pairs = self.left[n] // 2 if mate == n else min(self.left[n], self.left[mate])
                first = self.open(pairs)
                self.put(n, pairs, first, 1, 0)
                if mate is not None:
                    self.put(mate, pairs, first, 1, n)
                self.keep(self.capacity - n - (mate or 0), first, pairs)

    def best_fit_small(self) -> None:
        for n in sorted((n for n in self.left if n * 3 <= self.capacity), reverse=True):
            while self.left[n]:
                at = bisect.bisect_left(self.gaps, n)
                if at == len(self.gaps):
                    each = self.capacity // n
                    how_many = -(-self.left[n] // each)
                    first, gap = self.open(how_many), self.capacity
                else:
                    gap = self.gaps[at]
                    each = gap // n
                    first, there = self.groups[gap].pop()
                    how_many = min(there, -(-self.left[n] // each))
                    if how_many < there:
                        self.groups[gap].append((first + how_many, there - how_many))
                    if not self.groups[gap]:
                        del self.groups[gap]
                        del self.gaps[at]
                items = min(self.left[n], how_many * each)
                self.put(n, items, first, each, self.capacity - gap)
                in_last = items - (how_many - 1) * each
                self.keep(gap - each * n, first, how_many - 1)
                self.keep(gap - in_last * n, first + how_many - 1, 1)


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> tuple[list[Run], int]:
    """Runs for a histogram of item lengths, and the number of sequences."""
    packing = _Plan(counts, capacity)
    packing.match_large()
    packing.best_fit_small()
    return packing.runs, packing.sequences


def pieces(docs: DataFrame, tokenizer: str, separator: int, capacity: int = CAPACITY, id_col: str = "doc_id",
           text_col: str = "text") -> DataFrame:
    """``doc_id, piece, start, length, ids``: whole documents with the separator, longer ones cut."""
    schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()),
                        ("ids", pa.binary())])

    def cut(batches):
        enc, end = encoder(tokenizer), separator.to_bytes(4, "little")

        def rows(doc_id, text):
            ids = enc.encode(text) + end
            n = len(ids) // 4
            first = n % capacity or capacity
            for piece, stop in enumerate(range(first, n + 1, capacity)):
                start = max(0, stop - capacity) if piece else 0
                yield doc_id, piece, start, stop - start, ids[4 * start:4 * stop]
        yield from flat_map(batches, schema, rows)

    return (docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
            .mapInArrow(cut, "doc_id long, piece int, start long, length long, ids binary"))


def with_crc32(items: DataFrame) -> DataFrame:
    """``ids_crc32`` in place of the ids."""
    return items.withColumn("ids_crc32", F.crc32("ids")).drop("ids")


def pack(items: DataFrame, capacity: int = CAPACITY, folder: str | None = None) -> DataFrame:
    """``items`` (rows with a ``length`` from 1 to ``capacity``) with their ``sequence_id`` and ``offset``."""
    spark = items.sparkSession
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # numbered once and written: both the counts and the ranks must see the same numbers
    numbered = written(items.withColumn("_row", F.monotonically_increasing_id()),
                       folder or work_folder(spark, "packing-items"))
    bucketed = numbered.withColumn("_bucket", F.pmod(F.xxhash64("_row"), F.lit(buckets)).cast("int"))
    counts = bucketed.groupBy("length", "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("length").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("length", "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    histogram = {r["length"]: r["n"] for r in numbered.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    runs, _ = plan(histogram, capacity)                       # at most ``capacity`` lengths reach the driver
    within = F.row_number().over(Window.partitionBy("length", "_bucket").orderBy("_row")) - 1
    ranked = (bucketed.withColumn("_within", within).join(bases, ["length", "_bucket"])
              .withColumn("_rank", F.col("_base") + F.col("_within")).drop("_bucket", "_base", "_within", "_row"))
    by_length: dict[int, list[Run]] = {}
    for run in runs:
        by_length.setdefault(run.length, []).append(run)
    firsts = {n: np.array([r.first for r in rs]) for n, rs in by_length.items()}

    def place(batches):
        for batch in batches:
            lengths, ranks = batch["length"].to_numpy(), batch["_rank"].to_numpy()
            sequence, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
            for n in np.unique(lengths).tolist():
                rows = np.flatnonzero(lengths == n)
                at = np.searchsorted(firsts[n], ranks[rows], "right") - 1
                first, start, each, off = (np.array([getattr(r, f) for r in by_length[n]])[at]
                                           for f in ("first", "sequence", "each", "offset"))
                sequence[rows] = start + (ranks[rows] - first) // each
                offset[rows] = off + (ranks[rows] - first) % each * n
            kept = batch.drop_columns(["_rank"])
            yield kept.append_column("sequence_id", pa.array(sequence)).append_column("offset", pa.array(offset))

    names = [f for f in ranked.schema.fields if f.name != "_rank"]
    out = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in names) + ", sequence_id long, offset long"
    return ranked.mapInArrow(place, out)
