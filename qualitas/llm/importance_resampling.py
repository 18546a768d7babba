"""Operator 12: importance resampling towards a target distribution, over hashed n-grams from prefix CRCs.

A document is the sequence of its words (runs of ASCII letters and digits and of non-ASCII characters, A-Z in lower
case).  Features are all runs of 1 to 3 consecutive words joined by one space; a feature's bucket is its CRC-32
modulo the number of buckets.  Raw texts and target texts each give a count for every bucket, a bucket's gain is the
logarithm of the smoothed ratio of the two shares, and a document weighs the sum of its features' gains.  With a
Gumbel number out of the document's id added to the weights, the highest scores are a sample without replacement
in which documents are as likely as their importance.

Each document is scanned once: its words are written one after another with one space between, and the running CRC
is stored before and after every word.  The CRC of any run of words is then

    crc(run) = crc(prefix with the run) xor shift(crc(prefix before the run), length of the run)

since CRC is linear over GF(2): shifting a register by n zero bytes is a matrix, and cancels the prefix.  So no
feature is ever written out or read again.

Null texts and texts without words have no features and weigh 0.  Null ids are drawn by the empty id.  Repeated rows
count, and are ranked, as often as they occur; rows of equal score and id have consecutive ranks in any order.
Long texts are handled in pieces that overlap by two words.  An empty table gives an empty result, an empty target
counts no feature.  Other columns are ignored.
"""
from __future__ import annotations

import hashlib
import math
import zlib
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from qualitas.session import work_folder, written

BUCKETS = 10_000
LONGEST = 3
#: Bytes of text whose words a task holds at once.
PIECE_BYTES = 1 << 20

_WORD = [b >= 0x80 or chr(b).isalnum() for b in range(256)]
#: Bytes as words have them: letters in lower case, separators as spaces.
NORMAL = bytes(ord(chr(b).lower()) if b < 0x80 and _WORD[b] else b if _WORD[b] else 0x20 for b in range(256))


# -- CRC-32 over GF(2) ----------------------------------------------------------------------------------------

def _byte_table() -> np.ndarray:
    """The register after one byte, for each value of its low byte."""
    r = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        r = (r >> np.uint32(1)) ^ np.where(r & np.uint32(1), np.uint32(0xEDB88320), np.uint32(0))
    return r


_STEP = _byte_table()


def _zero_byte(r: np.ndarray) -> np.ndarray:
    return (r >> np.uint32(8)) ^ _STEP[r & np.uint32(255)]


def _applied(table: np.ndarray, r: np.ndarray) -> np.ndarray:
    """A matrix, given as its images of the 4 x 256 values of single bytes, applied to registers."""
    return (table[0][r & np.uint32(255)] ^ table[1][(r >> np.uint32(8)) & np.uint32(255)]
            ^ table[2][(r >> np.uint32(16)) & np.uint32(255)] ^ table[3][r >> np.uint32(24)])


def _shift_tables() -> tuple[np.ndarray, list[np.ndarray]]:
    """Shifts by 0..63 zero bytes (side by side, for lookups by length), and by 64, 128, 256, ... of them."""
    small = [np.arange(256, dtype=np.uint32)[None, :] << np.arange(0, 32, 8, dtype=np.uint32)[:, None]]
    for _ in range(64):
        small.append(_zero_byte(small[-1]))
    large = [small.pop()]
    for _ in range(31):
        large.append(np.stack([_applied(large[-1], row) for row in large[-1]]))
    return np.stack(small, axis=1).reshape(4, -1), large


_SMALL, _LARGE = _shift_tables()


def shifted(crc: np.ndarray, n: np.ndarray) -> np.ndarray:
    """CRCs followed by ``n`` zero bytes, without the CRC's own constants: the prefix's part in a longer CRC."""
    at = ((n & 63) << 8).astype(np.uint32)
    out = (_SMALL[0][at | crc & np.uint32(255)] ^ _SMALL[1][at | (crc >> np.uint32(8)) & np.uint32(255)]
           ^ _SMALL[2][at | (crc >> np.uint32(16)) & np.uint32(255)] ^ _SMALL[3][at | crc >> np.uint32(24)])
    rest, j = n >> 6, 0
    while rest.any():
        odd = np.flatnonzero(rest & 1)
        out[odd] = _applied(_LARGE[j], out[odd])
        rest, j = rest >> 1, j + 1
    return out


def _with_space(crc: np.ndarray) -> np.ndarray:
    """CRCs after one more byte, a space."""
    r = ~crc
    return ~((r >> np.uint32(8)) ^ _STEP[(r ^ np.uint32(0x20)) & np.uint32(255)])


def run_crcs(segments: list[tuple[list[bytes], int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """CRCs of all runs of 1 to 3 words in each segment, and the number of the segment's document.

    A segment is ``(words, carried, document)``: runs that end within its first ``carried`` words are left out.
    """
    words = [w for ws, _, _ in segments for w in ws]
    if not words:
        return np.array([], np.uint32), np.array([], np.int64)
    after = np.fromiter(accumulate(words, lambda c, w: zlib.crc32(w, zlib.crc32(b" ", c)), initial=0), np.uint32,
                        len(words) + 1)
    before = _with_space(after[:-1])                      # of the text up to each word
    after = after[1:]
    length = np.fromiter(map(len, words), np.int64, len(words))
    end = np.cumsum(length + 1)
    sizes = np.array([len(ws) for ws, _, _ in segments])
    segment = np.repeat(np.arange(len(segments)), sizes)
    place = np.arange(len(words)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    new = place >= np.array([c for _, c, _ in segments])[segment]
    document = np.array([d for _, _, d in segments])
    crcs, of = [], []
    for n in range(1, LONGEST + 1):
        last = np.flatnonzero(new & (place >= n - 1))
        first = last - (n - 1)
        crcs.append(after[last] ^ shifted(before[first], end[last] - end[first] + length[first]))
        of.append(document[segment[last]])
    return np.concatenate(crcs), np.concatenate(of)


def pieces(text: str):
    """The words of a text in pieces of bounded size: ``(words, carried)``, with two words of the piece before."""
    raw = text.encode().translate(NORMAL)
    at, held = 0, []
    while True:
        stop = len(raw) if len(raw) - at <= PIECE_BYTES else raw.find(b" ", at + PIECE_BYTES)
        stop = len(raw) if stop < 0 else stop
        words = raw[at:stop].split()
        yield held + words, len(held)
        if stop >= len(raw):
            return
        at, held = stop, (held + words)[-(LONGEST - 1):]


def slices(batches):
    """The rows of record batches ``doc_id, text`` in slices: ids, and segments to be handled at once."""
    ids, segments, size = [], [], 0
    for batch in batches:
        for start in range(0, batch.num_rows, 500):
            part = batch.slice(start, 500)
            for doc_id, text in zip(part["doc_id"].to_pylist(), part["text"].to_pylist(), strict=True):
                more = False
                ids.append(doc_id)
                for words, carried in pieces(text):
                    if more:                              # a long text: its pieces one at a time
                        yield ids, segments, False
                        segments = []
                    segments.append((words, carried, len(ids) - 1))
                    more = True
                size += len(text)
                if size >= PIECE_BYTES:
                    yield ids, segments, True
                    ids, segments, size = [], [], 0
    if ids:
        yield ids, segments, True


# -- the operator ---------------------------------------------------------------------------------------------

def _texts(rows: DataFrame, text_col: str, id_col: str | None = None) -> DataFrame:
    doc_id = F.col(id_col).cast("long") if id_col else F.lit(None).cast("long")
    return rows.select(doc_id.alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def bucket_counts(rows: DataFrame, text_col: str = "text", buckets: int = BUCKETS) -> np.ndarray:
    """How many features of all texts fall into each bucket; a task sends a row per bucket."""
    schema = pa.schema([("bucket", pa.int32()), ("n", pa.int64())])

    def count(batches):
        seen = np.zeros(buckets, np.int64)
        for _, segments, _ in slices(batches):
            seen += np.bincount(run_crcs(segments)[0] % np.uint32(buckets), minlength=buckets)
        at = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(seen[at], pa.int64())], schema=schema)

    total = np.zeros(buckets, np.int64)
    for row in (_texts(rows, text_col).mapInArrow(count, "bucket int, n long").groupBy("bucket")
                .agg(F.sum("n").alias("n")).collect()):            # a row per bucket
        total[row["bucket"]] = row["n"]
    return total


def gains(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the log ratio of the smoothed shares of each bucket, rounded down."""
    raw_all, target_all, n = float(raw.sum()), float(target.sum()), float(len(raw))
    return np.array([math.floor(1000 * math.log((t + 1.0) * (raw_all + n) / ((s + 1.0) * (target_all + n))))
                     for s, t in zip(raw.tolist(), target.tolist(), strict=True)], np.int64)


def gumbel(doc_id: int | None, seed: int) -> int:
    """Thousandths of the Gumbel number of an id, rounded down."""
    h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def scores(docs: DataFrame, gain: np.ndarray, seed: int = 42, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_words, n_features, weight, score`` of every row."""
    fields = ("doc_id", "n_words", "n_features", "weight", "score")
    schema = pa.schema([(f, pa.int64()) for f in fields])

    def run(batches):
        words = features = weight = None
        for ids, segments, complete in slices(batches):
            more = np.zeros((3, len(ids)), np.int64)
            if words is not None:                         # sums of a long text's pieces so far
                more[:, :len(words)] += (words, features, weight)
            crcs, of = run_crcs(segments)
            words, features, weight = more
            for ws, carried, d in segments:
                words[d] += len(ws) - carried
            features += np.bincount(of, minlength=len(ids))
            np.add.at(weight, of, gain[crcs % np.uint32(len(gain))])
            if complete:
                drawn = np.array([gumbel(i, seed) for i in ids], np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (
                    ids, words, features, weight, weight + drawn)], schema=schema)
                words = None

    return _texts(docs, text_col, id_col).mapInArrow(run, ", ".join(f"{f} long" for f in fields))


def draw(scored: DataFrame, percent: int = 5, min_words: int = 20) -> DataFrame:
    """``scored`` with the ``rank`` of the drawn rows: the highest scores of all rows with enough words.

    Rows are dealt into ranges of descending score, each sorted on its own; a rank is the place in the range and the
    number of rows in all ranges before.  Only those numbers (one a range) go through the driver.
    """
    spark = scored.sparkSession
    folder = work_folder(spark, "importance-draw")
    rows = written(scored.withColumn("row", F.monotonically_increasing_id()), f"{folder}/scored")
    able = F.col("n_words") >= min_words
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("row")]
    # the row's number splits equal rows over ranges; the id below holds the range and the place in it
    ranged = written(rows.where(able).repartitionByRange(parts, *order).sortWithinPartitions(*order)
                     .withColumn("at", F.monotonically_increasing_id()), f"{folder}/ranged")
    part, place = F.shiftright("at", 33), F.col("at").bitwiseAND((1 << 33) - 1)
    sizes = {r["part"]: r["n"] for r in ranged.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n")).collect()}
    drawn, base, bases = sum(sizes.values()) * percent // 100, 0, []
    for p in sorted(sizes):
        bases.append((p, base))
        base += sizes[p]
    table = spark.createDataFrame(bases, "part long, base long")
    ranked = ranged.withColumn("part", part).join(F.broadcast(table), "part").withColumn("rank", F.col("base") + place + 1)
    names = [c for c in scored.columns]
    return (ranked.select(*names, F.when(F.col("rank") <= drawn, F.col("rank")).alias("rank"))
            .unionByName(rows.where(~able).select(*names, F.lit(None).cast("long").alias("rank"))))


def resample(docs: DataFrame, target: DataFrame, percent: int = 5, min_words: int = 20, seed: int = 42,
             id_col: str = "doc_id", text_col: str = "text", target_col: str = "text") -> DataFrame:
    """``doc_id, n_words, n_features, weight, score, rank`` of every row of ``docs``; undrawn rows have no rank."""
    gain = gains(bucket_counts(docs, text_col), bucket_counts(target, target_col))
    return draw(scores(docs, gain, seed, id_col, text_col), percent, min_words)
