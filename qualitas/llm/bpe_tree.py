"""Operator 9: BPE encoding by tree concatenation, and decoding.

A long text is halved, as it is, until its parts are leaves, which many tasks encode at once.  Parts are joined
pairwise up the tree.  At each join the last ids of the left side and the first ones of the right side are decoded to
the text around the cut, and encoded again, pre-tokenizer and all.  The window grows until both sides agree with it: a
pre-token border lies in it on either side (white space behind a character that is none, where every text has one,
whatever stands around), and the ids between that border and the next are those which the side has there.  Left of the
first border and right of the last one the sides' ids stand; a side without such a border (an unsplit run of letters)
is taken into the window whole.

Texts with special tokens or white space of unsettled classes in them are encoded in one piece, as both may depend on
more than the window.  Nulls and empty texts encode to no ids.  Rows are never merged: repeated rows and repeated or
null ids each give their own row.  Columns other than the id and the text are ignored.
"""
from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from qualitas.llm.batches import flat_map
from qualitas.llm.bpe import ID, encoder

#: Texts with more code points are cut into parts of about this many.
LEAF_CHARS = 16_384

#: Ids on either side of a cut that the first window has.
WINDOW_IDS = 16

_IDS = pa.schema([("doc_id", pa.int64()), ("ids", pa.binary())])
_PARTS = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("part", pa.int32()), ("chunk", pa.string())])
_ENCODED = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("part", pa.int32()), ("ids", pa.binary())])

#: The character before a border.
_BORDER = re.compile(r"\S(?=\s)")


def halves(text: str, leaf: int) -> list[str]:
    """The leaves of the binary tree over ``text``."""
    if len(text) <= leaf:
        return [text]
    middle = len(text) // 2
    return halves(text[:middle], leaf) + halves(text[middle:], leaf)


def _text(ids: np.ndarray, bytes_of) -> str | None:
    """The text of ids, or None if they begin or end within a character."""
    try:
        return b"".join([bytes_of[i] for i in ids.tolist()]).decode()
    except UnicodeDecodeError:
        return None


def _ids(enc, text: str) -> np.ndarray:
    return np.frombuffer(enc.encode(text), ID)


def join_sides(left: np.ndarray, right: np.ndarray, enc) -> np.ndarray:
    """Ids of the text whose two sides have the ids ``left`` and ``right``."""
    width = WINDOW_IDS
    while True:
        a, b = left[-width:], right[:width]
        all_left, all_right = len(a) == len(left), len(b) == len(right)
        before, after = _text(a, enc.bytes_of), _text(b, enc.bytes_of)
        width *= 2
        if before is None or after is None:
            continue
        first = [m.end() for m in _BORDER.finditer(before)][:2]
        last = [m.end() for m in _BORDER.finditer(after)][-2:]
        if (len(first) < 2 and not all_left) or (len(last) < 2 and not all_right):
            continue
        start, stop = 0 if all_left else first[0], len(after) if all_right else last[1]
        again = _ids(enc, before[start:] + after[:stop])
        head = tail = 0                                          # ids of the sides that the window replaces
        if not all_left:
            agreed = _ids(enc, before[first[0]:first[1]])
            head = len(left) - (len(a) - _count(a, before[:start], enc))
            if not (np.array_equal(left[head:head + len(agreed)], agreed) and np.array_equal(again[:len(agreed)], agreed)):
                continue
        if not all_right:
            agreed = _ids(enc, after[last[0]:last[1]])
            tail = _count(b, after[:stop], enc)
            if not (np.array_equal(right[tail - len(agreed):tail], agreed)
                    and np.array_equal(again[len(again) - len(agreed):], agreed)):
                continue
        return np.concatenate([left[:head], again, right[len(right) if all_right else tail:]])


def _count(ids: np.ndarray, text: str, enc) -> int:
    """How many of the ids make ``text``, which ends where a token does."""
    sizes = np.cumsum([len(enc.bytes_of[i]) for i in ids.tolist()])
    return int(np.searchsorted(sizes, len(text.encode()), "left")) + 1 if text else 0


def join_tree(leaves: list[np.ndarray], enc) -> np.ndarray:
    """Join the ids of neighbouring leaves pairwise until one sequence is left."""
    while len(leaves) > 1:
        leaves = [join_sides(*leaves[i:i + 2], enc) if i + 1 < len(leaves) else leaves[i]
                  for i in range(0, len(leaves), 2)]
    return leaves[0] if leaves else np.array([], ID)


def cut(text: str, enc, leaf: int) -> list[str]:
    """The parts of a long text that are encoded apart."""
    return halves(text, leaf) if enc.segments(text) == [("plain", text)] else [text]


def encode(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text",
           leaf_chars: int = LEAF_CHARS) -> DataFrame:
    """``doc_id, ids`` (little-endian unsigned 32-bit) of every row, for a byte-level tokenizer file."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def whole(batches):
        enc = encoder(tokenizer)
        yield from flat_map(batches, _IDS, lambda doc_id, text: ((doc_id, enc.encode(text)),))

    def parts(batches):
        enc = encoder(tokenizer)
        yield from flat_map(batches, _PARTS, lambda row, doc_id, text: (
            (row, doc_id, i, part) for i, part in enumerate(cut(text, enc, leaf_chars))))

    def leaves(batches):
        enc = encoder(tokenizer)

        yield from flat_map(batches, _ENCODED, lambda row, doc_id, part, chunk: ((row, doc_id, part, enc.encode(chunk)),))

    def joined(batches):
        enc = encoder(tokenizer)
        yield from flat_map(batches, _IDS, lambda doc_id, parts: (
            (doc_id, join_tree([np.frombuffer(p["ids"], ID) for p in parts], enc).tobytes()),))      # sorted by part

    short = rows.where(F.length("text") <= leaf_chars).mapInArrow(whole, "doc_id long, ids binary")
    long = (rows.where(F.length("text") > leaf_chars)
            .select(F.monotonically_increasing_id().alias("row"), "doc_id", "text")
            .mapInArrow(parts, "row long, doc_id long, part int, chunk string")
            .repartition("row", "part")
            .mapInArrow(leaves, "row long, doc_id long, part int, ids binary")
            .groupBy("row", "doc_id")
            .agg(F.sort_array(F.collect_list(F.struct("part", "ids"))).alias("parts"))
            .select("doc_id", "parts")
            .mapInArrow(joined, "doc_id long, ids binary"))
    return short.unionAll(long)


def decode(encoded: DataFrame, tokenizer: str, made=None, made_ddl: str = "ids binary, text string") -> DataFrame:
    """``doc_id`` and what ``made(ids, text)`` gives, in the columns of ``made_ddl``; the ids and the text by default.

    The text is what the ids stand for, special tokens included.
    """
    columns = [c.split() for c in made_ddl.split(", ")]
    types = {"binary": pa.binary(), "string": pa.string(), "long": pa.int64()}
    schema = pa.schema([("doc_id", pa.int64()), *((name, types[kind]) for name, kind in columns)])

    def texts(batches):
        enc = encoder(tokenizer)

        def row(doc_id, ids):
            text = enc.decode(ids)
            yield (doc_id, *(made(ids, text) if made else (ids, text)))
        yield from flat_map(batches, schema, row)
    return encoded.select("doc_id", "ids").mapInArrow(texts, f"doc_id long, {made_ddl}")
