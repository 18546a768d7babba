"""Byte ranges of large text files whose format only a reader from the beginning seems able to split.

Whether a line break ends a CSV row, or a comma an element of a JSON array, depends on everything before it in the
file.  So a file of several ranges is read twice, both times by many tasks:

1. Every range is summarised without knowing how it begins: a small function from the state of the format's automaton
   at its first byte to the state behind its last one.
2. Summaries of a file are composed in order (a prefix scan over a few bytes a range), which gives each range the
   state it begins with.
3. Every range is read with that state: what begins in it belongs to it, and is read to its end beyond the range.

Files of one range need no summary.  Paths are those that Spark lists; ranges are opened by ``file:`` or by the
file systems that Arrow knows.
"""
from __future__ import annotations

import csv
import functools
import json
import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SPLIT_BYTES = 16 << 20
BYTE_ORDER_MARK = b"\xef\xbb\xbf"
#: Read at once behind the end of a range, and looked at once for the first row of one.
STEP_BYTES = 1 << 16


def files(spark: SparkSession, paths, glob: str | None = None) -> DataFrame:
    """``path, size`` of all files at or below ``paths``, from the store's listing alone."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.load(paths).select("path", F.col("length").alias("size"))


def ranges(listed: DataFrame, split_bytes: int) -> DataFrame:
    """``path, size, start, stop``: the byte ranges of files."""
    starts = F.sequence(F.lit(0).cast("long"), F.greatest(F.col("size") - 1, F.lit(0)), F.lit(split_bytes).cast("long"))
    return (listed.where("size > 0").select("path", "size", F.explode(starts).alias("start"))
            .withColumn("stop", F.least(F.col("start") + split_bytes, F.col("size"))))


class Opened:
    """A file opened for reading at places."""

    def __init__(self, path: str):
        scheme = re.match(r"([A-Za-z][A-Za-z0-9+.-]*):", path)
        if scheme is None or scheme[1] == "file":
            local = path if scheme is None else "/" + path[5:].lstrip("/")
            self.file = pyarrow.fs.LocalFileSystem().open_input_file(local)
        else:
            try:
                store, at = pyarrow.fs.FileSystem.from_uri(path)
            except (pa.ArrowInvalid, pa.ArrowNotImplementedError) as e:
                raise ValueError(f"{path}: byte ranges of this store can't be read; copy the file to a mounted folder") from e
            self.file = store.open_input_file(at)

    def read(self, start: int, stop: int) -> bytes:
        self.file.seek(start)
        return self.file.read(stop - start)

    def __enter__(self):
        return self

    def __exit__(self, *_):
        self.file.close()


class Format:
    """A text format as an automaton; states are short tuples of numbers."""

    initial: tuple[int, ...] = (0,)

    def summary(self, raw: bytes) -> bytes:
        """What ``raw`` does to any state."""
        raise NotImplementedError

    def step(self, state: tuple[int, ...], summary: bytes) -> tuple[int, ...]:
        """The state behind a range with this summary."""
        raise NotImplementedError

    def parse(self, file: Opened, size: int, start: int, stop: int, state: tuple[int, ...]) -> Iterator[tuple]:
        """The rows that begin in the range."""
        raise NotImplementedError


def _spread(df: DataFrame, ranges_in_all: int) -> DataFrame:
    return df.repartition(max(1, min(ranges_in_all, 50_000)), "path", "start")


def read(spark: SparkSession, paths, fmt: Format, schema: pa.Schema, ddl: str, split_bytes: int = SPLIT_BYTES,
         glob: str | None = None) -> DataFrame:
    """The rows of all files, parsed by ``fmt`` in ranges of about ``split_bytes``."""
    all_ranges = ranges(files(spark, paths, glob), split_bytes)
    # one job over the listing: how many ranges there are, and whether a file has several
    count = all_ranges.agg(F.count(F.lit(1)).alias("n"), F.max("start").alias("last")).first()
    several = bool(count["last"])
    key = pa.schema([("path", pa.string()), ("size", pa.int64()), ("start", pa.int64()), ("stop", pa.int64())])

    def summarised(batches):
        for batch in batches:
            for row in batch.to_pylist():
                with Opened(row["path"]) as file:
                    raw = file.read(row["start"], row["stop"])
                    made = fmt.summary(raw.removeprefix(BYTE_ORDER_MARK) if row["start"] == 0 else raw)
                yield pa.RecordBatch.from_pylist([row | {"summary": made}], schema=key.append(pa.field("summary", pa.binary())))

    def scanned(group: pa.Table) -> pa.Table:
        rows, state = sorted(group.to_pylist(), key=lambda r: r["start"]), fmt.initial
        for row in rows:
            row["state"], state = list(state), fmt.step(state, row.pop("summary"))
        return pa.Table.from_pylist(rows, schema=key.append(pa.field("state", pa.list_(pa.int64()))))

    columns = "path string, size long, start long, stop long"
    states = all_ranges.withColumn("state", F.array(*[F.lit(s).cast("long") for s in fmt.initial]))
    if several:
        long = all_ranges.where(F.col("size") > split_bytes)
        states = states.where(F.col("size") <= split_bytes).unionAll(
            _spread(long, count["n"]).mapInArrow(summarised, f"{columns}, summary binary")
            .groupBy("path").applyInArrow(scanned, f"{columns}, state array<long>"))

    def parsed(batches):
        held: list[tuple] = []
        size = 0
        for batch in batches:
            for row in batch.to_pylist():
                with Opened(row["path"]) as file:
                    for made in fmt.parse(file, row["size"], row["start"], row["stop"], tuple(row["state"])):
                        held.append((row["path"], *made))
                        size += sum(len(v) if isinstance(v, str) else sum(map(len, v)) for v in made
                                    if isinstance(v, (str, list)))
                        if len(held) >= 5_000 or size >= 4_000_000:
                            yield _batch(held, schema)
                            held, size = [], 0
        if held:
            yield _batch(held, schema)

    return _spread(states, count["n"]).mapInArrow(parsed, ddl)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)],
                                      schema=schema)


# -- JSON arrays ----------------------------------------------------------------------------------------------

_QUOTE, _SLASH, _COMMA = 34, 92, 44
_OPEN_ARRAY, _OPEN_OBJECT = 91, 123
_STRUCTURE = np.zeros(256, bool)
_STRUCTURE[[_COMMA, 91, 93, 123, 125]] = True
_RISE = np.zeros(256, np.int64)
_RISE[[91, 123]], _RISE[[93, 125]] = 1, -1
_BLANK = b" \t\r\n"


def lexed(raw: np.ndarray, lex: int) -> tuple[np.ndarray, int]:
    """Places of brackets and commas outside strings, and the lexical state behind ``raw``.

    The state has bit 0 within a string and bit 1 behind a backslash that escapes the next character.
    """
    quoted, escaped = lex & 1, lex >> 1
    slash = np.flatnonzero(raw == _SLASH)
    if escaped and len(slash) and slash[0] == 0:
        slash = slash[1:]                                     # escaped itself
        behind = np.array([], np.int64)
    else:
        behind = np.array([0] if escaped else [], np.int64)   # places of escaped characters behind runs
    if len(slash):
        first = np.flatnonzero(np.diff(slash, prepend=-2) != 1)
        length = np.diff(first, append=len(slash))
        behind = np.concatenate([behind, (slash[first] + length)[length % 2 == 1]])
    quotes = np.flatnonzero(raw == _QUOTE)
    if len(behind):
        quotes = quotes[~np.isin(quotes, behind)]
    at = np.flatnonzero(_STRUCTURE[raw])
    at = at[((np.searchsorted(quotes, at) + quoted) & 1) == 0]
    ends_escaped = bool(len(behind)) and int(behind[-1]) == len(raw)
    return at, ((len(quotes) + quoted) & 1) | ends_escaped << 1


_SUMMARY = struct.Struct("<bqqqb")


class JsonArrays(Format):
    """Elements of the arrays that a JSON file consists of (any number of them, with white space between).

    State: lexical state, nesting depth, kind of the value at depth 0 (0 none, 1 array, 2 object).  Rows are
    ``(offset, text, problem)``: a problem is an element that is not a JSON object, or text outside arrays, and
    every one is reported by itself.
    """

    initial = (0, 0, 0)

    def summary(self, raw: bytes) -> bytes:
        data, out = np.frombuffer(raw, np.uint8), b""
        for lex in range(4):
            at, after = lexed(data, lex)
            rise = _RISE[data[at]]
            before = np.cumsum(rise) - rise
            low = np.minimum(np.minimum.accumulate(np.concatenate([[0], before + rise])), 0)
            opens = np.flatnonzero((rise == 1) & (before <= low[:-1]))
            last = opens[-1] if len(opens) else None
            # exit state, change of depth, least depth, depth of the last bracket that may open a root, its kind
            out += _SUMMARY.pack(after, int(rise.sum()), int(low[-1]), 0 if last is None else int(before[last]),
                                 0 if last is None else 1 if data[at[last]] == _OPEN_ARRAY else 2)
        return out

    def step(self, state, summary):
        lex, depth, root = state
        after, change, low, opened, kind = _SUMMARY.unpack_from(summary, lex * _SUMMARY.size)
        return after, max(depth + change, change - low), kind if kind and depth + opened <= 0 else root

    def parse(self, file, size, start, stop, state):
        lex, depth, root = state
        raw = file.read(start, stop)
        data = np.frombuffer(raw, np.uint8)
        at, lex = lexed(data, lex)
        rise = _RISE[data[at]]
        level = np.concatenate([[depth], depth + np.cumsum(rise)])
        level -= np.minimum(np.minimum.accumulate(level), 0)              # a bracket too many closes nothing
        before = level[:-1]
        roots = np.flatnonzero((rise == 1) & (before == 0))
        kinds = np.concatenate([[root], np.where(data[at[roots]] == _OPEN_ARRAY, 1, 2)]).astype(np.int64)
        kind = kinds[np.searchsorted(roots, np.arange(len(at)), "right")]  # of the root that an event is in or opens
        opens = (rise == 1) & (before == 0)
        ends = (kind == 1) & (before == 1) & ((data[at] == _COMMA) | (rise == -1))
        mark = 3 if start < 3 and file.read(0, 3) == BYTE_ORDER_MARK else 0
        yield from self._outside(raw, start, at, before, rise, depth, mark)
        for i in roots.tolist():
            if data[at[i]] != _OPEN_ARRAY:
                yield start + int(at[i]), None, "not an array"
        events = np.flatnonzero((opens & (kind == 1)) | ends)
        places, closes = at[events].tolist(), (ends & (rise == -1))[events].tolist()
        firsts = opens[events].tolist()
        for i, p in enumerate(places):
            if closes[i]:
                continue
            if i + 1 < len(places):
                text, closed = raw[p + 1:places[i + 1]], closes[i + 1]
            else:
                text, closed = self._rest(file, size, stop, raw[p + 1:], lex, int(level[-1]))
            if firsts[i] and closed and not text.strip(_BLANK):
                continue                                                   # an empty array
            yield (start + p + 1, *self.element(text, closed is None))

    def _outside(self, raw, start, at, before, rise, depth, mark):
        """Text between arrays: the places where depth 0 begins and ends in the range."""
        edges = [max(0, mark - start)] if depth == 0 else []
        for i in np.flatnonzero(((rise == 1) & (before == 0)) | ((rise == -1) & (before <= 1))).tolist():
            if rise[i] == 1:
                if edges:
                    yield from self._stray(raw, start, edges.pop(), int(at[i]))
            else:
                if before[i] == 0:
                    yield start + int(at[i]), None, "text outside an array"
                edges = [int(at[i]) + 1]
        if edges:
            yield from self._stray(raw, start, edges[0], len(raw))

    def _stray(self, raw, start, a, b):
        text = raw[a:b]
        if text.strip(_BLANK):
            yield start + b - len(text.lstrip(_BLANK)), text.strip(_BLANK).decode("utf-8", "replace"), "text outside an array"

    def _rest(self, file, size, at, held, lex, depth):
        """The text of an element that goes on behind its range; whether the array ends with it (None: the file)."""
        parts = [held]
        while at < size:
            more = file.read(at, min(size, at + STEP_BYTES))
            data = np.frombuffer(more, np.uint8)
            places, lex = lexed(data, lex)
            rise = _RISE[data[places]]
            before = depth + np.cumsum(rise) - rise
            end = np.flatnonzero((before == 1) & ((data[places] == _COMMA) | (rise == -1)))
            if len(end):
                parts.append(more[:places[end[0]]])
                return b"".join(parts), bool(rise[end[0]] == -1)
            depth, at = depth + int(rise.sum()), at + len(more)
            parts.append(more)
        return b"".join(parts), None

    def element(self, raw: bytes, cut: bool) -> tuple[str, str | None]:
        """Text and problem of an element."""
        try:
            text = raw.strip(_BLANK).decode()
        except UnicodeDecodeError:
            return raw.strip(_BLANK).decode("utf-8", "replace"), "not UTF-8"
        if cut:
            return text, "the file ends within an array"
        try:
            made = json.loads(text)
        except ValueError:
            return text, "not JSON"
        except RecursionError:
            return text, "nested too deep"
        return text, None if isinstance(made, dict) else "not a record"


JSON_SCHEMA = pa.schema([("file", pa.string()), ("offset", pa.int64()), ("text", pa.string()), ("problem", pa.string())])


def json_elements(spark: SparkSession, paths, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """``file, offset, text, problem`` of every element of every array of the files."""
    return read(spark, paths, JsonArrays(), JSON_SCHEMA, "file string, offset long, text string, problem string", split_bytes)


# -- CSV with line breaks in quoted fields --------------------------------------------------------------------

#: States of the automaton: at the start of a row, at the start of a field, in a plain field, in a quoted one, behind a
#: quote in a quoted one.
ROW, FIELD, PLAIN, QUOTED, QUOTE = range(5)
#: The state after an ordinary character, a separator, a quote, a line break.
_AFTER = {"other": (PLAIN, PLAIN, PLAIN, QUOTED, PLAIN), "separator": (FIELD, FIELD, FIELD, QUOTED, FIELD),
          "quote": (QUOTED, QUOTED, PLAIN, QUOTE, QUOTED), "break": (ROW, ROW, ROW, QUOTED, ROW)}


@functools.cache
def _monoid():
    """All functions that texts can have on the states, as numbers, and the table of their compositions."""
    known = [tuple(range(5)), *_AFTER.values()]
    for f in known:                                          # grows until nothing new is found
        for g in _AFTER.values():
            made = tuple(g[s] for s in f)
            if made not in known:
                known.append(made)
    number = {f: i for i, f in enumerate(known)}
    after = np.array([[number[tuple(g[s] for s in f)] for g in known] for f in known], np.uint8)
    return np.array(known, np.uint8), after, {kind: number[f] for kind, f in _AFTER.items()}


class CsvRows(Format):
    """Rows of a CSV file (RFC 4180 quotes, any line break), read by the ``csv`` module from row starts on.

    State: that of the automaton.  Rows are ``(offset, fields)``; blank lines are left out.
    """

    initial = (ROW,)

    def __init__(self, separator: str = ","):
        self.separator = separator

    def _functions(self, raw: bytes) -> np.ndarray:
        _, _, kinds = _monoid()
        table = np.full(256, kinds["other"], np.uint8)
        table[ord(self.separator)], table[34], table[10], table[13] = (
            kinds["separator"], kinds["quote"], kinds["break"], kinds["break"])
        return table[np.frombuffer(raw, np.uint8)]

    def summary(self, raw: bytes) -> bytes:
        known, after, _ = _monoid()
        f = self._functions(raw)
        while len(f) > 1:                                    # neighbours composed pairwise
            if len(f) % 2:
                f = np.append(f, np.uint8(0))
            f = after[f[::2], f[1::2]]
        return known[f[0] if len(f) else 0].tobytes()

    def step(self, state, summary):
        return (summary[state[0]],)

    def _states(self, raw: bytes, state: int) -> np.ndarray:
        """The state behind each byte: compositions of all prefixes, by doubling."""
        known, after, _ = _monoid()
        f, reach = self._functions(raw), 1
        while reach < len(f):
            f = np.concatenate([f[:reach], after[f[:-reach], f[reach:]]])
            reach *= 2
        return known[f, state]

    def _row_start(self, file, size, at, state) -> int:
        """The first place from ``at`` on where a row begins, line breaks passed over."""
        while at < size:
            raw = file.read(at, min(size, at + STEP_BYTES))
            states = self._states(raw, state)
            before = np.concatenate([[state], states[:-1]])
            # where a row begins: at its start, and the character is no line break
            begins = np.flatnonzero((before == ROW) & (states != ROW))
            if len(begins):
                return at + int(begins[0])
            at, state = at + len(raw), int(states[-1])
        return size

    def parse(self, file, size, start, stop, state):
        if start == 0 and file.read(0, 3) == BYTE_ORDER_MARK:
            start = min(3, stop)
        first = self._row_start(file, size, start, state[0])
        if first >= stop:
            return
        # the state at the end of the range, to find where its last row ends
        raw = file.read(first, stop)
        last = self._row_start(file, size, stop, self.summary(raw)[ROW]) if stop < size else size
        raw += file.read(stop, last)
        at = first
        lines = _Lines(raw.decode("utf-8", "replace"))
        reader = csv.reader(lines, delimiter=self.separator)
        for fields in reader:
            if fields:
                yield at, fields
            at = first + lines.done


class _Lines:
    """The physical lines of a text for ``csv``, and how many bytes of it have been handed out."""

    def __init__(self, text: str):
        self.lines, self.done = re.finditer(r"[^\r\n]*(?:\r\n|\r|\n)|[^\r\n]+\Z", text), 0

    def __iter__(self):
        return self

    def __next__(self) -> str:
        line = next(self.lines)[0]
        self.done += len(line.encode())
        return line


CSV_SCHEMA = pa.schema([("file", pa.string()), ("offset", pa.int64()), ("fields", pa.list_(pa.string()))])


def csv_rows(spark: SparkSession, paths, split_bytes: int = SPLIT_BYTES, separator: str = ",") -> DataFrame:
    """``file, offset, fields`` of every row of the files, headers included."""
    return read(spark, paths, CsvRows(separator), CSV_SCHEMA, "file string, offset long, fields array<string>", split_bytes)
