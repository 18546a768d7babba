"""Ranges of JSON arrays and of CSV files with quoted line breaks, against the ``json`` and ``csv`` libraries."""
import csv
import io
import json
import os
import random
import tempfile

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from qualitas.sources import splits


class Memory:
    """A file in memory."""

    def __init__(self, raw):
        self.raw = raw

    def read(self, start, stop):
        return self.raw[start:stop]


def by_ranges(fmt, raw, split):
    """All rows of a file read in ranges of ``split`` bytes, as the Spark job does it."""
    state, out = fmt.initial, []
    for start in range(0, len(raw), split):
        stop = min(len(raw), start + split)
        out += fmt.parse(Memory(raw), len(raw), start, stop, state)
        state = fmt.step(state, fmt.summary(raw[start:stop]))
    return out


JSON_VALUES = st.recursive(st.none() | st.booleans() | st.integers() | st.text('ab"\\[]{},: \néu', max_size=8),
                           lambda x: st.lists(x, max_size=3) | st.dictionaries(st.text('a"\\]}', max_size=3), x, max_size=3),
                           max_leaves=8)
RECORDS = st.dictionaries(st.text('k"\\{,', max_size=3), JSON_VALUES, max_size=3)


@settings(max_examples=40, deadline=None)
@given(st.lists(st.lists(RECORDS, max_size=4), max_size=3), st.sampled_from([None, 1]), st.booleans(),
       st.sampled_from(["", "\n", " \r\n "]))
def test_records_equal_the_library_at_every_split_size(arrays, indent, ascii_only, glue):
    raw = glue.join(json.dumps(a, indent=indent, ensure_ascii=ascii_only) for a in arrays).encode()
    want = [r for a in arrays for r in a]
    for split in {1, 2, 3, 5, 8, 13, 40, 200, len(raw) + 1}:
        rows = by_ranges(splits.JsonArrays(), raw, split)
        assert [json.loads(t) for _, t, _ in rows] == want and not any(p for *_, p in rows), split
        assert all(raw[o:].strip().startswith(t.encode()) for o, t, _ in rows)


BAD = [(b'[{"a":1},{"a":}, 7, {"b":2}]', [None, "not JSON", "not a record", None]),
       (b'[{"a":1},{"a":2', [None, "the file ends within an array"]),
       (b'[{"a":1}] x [{"a":2}]', [None, "text outside an array", None]), (b'{"a":[{"b":1},{"c":2}]}', ["not an array"]),
       (b'[{"a":"\xff"},{"b":1}]', ["not UTF-8", None]), (b'[{"a":1},]', [None, "not JSON"]), (b"[]", []), (b" \n", []),
       (b'\xef\xbb\xbf[{"a":1}]', [None]), (b'"x"', ["text outside an array"]), (b'[{"a":1}]]', [None, "text outside an array"]),
       (b'[{"a":"\\"},{"}]', [None]), (b'[null,[{"a":1}]]', ["not a record", "not a record"])]


@pytest.mark.parametrize(("raw", "problems"), BAD)
def test_problems_one_by_one_at_every_split_size(raw, problems):
    for split in range(1, len(raw) + 2):
        rows = sorted(by_ranges(splits.JsonArrays(), raw, split), key=lambda r: r[0])
        # stray text may be reported in parts
        seen = [p for i, (*_, p) in enumerate(rows) if not (i and p == rows[i - 1][2] == "text outside an array")]
        assert seen == problems, split


CSV_FIELDS = st.text('a,"\n\r é', max_size=6)


@settings(max_examples=80, deadline=None)
@given(st.lists(st.lists(CSV_FIELDS, min_size=1, max_size=4), max_size=6), st.sampled_from(["\n", "\r\n", "\r"]),
       st.sampled_from([csv.QUOTE_MINIMAL, csv.QUOTE_ALL]))
def test_rows_equal_the_csv_library_at_every_split_size(rows, end, quoting):
    text = io.StringIO()
    csv.writer(text, lineterminator=end, quoting=quoting).writerows(rows)
    check_csv(text.getvalue())


@settings(max_examples=80, deadline=None)
@given(st.text('ab,"\n\r', max_size=60))
def test_any_text_equals_the_csv_library(text):
    check_csv(text)


def test_byte_order_mark_before_a_quoted_field():
    raw = splits.BYTE_ORDER_MARK + b'"a\nb",c\n1,2\n'
    for split in (3, 4, 7, 100):
        fmt, state, out = splits.CsvRows(), (splits.ROW,), []
        for start in range(0, len(raw), split):
            stop = min(len(raw), start + split)
            out += fmt.parse(Memory(raw), len(raw), start, stop, state)
            part = raw[start:stop]
            state = fmt.step(state, fmt.summary(part.removeprefix(splits.BYTE_ORDER_MARK) if not start else part))
        assert out == [(3, ["a\nb", "c"]), (11, ["1", "2"])], split


def check_csv(text):
    raw = text.encode()
    want = [f for f in csv.reader(io.StringIO(text, newline="")) if f]
    for split in {1, 2, 3, 5, 8, 21, len(raw) + 1}:
        assert [f for _, f in by_ranges(splits.CsvRows(), raw, split)] == want, split


def landed(files):
    folder = tempfile.mkdtemp(prefix="qualitas-splits-")
    for name, raw in files.items():
        with open(os.path.join(folder, name), "wb") as f:
            f.write(raw)
    return folder


def test_spark_reads_ranges_in_many_tasks(spark):
    rng = random.Random(1)
    records = [{"id": i, "t": "".join(rng.choices('x",[]{}\\\n', k=rng.randrange(30)))} for i in range(2000)]
    folder = landed({"a.json": json.dumps(records[:1500], indent=1).encode(), "b.json": json.dumps(records[1500:]).encode(),
                     "empty.json": b""})
    read = splits.json_elements(spark, folder, split_bytes=4096)
    got = read.collect()
    assert sorted((json.loads(r.text) for r in got), key=lambda r: r["id"]) == records
    assert read.rdd.getNumPartitions() > 20 and {os.path.basename(r.file) for r in got} == {"a.json", "b.json"}
    text = io.StringIO()
    csv.writer(text).writerows([[str(r["id"]), r["t"]] for r in records])
    folder = landed({"a.csv": text.getvalue().encode()})
    rows = splits.csv_rows(spark, folder, split_bytes=4096).collect()
    assert sorted((int(r.fields[0]), r.fields[1]) for r in rows) == [(r["id"], r["t"]) for r in records]
    assert len({r.offset for r in rows}) == len(rows)
