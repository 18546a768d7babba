"""Packing and token files against the tokenizers library and direct checks of their guarantees."""
import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from qualitas.llm import best_fit_packing as packing
from qualitas.llm import bpe, queries, token_files
from qualitas.session import work_folder

from .test_bpe import BYTE, WORD, library

SF = "/root/testdata/sf0.001"


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.integers(1, 60), st.integers(1, 40), max_size=30), st.integers(60, 90))
def test_plan_places_every_item_once_within_capacity(counts, capacity):
    runs, sequences = packing.plan(counts, capacity)
    filled = [[] for _ in range(sequences)]
    for n, count in counts.items():
        own = sorted((r for r in runs if r.length == n), key=lambda r: r.first)
        for i, r in enumerate(own):
            stop = own[i + 1].first if i + 1 < len(own) else count
            for rank in range(r.first, stop):
                filled[r.sequence + (rank - r.first) // r.each].append((r.offset + (rank - r.first) % r.each * n, n))
    assert sum(map(len, filled)) == sum(counts.values())
    for items in filled:
        at = 0
        assert sum(n * 3 > capacity for _, n in items) <= 2
        for offset, n in sorted(items):
            assert offset == at
            at += n
        assert 0 < at <= capacity
    total = sum(n * c for n, c in counts.items())
    assert sequences <= 2 * -(-total // capacity) + 1


def checked(rows, texts, capacity):
    """Rows against the contract; ``texts``: (doc_id, ids) of every input row."""
    by_doc = {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
    for doc_id, ids in texts.items():
        whole = np.array(ids + [0], "<u4")
        got = sorted(by_doc.pop(doc_id), key=lambda r: r.piece)
        assert [r.piece for r in got] == list(range(len(got)))
        at = 0
        for i, r in enumerate(got):
            assert r.start == at and zlib.crc32(whole[at:at + r.length].tobytes()) == r.ids_crc32
            assert r.length == capacity or i == 0
            at += r.length
        assert at == len(whole)
    assert not by_doc
    sequences = {}
    for r in rows:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for items in sequences.values():
        at = 0
        for offset, n in sorted(items):
            assert offset == at
            at += n
        assert at <= capacity
    return len(sequences)


def test_op2_on_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    rows = queries.op2_best_fit_packing(spark, SF).collect()
    texts = dict(zip([d.doc_id for d in docs], library(BYTE, [d.text for d in docs])))
    n = checked(rows, texts, 2048)
    assert n <= 1.02 * sum(len(i) + 1 for i in texts.values()) / 2048 + 1


def test_packing_of_odd_rows(spark):
    rng = random.Random(1)
    texts = [None, "", "a b", "a b", " ".join(rng.choice("and of the to".split()) for _ in range(500))]
    docs = spark.createDataFrame([(i, t, 7, "x") for i, t in enumerate(texts)],
                                 "doc_id long, text string, length int, sequence_id string")
    rows = packing.pack(packing.with_crc32(packing.pieces(docs, BYTE, 0, 16)), 16).collect()
    checked(rows, dict(enumerate(library(BYTE, [t or "" for t in texts]))), 16)
    assert packing.pack(packing.with_crc32(packing.pieces(docs.limit(0), BYTE, 0, 16)), 16).count() == 0


def test_op10_on_documents(spark):
    docs = sorted(spark.read.parquet(f"{SF}/documents.parquet").collect(), key=lambda d: d.doc_id)
    got = sorted(queries.op10_token_files(spark, SF).collect(), key=lambda r: r.doc_id)
    start = 0
    for d, ids, r in zip(docs, library(WORD, [d.text for d in docs]), got, strict=True):
        whole = np.array(ids + [2], "<u4")
        assert tuple(r) == (d.doc_id, start, len(whole), zlib.crc32(whole.tobytes()))
        start += len(whole)


def test_token_files_of_odd_rows(spark):
    rows = [(5, None), (None, "the end"), (5, ""), (3, "A b  c"), (3, "A b  c"), (None, None)]
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, ids string, part int")
    folder = work_folder(spark, "test-files")
    token_files.write(docs, folder, WORD, 2)
    got = sorted(token_files.read(spark, folder).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == [None, None, 3, 3, 5, 5]
    want = {(i, tuple(ids + [2])) for (i, _), ids in zip(rows, library(WORD, [t or "" for _, t in rows]))}
    assert {(r.doc_id, tuple(np.frombuffer(r.ids, bpe.ID).tolist())) for r in got} == want
    assert [r.start for r in got] == np.cumsum([0] + [r.n_tokens for r in got])[:-1].tolist()
    empty = work_folder(spark, "test-files")
    token_files.write(docs.limit(0), empty, WORD, 2)
    assert token_files.read(spark, empty).count() == 0


def test_files_need_a_mounted_folder():
    assert token_files.local_path("file:///a/b") == token_files.local_path("/a/b") == "/a/b"
    with pytest.raises(ValueError, match="mounted"):
        token_files.local_path("hdfs://store/a")
