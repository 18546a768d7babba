"""Encoder, tree concatenation and decoding against the tokenizers library itself."""
import functools
import random

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from qualitas.llm import bpe, bpe_tree

BYTE = public_tokenizers.path("byte_bpe_50k.json")
WORD = public_tokenizers.path("word_bpe_49k.json")
ALPHABET = list("ab'stre IX09 \n\t\r.,!?-é߀") + ["\x1c", "\x85", " ", " ", "　", "漢", "字", "İ", "Σ", "ς",
                                                   "é", "́", "😀", "<|endoftext|>", "<|startoftext|>", "  ", "\n\n", "don't", "﻿"]


@functools.cache
def loaded(path):
    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return t


def library(path, texts):
    t = loaded(path)
    return [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]


def ids(raw):
    return np.frombuffer(raw, bpe.ID).tolist()


@pytest.mark.parametrize("path", [BYTE, WORD])
@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(ALPHABET), max_size=40).map("".join))
def test_encoder_equals_library(path, text):
    assert ids(bpe.encoder(path).encode(text)) == library(path, [text])[0]


@pytest.mark.parametrize("path", [BYTE, WORD])
@settings(max_examples=200, deadline=None)
@given(st.text(max_size=60))
def test_encoder_equals_library_on_any_text(path, text):
    assert ids(bpe.encoder(path).encode(text)) == library(path, [text])[0]


def test_decode_equals_library():
    enc, t = bpe.encoder(BYTE), Tokenizer.from_file(BYTE)
    for text in ("", "a b\n c", "<|endoftext|>x", "漢字 😀 é"):
        raw = enc.encode(text)
        assert enc.decode(raw) == t.decode(ids(raw), skip_special_tokens=False) == text


def test_tree_concatenation_of_unsplit_text(spark):
    rng = random.Random(3)
    texts = ["", None, "short text", "x" * 5000, "ab" * 3000 + " tail", " " * 4000 + "x", "漢字" * 900,
             "".join(rng.choice("thneaor") for _ in range(20000)),
             "".join(rng.choice("thneaor 1!") for _ in range(20000)),
             "".join(rng.choice(ALPHABET) for _ in range(6000)), "<|endoftext|>" * 300, "\n" * 3000]
    rows = [(i, t, "x") for i, t in enumerate(texts)] + [(2, "short text", "y"), (None, "no id", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    want = sorted(((i, l) for (i, t, _), l in zip(rows, library(BYTE, [t or "" for _, t, _ in rows]))), key=repr)
    for leaf in (64, 257, 100_000):
        got = bpe_tree.encode(docs, BYTE, leaf_chars=leaf).collect()
        assert sorted(((r.doc_id, ids(r.ids)) for r in got), key=repr) == want
    back = bpe_tree.decode(bpe_tree.encode(docs, BYTE, leaf_chars=64), BYTE).collect()
    assert sorted((r.text for r in back)) == sorted(t or "" for _, t, _ in rows)


def test_long_documents_are_joined_in_windows(spark, monkeypatch):
    """Every long text of the documents goes through joins, most of which look at a small window only."""
    joins, encoded = [], []
    join, encode = bpe_tree.join_sides, bpe_tree._ids
    monkeypatch.setattr(bpe_tree, "join_sides", lambda *a: joins.append(1) or join(*a))
    monkeypatch.setattr(bpe_tree, "_ids", lambda enc, text: encoded.append(len(text)) or encode(enc, text))
    enc = bpe.encoder(BYTE)
    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    for text in texts:
        parts = bpe_tree.cut(text, enc, 500)
        before = len(joins)
        got = bpe_tree.join_tree([np.frombuffer(enc.encode(p), bpe.ID) for p in parts], enc)
        assert got.tolist() == library(BYTE, [text])[0] and len(joins) - before == len(parts) - 1
    assert len(joins) > 500 and sum(encoded) < 0.5 * sum(map(len, texts))
    long = [t for t in texts if len(t) > bpe_tree.LEAF_CHARS]
    assert long and all(len(bpe_tree.cut(t, enc, bpe_tree.LEAF_CHARS)) > 1 for t in long)


def test_cuts_within_words_spaces_and_characters():
    enc = bpe.encoder(BYTE)
    rng = random.Random(8)
    for _ in range(300):
        text = "".join(rng.choice(["don't", " ", "  ", "\n", "a", "we'll", "12", "é", "漢字", "😀", "...", "x" * 40]) for _ in range(60))
        parts = bpe_tree.halves(text, rng.randrange(3, 40))
        got = bpe_tree.join_tree([np.frombuffer(enc.encode(p), bpe.ID) for p in parts], enc)
        assert got.tolist() == library(BYTE, [text])[0], parts


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert bpe_tree.decode(bpe_tree.encode(docs, BYTE), BYTE).count() == 0
