"""Importance resampling against plain Python and DuckDB, and prefix CRCs against zlib."""
import hashlib
import math
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest

from qualitas.llm import importance_resampling as ir
from qualitas.llm import queries

SF = "/root/testdata/sf0.001"


def features(text):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return w, [" ".join(w[i:i + n]) for n in (1, 2, 3) for i in range(len(w) - n + 1)]


def plain(docs, target, percent=5, min_words=20, seed=42, buckets=10_000):
    """``doc_id, n_words, n_features, weight, score, rank`` by the definition."""
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    s, t = Counter(), Counter()
    for _, text in docs:
        s.update(map(bucket, features(text)[1]))
    for text in target:
        t.update(map(bucket, features(text)[1]))
    S, T = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (S + buckets) / ((s[b] + 1) * (T + buckets))))
    rows = []
    for doc_id, text in docs:
        w, f = features(text)
        weight = sum(gain(bucket(x)) for x in f)
        h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        rows.append([doc_id, len(w), len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), None])
    able = sorted((r for r in rows if r[1] >= min_words), key=lambda r: (-r[4], r[0] is None, r[0]))
    for rank, r in enumerate(able[:len(able) * percent // 100], 1):
        r[5] = rank
    return sorted(map(tuple, rows), key=repr)


@pytest.mark.parametrize("n", [0, 1, 5, 63, 64, 65, 1000, 70_000])
def test_shift_cancels_a_prefix(n):
    rng = random.Random(n)
    prefix, run = rng.randbytes(100), rng.randbytes(n)
    got = np.array([zlib.crc32(prefix + run)], np.uint32) ^ ir.shifted(np.array([zlib.crc32(prefix)], np.uint32), np.array([n]))
    assert got[0] == zlib.crc32(run)


@pytest.mark.parametrize("piece", [1, 7, 64, 1 << 20])
def test_every_run_has_its_crc(monkeypatch, piece):
    monkeypatch.setattr(ir, "PIECE_BYTES", piece)
    texts = ["", "One", "two  Words", "x" * 500 + " y", "É ß K z a-b_c", "a b c d e f g " * 9, "..."]
    for text in texts:
        got = [c for words, carried in ir.pieces(text) for c in ir.run_crcs([(words, carried, 0)])[0].tolist()]
        assert sorted(got) == sorted(zlib.crc32(f.encode()) for f in features(text)[1])


def drawn(spark, docs, target, **options):
    rows = spark.createDataFrame([(*d, "x", 5) for d in docs], "doc_id long, text string, bucket string, score int")
    items = spark.createDataFrame([(t, 1) for t in target], "text string, item_id long")
    out = ir.resample(rows, items, **options).select("doc_id", "n_words", "n_features", "weight", "score", "rank")
    return sorted(map(tuple, out.collect()), key=repr)


def test_documents_against_plain(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    target = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    got = queries.op12_importance_resampling(spark, SF).select("doc_id", "n_features", "weight", "score", "rank").collect()
    assert sorted(map(tuple, got), key=repr) == sorted(((r[0], *r[2:]) for r in plain(docs, target)), key=repr)


def test_oracle(spark):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    names = "doc_id, n_features, weight, score, rank"
    want = con.execute(f"SELECT {names} FROM ({queries.OP12_SQL}) ORDER BY 1").fetchall()
    got = queries.op12_importance_resampling(spark, SF).select(*names.split(", ")).orderBy("doc_id").collect()
    assert [tuple(r) for r in got] == want


def test_odd_rows_ties_and_repeats(spark, monkeypatch):
    rng = random.Random(3)
    words = ["alpha", "beta", "É", "n7", "delta"]
    docs = [(i, " ".join(rng.choices(words, k=rng.randrange(60)))) for i in range(60)]
    docs += [(7, "alpha beta " * 20)] * 40 + [(None, "beta " * 30), (None, None), (80, None), (81, ""), (82, "..."),
                                              (83, "word " * 30_000), (-4, "alpha " * 25)]
    target = ["alpha beta alpha", "", None, "beta"]
    got, want = drawn(spark, docs, target, percent=40), plain(docs, target, percent=40)
    # equal rows may swap their ranks: the ranks of each group of them are compared
    assert got == want
    assert drawn(spark, [], target) == [] and drawn(spark, docs[:3], []) == plain(docs[:3], [])
    one = drawn(spark, docs, target, percent=100)
    ranks = [r[5] for r in one if r[5]]
    assert sorted(ranks) == list(range(1, len(ranks) + 1)) and len(ranks) == sum(r[1] >= 20 for r in one)
