"""Ranked search against plain Python and DuckDB."""
import math
import random
import re
from collections import Counter

import duckdb
import numpy as np

from qualitas.llm import queries
from qualitas.llm import ranked_search as rs

SF = "/root/testdata/sf0.001"


def terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def plain(docs, items, k=20):
    tf = [(i, Counter(terms(t))) for i, t in docs]
    tf = [(i, c) for i, c in tf if c]
    N, L = len(tf), sum(sum(c.values()) for _, c in tf)
    df = Counter(t for _, c in tf for t in c)
    out = []
    for item_id, text in sorted(set(items), key=repr):
        scored = []
        for doc_id, c in tf:
            m = 100 - 25 + (25 * sum(c.values()) * N) // L
            score = sum(math.floor(1000 * math.log((2 * N + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 12 * m))
                        for t in terms(text))
            if score > 0 and doc_id is not None:
                scored.append((-score, doc_id))
        out += [(item_id, rank, d, -s) for rank, (s, d) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=repr)


def found(spark, docs, items, **options):
    d = spark.createDataFrame([(*x, "y") for x in docs], "doc_id long, text string, item_id string").repartition(5)
    i = spark.createDataFrame([(*x, 1) for x in items], "item_id long, text string, doc_id int")
    return sorted(map(tuple, rs.search(d, i, **options).collect()), key=repr)


def test_documents_against_plain_and_sql(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    got = sorted(map(tuple, queries.op13_ranked_search(spark, SF).collect()), key=repr)
    assert got == plain(docs, items) and len({r[0] for r in got}) == len(items)
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    assert sorted(con.execute(f"SELECT item_id, rank, doc_id, score FROM ({queries.OP13_SQL})").fetchall(), key=repr) == got


def test_whole_terms_ties_repeats_and_odd_rows(spark):
    rng = random.Random(5)
    vocabulary = ["ab", "abc", "a", "b", "É", "x1", "zz", "naïve", "k"]
    docs = [(i, " ,-"[i % 3].join(rng.choices(vocabulary, k=rng.randrange(30)))) for i in range(-20, 40)]
    docs += [(3, "ab abc")] * 7 + [(None, "ab"), (50, None), (51, ""), (52, "!!"), (53, "AB" * 100_000), (54, "ab " * 90_000),
                                   (55, "abab a b K")]
    items = [(1, "ab ab abc"), (2, "AB"), (2, "AB"), (2, "zz a"), (3, ""), (4, None), (5, "unseen"), (None, "x1 É"),
             (6, "a b k naïve " * 50)]
    for options in ({}, {"block_items": 2}, {"k": 3, "block_bytes": 5}):
        assert found(spark, docs, items, **options) == plain(docs, items, options.get("k", 20)), options
    assert found(spark, [], items) == [] and found(spark, docs, []) == [] and found(spark, [(1, "")], items) == []


def test_best_keeps_ties_by_id(monkeypatch):
    monkeypatch.setattr(rs, "PENDING", 4)
    rng = np.random.default_rng(2)
    best, rows = rs._Best(3, 4), []
    for _ in range(30):
        scores, ids = rng.integers(0, 5, (6, 3)), rng.integers(-50, 50, 6)
        best.add(scores, ids)
        rows += [(i, -int(scores[d, i]), int(ids[d])) for d in range(6) for i in range(3) if scores[d, i] > 0]
    best.reduce()
    got = sorted((int(i), -int(s), int(d)) for i, s, d in zip(*best.held))
    assert got == sorted(r for item in range(3) for r in sorted(x for x in rows if x[0] == item)[:4])
