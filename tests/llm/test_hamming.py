"""Top-k search against brute force, with hot codes, ties and odd rows."""
import random

import duckdb
import pytest

from qualitas.llm import hamming_topk, queries

SF = "/root/testdata/sf0.001"
SCHEMA = "vec_id long, embedding array<double>, distance int, code string"


def plain(rows, asked, k):
    sign = lambda v: [x is not None and x > 0 for x in v]
    there = [(i, sign(v)) for i, v in rows if i is not None and v is not None]
    out = []
    for i, v in asked:
        if i is None or v is None:
            continue
        near = sorted((sum(a != b for a, b in zip(sign(v), c)), j) for j, c in there)[:k]
        out += [(i, r + 1, j, d) for r, (d, j) in enumerate(near)]
    return sorted(out)


@pytest.mark.parametrize(("dimensions", "k"), [(12, 3), (20, 10)])
def test_against_brute_force(spark, dimensions, k):
    rng = random.Random(dimensions)
    centres = [[rng.choice([-1.0, 1.0]) for _ in range(dimensions)] for _ in range(4)]
    rows = []
    for i in range(300):
        v = [x if rng.random() > 0.12 else -x for x in rng.choice(centres)]
        rows.append((i, centres[0] if i % 3 == 0 else v))
    rows += [(7, rows[7][1]), (None, centres[1]), (900, None), (901, [None, float("nan")] + centres[2][2:])]
    asked = [r for r in rows if r[0] is not None and r[0] % 20 == 0] + [(500, [-x for x in centres[0]])]
    make = lambda rs: spark.createDataFrame([(*r, 1, "x") for r in rs], SCHEMA)
    got = sorted(map(tuple, hamming_topk.top_k(make(rows), make(asked), k).collect()))
    want = [(a, r, j, d) for a, r, j, d in plain([(i, v and [0 if x is None or x != x else x for x in v]) for i, v in rows],
                                                 asked, k)]
    assert got == want


def test_few_and_no_rows(spark):
    rows = spark.createDataFrame([(1, [1.0, -1.0]), (2, [1.0, 1.0])], "vec_id long, embedding array<double>")
    assert sorted(map(tuple, hamming_topk.top_k(rows, rows.where("vec_id = 1"), 10).collect())) == [(1, 1, 1, 0), (1, 2, 2, 1)]
    assert hamming_topk.top_k(rows.limit(0), rows, 10).count() == 0
    assert hamming_topk.top_k(rows, rows.limit(0), 10).count() == 0
    uneven = spark.createDataFrame([(1, [1.0, -1.0]), (2, [1.0])], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="components"):
        hamming_topk.top_k(uneven, uneven, 2).collect()


def test_oracle(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{SF}/embeddings.parquet'")
    names = "query_id, rank, neighbour_id, distance"
    want = con.execute(f"SELECT {names} FROM ({queries.OP5_SQL}) ORDER BY 1, 2").fetchall()
    got = queries.op5_hamming_topk(spark, SF).select(*names.split(", ")).orderBy("query_id", "rank").collect()
    assert [tuple(r) for r in got] == want
