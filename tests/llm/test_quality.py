"""The quality classifier: gradients, held-out accuracy, odd rows."""
import zlib

import numpy as np

from qualitas.llm import mil_quality as mil
from qualitas.llm import queries

SF = "/root/testdata/sf0.01"


def test_gradient_against_differences():
    rng = np.random.default_rng(0)
    shapes = {"encode": (mil.SIZE, mil.HIDDEN), "encode0": (mil.HIDDEN,), "tanh": (mil.HIDDEN, mil.ATTENTION),
              "gate": (mil.HIDDEN, mil.ATTENTION), "attend": (mil.ATTENTION,), "score": (mil.HIDDEN,), "score0": ()}
    model = mil.Model({k: np.asarray(rng.normal(0, 0.5, s)) for k, s in shapes.items()})
    x, starts, y = rng.normal(0, 1, (9, mil.SIZE)), np.array([0, 2, 3]), np.array([1.0, 0.0, 1.0])

    def loss():
        p = model.forward(x, starts)["score"]
        return -np.mean(y * np.log(p) + (1 - y) * np.log(1 - p))
    slopes = model.gradient(x, starts, y)
    for name, w in model.weights.items():
        flat, d = w.reshape(-1), np.asarray(slopes[name]).reshape(-1)
        for i in range(0, len(flat), max(1, len(flat) // 5)):
            old = flat[i]
            flat[i] = old + 1e-5
            up = loss()
            flat[i] = old - 1e-5
            down = loss()
            flat[i] = old
            assert abs((up - down) / 2e-5 - d[i]) < 1e-5, name


def test_blocks_give_the_score_of_the_whole(monkeypatch):
    rng = np.random.default_rng(1)
    bags = [rng.normal(0, 1, (3, mil.SIZE)) + y for y in (0, 1) * 20]
    monkeypatch.setattr(mil, "STEPS", 20)
    model = mil.fit(bags, [0, 1] * 20)
    raw = bytes(rng.integers(32, 127, 20_000).astype(np.uint8))
    whole = float(model.forward(mil.passages(raw), np.zeros(1, int))["score"][0])
    assert abs(whole - model.score(raw)) < 1e-6
    monkeypatch.setattr(mil, "BLOCK", 3)
    assert abs(whole - model.score(raw)) < 1e-6


def test_op1_learns_quality(spark):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    rows = queries.op1_mil_quality(spark, SF).collect()
    assert len(rows) == spark.read.parquet(f"{SF}/documents.parquet").count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows)
    held = [(r.predicted, labels[r.doc_id]) for r in rows if r.held_out and r.doc_id in labels]
    assert len(held) > 50 and np.mean([p == y for p, y in held]) >= 0.95


def test_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(mil, "STEPS", 30)
    docs = spark.createDataFrame([(1, None, 0), (2, "", 1), (None, "good words", 1), (4, "BAD!! " * 99, None), (4, "BAD!! " * 99, None),
                                  (5, "x" * 300_000, 3)], "doc_id long, text string, quality int")
    labels = spark.createDataFrame([(1, 1), (4, 0), (4, None), (None, 1), (5, 1), (6, 0)], "doc_id long, quality int")
    model = mil.train(docs, labels)
    got = mil.score(docs, model).collect()
    assert len(got) == 6 and all(0 <= r.score <= 1 for r in got)
    assert len({r.score for r in got if r.doc_id == 4}) == 1
    assert mil.score(docs.limit(0), model).count() == 0
    assert mil.train(docs, labels.limit(0)).score(b"x") == 0.5
    assert mil.train(docs, labels.where("quality = 1")).score(b"x") == 1.0
    kept = mil.accepted(docs, mil.Model(constant=0.8), 0.7)
    assert kept.columns == docs.columns and kept.count() == 6
    assert mil.accepted(docs, mil.Model(constant=0.5), 0.7).count() == 0


def test_repeated_rows_are_learnt_once(spark, monkeypatch):
    learnt = []
    monkeypatch.setattr(mil, "fit", lambda bags, labels: learnt.append((bags, labels)))
    once = [(1, "good words here"), (2, "BAD!! " * 400), (3, None), (5, "x")]
    twice = once * 40 + [(2, f"BAD!! {i} " * 300) for i in range(40)]
    labels = spark.createDataFrame([(1, 1), (2, 0), (2, 1), (2, 0), (3, 0), (4, 1)], "doc_id long, quality int")
    for rows in (once, twice, twice[::-1]):
        mil.train(spark.createDataFrame(rows, "doc_id long, text string"), labels, train_docs=6)
    (bags, ys), (more, same), (again, as_well) = learnt
    # every label row counts once, however often its document is repeated, and which copy is taken is fixed
    assert ys == same == as_well and len(bags) == len(more) == len(again) == 5
    assert all(np.array_equal(a, b) for a, b in zip(more, again, strict=True))
    assert [np.array_equal(a, b) for a, b, y in zip(bags, more, ys, strict=True) if len(a) == 1] == [True] * 2
    raw = {t for d, t in twice if d == 2}
    taken = {bytes(b.tobytes()) for b in more if len(b) > 1}
    assert len(taken) == 1 and taken <= {mil.passages(t.encode()).astype(np.float16).tobytes() for t in raw}
