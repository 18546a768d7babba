"""Every stage of the pipeline against brute force on its own input, and the pipeline as a whole."""
import zlib

import numpy as np

import corpus_pipeline as cp
from qualitas.llm import mil_quality, pii_weak, queries

from .test_bpe import BYTE, library
from .test_packing_and_files import checked
from .test_superminhash import plain_classes

SF = "/root/testdata/sf0.001"


def as_rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def packed(rows):
    """Packed rows as the packing test wants them."""
    class Row:
        def __init__(self, r):
            self.__dict__ = r.asDict()
            self.ids_crc32 = zlib.crc32(bytes(r.ids))
            assert len(r.ids) == 4 * r.length
    return [Row(r) for r in rows]


def test_stages_on_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = docs.collect()

    model = mil_quality.train(docs, queries.learnable(spark.read.parquet(f"{SF}/labels.parquet")))
    good = cp.keep_quality(spark, docs, SF)
    want = sorted((tuple(r) for r in rows if model.score(r.text.encode()) >= 0.7), key=repr)
    assert as_rows(good) == want and 0 < len(want) < len(rows) and good.columns == docs.columns

    single = cp.drop_near_duplicates(spark, docs, SF)
    stay = {d for d, _, c in plain_classes([(r.doc_id, r.text) for r in rows], words=5) if d == c}
    assert as_rows(single) == sorted((tuple(r) for r in rows if r.doc_id in stay), key=repr)
    assert len(stay) < len(rows) and single.columns == docs.columns

    masked = cp.mask_personal_data(spark, docs, SF)
    model = pii_weak.train(pii_weak.vote_counts(docs))
    new = {r.doc_id: pii_weak.masked(r.text, model) for r in rows}
    assert as_rows(masked) == sorted(((r.doc_id, new[r.doc_id], r.lang, r.source, len(new[r.doc_id])) for r in rows), key=repr)
    assert any(new[r.doc_id] != r.text for r in rows)

    got = cp.pack_sequences(spark, docs, SF).collect()
    checked(packed(got), dict(zip([r.doc_id for r in rows], library(BYTE, [r.text for r in rows]))), 2048)


def test_run_is_the_stages_in_turn(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    got = cp.run(spark, SF).collect()
    ids = {r.doc_id for r in got}
    assert ids < {d.doc_id for d in docs}
    n = len({r.sequence_id for r in got})
    assert n <= 1.02 * sum(r.length for r in got) / 2048 + 1
    assert all(r.ids[-4:] == bytes(4) for r in got if r.start + r.length == max(
        x.start + x.length for x in got if x.doc_id == r.doc_id))
    assert np.frombuffer(b"".join(bytes(r.ids) for r in got), "<u4").max() < 50_257


def test_odd_rows_pass_every_stage(spark):
    rows = [(1, None, None, None, None, 5), (None, "no id", "en", "s", 5, None), (2, "", "en", None, 0, 1),
            (3, "mail a@b.org " * 30, "en", "s", 390, 1), (3, "mail a@b.org " * 30, "en", "s", 390, 1),
            (4, "mail a@b.org " * 30, "en", "s", 390, 1), (5, "x" * 50_000, "en", "s", 50_000, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, node int")
    for name, stage in cp.STAGES[:3]:
        for these in (docs, docs.limit(0)):
            out = stage(spark, these, SF)
            assert out.columns == docs.columns and out.count() <= len(rows), name
    single = cp.drop_near_duplicates(spark, docs, SF)
    assert sorted(str(r.doc_id) for r in single.collect()) == ["1", "2", "3", "5", "None"]
    two = spark.createDataFrame([(1, "one text of the id", "en", "s", 5), (1, "another text altogether", "en", "s", 5),
                                 (1, "one text of the id", "en", "s", 5)], docs.drop("node").schema)
    assert sorted(r.text for r in cp.drop_near_duplicates(spark, two, SF).collect()) == [
        "another text altogether", "one text of the id"]
    assert cp.pack_sequences(spark, docs.limit(0), SF).count() == 0
    assert sum(r.length for r in cp.pack_sequences(spark, docs, SF).collect()) > 0
