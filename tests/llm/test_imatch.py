"""Fingerprints against DuckDB and on edge cases."""
import hashlib

import duckdb
from pyspark.sql import functions as F

from qualitas.llm import imatch, queries

SF = "/root/testdata/sf0.001"


def test_oracle(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    names = "doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next"
    want = con.execute(f"SELECT {names} FROM ({queries.OP7_SQL}) ORDER BY 1").fetchall()
    got = queries.op7_imatch(spark, SF).select(*names.split(", ")).orderBy("doc_id").collect()
    assert [tuple(r) for r in got] == want


def printed(spark, rows):
    docs = spark.createDataFrame([(*r, "x", "y") for r in rows], "doc_id long, text string, next_text string, term string")
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    buckets = imatch.lexicon(docs)
    out = imatch.with_next(docs.withColumn("fingerprint", imatch.fingerprint(F.col("text"), buckets)), ["text", "fingerprint"])
    return out.withColumn("edited", imatch.edited(F.col("text"), F.col("next_text")))


def test_next_document_edits_and_ties(spark):
    rows = [(50, "abcdef"), (-3, "x😀y"), (7, None), (7, ""), (60, "é"), (None, "null id"), (50, "abcdef"), (90, "long " * 50)]
    rows += [(1000 + 17 * i, f"w{i} shared words {i % 3}") for i in range(60)]
    order = sorted(rows, key=lambda r: (-(1 << 63) if r[0] is None else r[0], r[1] or ""))
    want = []
    for i, (doc_id, text) in enumerate(order):
        text, after = text or "", order[(i + 1) % len(order)][1] or ""
        half = len(text) // 2
        want.append((doc_id, text, text[:len(text) - half] + after[:half]))
    got = printed(spark, rows).select("doc_id", "text", "edited").collect()
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)


def test_equal_texts_have_equal_fingerprints_and_empty_ones_their_own(spark):
    rows = [(1, "alpha beta"), (2, "alpha beta"), (3, ""), (4, None), (5, "..."), (6, "BETA, alpha"), (7, "gamma")]
    got = {r.doc_id: r.fingerprint for r in printed(spark, rows).collect()}
    assert got[1] == got[2] == got[6] and got[3] == got[4] == "=" + hashlib.md5(b"").hexdigest() != got[5]


def test_small_tables(spark):
    assert printed(spark, []).count() == 0
    only = printed(spark, [(3, "abcd")]).collect()
    assert [(r.next_text, r.edited) for r in only] == [("abcd", "abab")]


def test_membership_is_exact_for_lexicons_of_any_size(spark):
    """A band of few or very many terms: what is outside, or only shares a bucket or its beginning, isn't known."""
    inside = [f"w{i}" for i in range(150_000)] + ["x" * 33, "x" * 5000, "é😀", "ab"]
    once = spark.range(1, numPartitions=8).select(F.explode(F.array(F.array_join(F.transform(
        F.sequence(F.lit(0), F.lit(149_999)), lambda i: F.concat(F.lit("w"), i.cast("string"))), " "),
        F.lit(" ".join(inside[150_000:])))).alias("text"))
    buckets = imatch.lexicon(once.unionAll(once).unionAll(once.limit(0)).select("text"))
    asked = spark.createDataFrame([(t,) for t in ["w7", "w149999", "x" * 33, "x" * 5000, "é😀", "ab", "w", "w150000",
                                                  "b", "a", "x" * 32, "x" * 4999, "é"]], "term string")
    out = {r.term: r.print for r in asked.select("term", imatch.fingerprint(F.col("term"), buckets).alias("print")).collect()}
    assert {t for t, p in out.items() if not p.startswith("=")} == set(out) & set(inside)


def test_band_is_bounded_and_does_not_fade_with_the_corpus(spark):
    """The same shares of terms give the same lexicon at ten times the rows, and never more than ``most`` terms."""
    rows = [f"often{i % 3} some{i % 20} once{i}" for i in range(200)]
    for times in (1, 10):
        docs = spark.createDataFrame([(f"{t} copy{n}",) for n in range(times) for t in rows], "text string")
        frequencies = imatch.document_frequencies(docs)
        found = {r.term for r in imatch.in_band(frequencies, docs.count(), most=100).collect()}
        assert {t for t in found if not t.startswith("copy")} == {f"often{i}" for i in range(3)} | {f"some{i}" for i in range(20)}
        assert all(imatch.in_band(frequencies, docs.count(), most=m).count() <= m for m in (1, 3, 10, 25, 1000))


def test_likeness(spark):
    pairs = [("a-b--", "a-c--"), ("a-b--", "a-b--"), ("=x", "=y"), ("=x", "a-b--"), ("--a-", "---a")]
    df = spark.createDataFrame(pairs, "a string, b string")
    assert [r[0] for r in df.select(imatch.likeness(F.col("a"), F.col("b"))).collect()] == [0.5, 1.0, 0.0, 0.0, 0.0]
