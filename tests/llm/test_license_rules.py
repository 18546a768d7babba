"""License scans against their definition in plain Python, against DuckDB, and on odd rows."""
import random
import re
import re._parser as grammar

import duckdb
import pytest

from qualitas.llm import license_rules as lr
from qualitas.llm import queries

SF = "/root/testdata/sf0.001"
RULES = lr.signature_rules()


def words_of(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def plain(text, rules=RULES):
    """Number of words, base places, and the detections that stay."""
    words = words_of(text)
    found = sorted(set(lr.matches(rules, words)), key=lambda d: (d[0], -d[1], d[2]))
    open_ = [d for i, d in enumerate(found)
             if not any(e[0] <= d[0] and d[1] <= e[1] and (e[:2] != d[:2] or e[2] < d[2]) for e in found if e != d)]
    kept = []
    for d in open_:
        if not kept or d[0] >= kept[-1][1]:
            kept.append(d)
        elif d[2] < kept[-1][2]:
            kept[-1] = d
    return len(words), sorted(d for d in found if rules[d[2]].base), kept


def written_out(pattern, rng):
    """A random text that a rule's pattern matches."""
    def made(items):
        out = ""
        for op, value in items:
            kind = str(op)
            if kind == "LITERAL":
                out += chr(value)
            elif kind == "IN":
                c = rng.choice(value)
                out += chr(c[1]) if str(c[0]) == "LITERAL" else rng.choice("xé7")
            elif kind == "MAX_REPEAT":
                low, high, inner = value
                out += "".join(made(inner) for _ in range(rng.randint(low, min(high, 3))))
            elif kind == "SUBPATTERN":
                out += made(value[3])
            elif kind == "BRANCH":
                out += made(rng.choice(value[1]))
            else:
                raise AssertionError(kind)
        return out
    return made(grammar.parse(pattern))


def test_hundreds_of_rules_and_no_keyword_or_anchor_loses_a_match():
    rng, anchors = random.Random(1), lr.anchors(RULES)
    assert len(RULES) > 300
    for r in RULES:
        for _ in range(20):
            text = written_out(lr.spaced(r.pattern), rng)
            assert re.fullmatch(lr.spaced(r.pattern), text), r
            assert lr.literal(r.keyword) in text and any(a in text for a in anchors), (r, text)


def shown(row):
    return (row.n_words, sorted((d.start, d.end, d.rule) for d in row.base),
            [(d.start, d.end, d.rule) for d in row.detections])


def texts(n):
    rng = random.Random(n)
    fill = ["the", "Work", "is", "mit", "license", "2.0", "version", "gpl", "or", "later", "\n", "é"]
    for _ in range(n):
        parts = []
        for _ in range(rng.randrange(1, 6)):
            parts += rng.choices(fill, k=rng.randrange(6))
            r = rng.choice(RULES)
            parts.append(written_out(r.pattern, rng).title() if rng.random() < 0.5 else written_out(r.pattern, rng))
        yield rng.choice([" ", ", ", "-", "\n"]).join(parts)


def test_detections_equal_the_definition(spark):
    rows = [(i, t) for i, t in enumerate(texts(150))]
    rows += [(900, "Licensed under the MIT License / Apache License, Version 2.0"), (901, "GNU GPL v2 or later"),
             (902, "gnu lesser general public license version 2.1"), (903, "CC BY-NC-SA 4.0. cc by nc")]
    got = {r.doc_id: shown(r) for r in lr.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for doc_id, text in rows:
        assert got[doc_id] == plain(text), text
    by = {r[0]: {RULES[i].label for _, _, i in plain(r[1])[2]} for r in rows[-4:]}
    assert by == {900: {"mit", "apache-2"}, 901: {"gpl-2"}, 902: {"lgpl-2.1"}, 903: {"cc-by-nc-sa-4", "cc-by-nc"}}


def test_odd_rows(spark):
    long = "Under the MIT license, " * 4_000
    rows = [(1, None, "x"), (None, "cc by nc", "x"), (2, "", "x"), (2, "", "x"), (3, "...", "x"), (4, long, "x"),
            (5, "mit " * 50_000, "x"), (6, "CC by nc K license", "x"), (7, "x" * 300_000, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, words string")
    got = lr.scan(docs).collect()
    assert sorted((str(r.doc_id), shown(r)) for r in got) == sorted((str(i), plain_or_long(t, long)) for i, t, _ in rows)
    assert lr.scan(docs.limit(0)).count() == 0


def plain_or_long(text, long):
    if text != long:
        return plain(text)
    # each of the repetitions by itself
    one = plain("Under the MIT license, ")
    return (4 * 4_000, [(s + 4 * i, e + 4 * i, r) for i in range(4_000) for s, e, r in one[1]],
            [(s + 4 * i, e + 4 * i, r) for i in range(4_000) for s, e, r in one[2]])


@pytest.fixture(scope="module")
def answers(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    names = "doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score"
    want = con.execute(f"SELECT {names} FROM ({queries.OP11_SQL}) ORDER BY 1").fetchall()
    return want, queries.op11_license_rules(spark, SF).select(*names.split(", ")).orderBy("doc_id").collect()


def test_oracle(answers):
    want, got = answers
    assert [tuple(r) for r in got] == want


def test_base_by_the_contract(spark, answers):
    phrases = [(label, phrase.split()) for label, phrase in lr.BASE_PHRASES]
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    for r in answers[1]:
        w = words_of(docs[r.doc_id])
        at = [(i, label) for label, p in phrases for i in range(len(w)) if w[i:i + len(p)] == p]
        starts = [i for i, _ in at]
        assert (r.n_words, r.n_base, r.base_labels) == (len(w), len(at), ",".join(sorted({x for _, x in at})))
        assert (r.first_word, r.last_word) == ((min(starts), max(starts)) if at else (None, None))
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1
    assert any(r.n_base for r in answers[1])
