"""Base spans against the contract's patterns, the method on planted and clean texts."""
import hashlib
import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from qualitas.llm import pii_weak as pii
from qualitas.llm import queries

SF = "/root/testdata/sf0.001"


def plain_base(text):
    out = []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        out.append((m.start(), 0, m.end(), "email"))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m[0].split(".")):
            out.append((m.start(), 1, m.end(), "ip"))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub("[^0-9]", "", m[0])
        if 14 <= len(d) <= 19 and sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(d[::-1])) % 10 == 0:
            out.append((m.start(), 2, m.end(), "card"))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 10 <= len(re.sub("[^0-9]", "", m[0])) <= 15:
            out.append((m.start(), 3, m.end(), "phone"))
    return [(s, e, k) for s, _, e, k in sorted(out)]


BITS = ["a@b.c", "_d@e.f", "@", ".", "a", "1.2.3.4", ".5.6", "255", "256", "+", "1", " ", "-", "4111 1111 1111 1111",
        "4111111111111111", "(555) ", "+1 (968) 555-9369", "٣", "é", "0", "x@y", "%", "\n", "00.1.2.3"]


@settings(max_examples=500, deadline=None)
@given(st.lists(st.sampled_from(BITS), max_size=25).map("".join))
def test_base_spans(text):
    assert [(c.start, c.end, c.kind) for c in pii.base_candidates(text)] == plain_base(text)


def test_op3_on_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    got = {r.doc_id: r for r in queries.op3_pii(spark, SF).collect()}
    for d in docs:
        base = plain_base(d.text)
        r = got.pop(d.doc_id)
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(k == x for *_, k in base) for x in pii.BASE_KINDS)
        assert r.base_sha256 == hashlib.sha256(",".join(f"{k}:{s}:{e}" for s, e, k in base).encode()).hexdigest()
        assert set(f"{k}:{s}:{e}" for s, e, k in base) <= set(filter(None, r.spans.split(",")))
        assert bool(r.spans) == bool(base)
    assert not got


PRIVATE = ["mail me: jo [at] mail [dot] example now", "call (415) 555-2671 today", "ssn 219-09-9999, thanks",
           "th +1 (269) 555-3296 4524132264652876 and", "n 4532015112830366 43 x",
           "iban GB82 WEST 1234 5698 7654 32 please", "said Dr. Maria Lopez here"]
CLEAN = ["version 123-45-67890 of it", "isbn 978-3-16-148410-0", "we met at noon on the dot of it", "nothing here",
         "chapter 000-00-0000", "part no 1234567890123456", "GB00 WEST 1234 5698 7654 32 serial"]


def test_method_finds_further_kinds_and_leaves_clean_texts(spark):
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(PRIVATE * 3 + CLEAN * 3 + ["a@b.com"] * 5)],
                                 "doc_id long, text string, kind string")
    model = pii.train(pii.vote_counts(docs))
    for text in PRIVATE:
        assert [s[0] for s in pii.spans_of(text, model)], text
    masked = pii.masked("th +1 (269) 555-3296 4532015112830366 and", model)
    assert masked == "th [PHONE_LOCAL] [CARD_APART] and"
    for text in CLEAN:
        assert not pii.spans_of(text, model), text
    assert pii.masked("a@b.com and 1.2.3.4!", model) == "[EMAIL] and [IP]!"
    assert pii.masked(PRIVATE[1], model) == "call [PHONE_LOCAL] today"


SPELLED = ["Jane.Doe [AT] example [DOT] com", "jane (At) example (Dot) com", "jane [at] example [dot ] com",
           "JANE { AT } EXAMPLE { DOT } COM", "jane [at] mail\tDOT\texample\nDot\norg"]


def test_spelled_addresses_in_any_case_and_spacing(spark):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(PRIVATE * 3 + CLEAN * 3)], "doc_id long, text string")
    model = pii.train(pii.vote_counts(docs))
    for text in SPELLED:
        assert [(c.start, c.end, c.kind) for c in pii.candidates(text)] == [(0, len(text), "email_spelled")], text
        assert pii.masked(f"mail {text}, or call", model) == "mail [EMAIL_SPELLED], or call", text


SPELLED_BITS = ["jane", " ", "\t", "[", "(", "{", "]", ")", "}", "at", "AT", "aT", "dot", "DOT", "dOt", "com", "ſ", "İ", "K"]


@settings(max_examples=500, deadline=None)
@given(st.lists(st.sampled_from(SPELLED_BITS), max_size=20).map("".join))
def test_no_spelled_address_is_passed_over(text):
    assert [(c.start, c.end) for c in pii.candidates(text)] == [m.span() for m in pii._SPELLED.finditer(text)]


def test_em_recovers_reliabilities():
    rng = random.Random(4)
    counts = {}
    right = [0.95, 0.9, 0.6, 0.8, 0.55]
    truth = {}
    for i in range(20000):
        y = 1 if rng.random() < 0.4 else -1
        ballot = tuple(y if rng.random() < r else -y for r in right)
        key = ("phone_local", ballot)
        counts[key] = counts.get(key, 0) + 1
        truth[key] = truth.get(key, 0) + (y > 0)
    patterns, n, p, reliability, prior = pii.em(counts)
    assert abs(prior - 0.4) < 0.06 and reliability[1, 0, 2] > reliability[1, 4, 2]
    wrong = sum(min(truth[k], counts[k] - truth[k]) if (q > 0.5) == (2 * truth[k] > counts[k]) else
                max(truth[k], counts[k] - truth[k]) for k, q in zip(patterns, p))
    assert wrong / 20000 < 0.06


def test_odd_rows(spark):
    docs = spark.createDataFrame([(1, None, 1), (None, "", 2), (2, "a@b.c", None), (2, "a@b.c", None),
                                  (3, "1" * 200_000 + "@" * 50_000 + "+1(" * 50_000, 4)], "doc_id long, text string, spans int")
    model = pii.train(pii.vote_counts(docs))
    got = sorted((r.doc_id or -1, len(r.spans)) for r in pii.find(docs, model).collect())
    assert got == [(-1, 0), (1, 0), (2, 1), (2, 1), (3, 0)]
    out = sorted((str(r.doc_id), r.text, r.spans) for r in pii.mask(docs, model).where("doc_id < 3 OR doc_id IS NULL").collect()
                 if r.text is not None)
    assert out == [("2", "[EMAIL]", None), ("2", "[EMAIL]", None), ("None", "", 2)]
    empty = docs.limit(0)
    assert pii.find(empty, pii.train(pii.vote_counts(empty))).count() == 0


@pytest.mark.parametrize("kind", pii.KINDS)
def test_untrained_model_is_neutral(kind):
    assert pii.train(pii.Evidence({}, [])).score("x 1 y", pii.Candidate(2, 3, kind)) == 0.5


def evidence_of(texts):
    counts, sample = {}, []
    for text in texts:
        for c in pii.candidates(text):
            pattern = c.kind, pii.votes(text, c)
            counts[pattern] = counts.get(pattern, 0) + 1
            sample.append((pattern, pii.span_features(text, c)))
    return pii.Evidence(counts, sample)


def planted(rng, n):
    """Texts with ``(kind, personal)`` of the one further candidate that each holds."""
    d = lambda k: "".join(rng.choice("0123456789") for _ in range(k))
    word = lambda: rng.choice("river stone garden window evening letter market bread".split())

    def card(good):
        while True:
            x = rng.choice(["4", "51", "55"]) + d(14)
            x = (x + d(16))[:16]
            if pii.luhn(x) == good:
                return x

    def iban(good):
        body = d(18)
        check = 98 - int(body + "131400") % 97                   # DE, then 00
        return f"DE{(check if good else (check + 40) % 90):02d}{body}"

    made = []
    for _ in range(n):
        phone = f"({rng.randint(2, 9)}{d(2)}) {d(3)}-{d(4)}"
        made += [(f"{word()} call me at {phone}, {word()}", "phone_local", True),
                 (f"{word()} part no {rng.choice('01')}00-000 {word()} serial 000 000-0000/{d(2)}", "phone_local", False),
                 (f"{word()} my card is {card(True)} 12 {word()}", "card_apart", True),
                 (f"{word()} serial {card(False)} {word()}", "card_apart", False),
                 (f"{word()} ssn {rng.randint(100, 665)}-{rng.randint(10, 99)}-{rng.randint(1000, 9999)}, {word()}",
                  "national_id", True),
                 (f"{word()} version 000-00-{rng.randint(1000, 9999)} {word()}", "national_id", False),
                 (f"{word()} pay to iban {iban(True)} {word()}", "iban", True),
                 (f"{word()} invoice {iban(False)} {word()}", "iban", False),
                 (f"{word()} write to {word()} [at] {word()} [dot] {rng.choice(['com', 'org'])} {word()}", "email_spelled", True),
                 (f"{word()} said Dr. {rng.choice(['Maria', 'Peter', 'Paul', 'Anna'])} {word().title()} there", "person", True)]
    return made


def test_held_out_precision_and_recall_of_each_further_kind():
    rng = random.Random(11)
    model = pii.train(evidence_of([t for t, _, _ in planted(rng, 40)]))
    right, found, all_ = {}, {}, {}
    for text, kind, personal in planted(rng, 100):
        got = any(k == kind for k, *_ in pii.spans_of(text, model))
        right[kind] = right.get(kind, 0) + (got and personal)
        found[kind] = found.get(kind, 0) + got
        all_[kind] = all_.get(kind, 0) + personal
    assert set(all_) == set(pii.KINDS) - set(pii.BASE_KINDS)
    for kind in all_:
        assert right[kind] >= 0.95 * all_[kind] and right[kind] >= 0.95 * found[kind], kind


def test_classifier_is_right_where_the_votes_are_wrong():
    """A word that goes with rejected numbers, which no labeler knows, outweighs a ballot that looks personal."""
    rng = random.Random(5)
    d = lambda k: "".join(rng.choice("23456789") for _ in range(k))
    texts = [f"please call ({d(3)}) {d(3)}-{d(4)}, thanks" for _ in range(60)]
    texts += [f"old sprocket {rng.choice('01')}{d(2)} {d(3)} {d(4)}{rng.choice(['/', '_', '=', 'a'])} in stock" for _ in range(40)]
    text = "old sprocket 452 678 8923 in stock"
    c, = pii.candidates(text)
    ballot = pii.votes(text, c)
    model = pii.train(evidence_of(texts))
    clean, personal = (model.reliability[k, range(len(ballot)), [v + 1 for v in ballot]].prod() for k in (0, 1))
    assert personal * model.prior > clean * (1 - model.prior)             # the votes alone report it
    assert not pii.spans_of(text, model) and pii.spans_of("please call (452) 678-8923, thanks", model)


def test_sample_is_the_same_for_any_partitioning(spark):
    rng = random.Random(3)
    docs = spark.createDataFrame([(i, t) for i, (t, _, _) in enumerate(planted(rng, 30))], "doc_id long, text string")
    one, many = (pii.vote_counts(docs.repartition(k), sample=5) for k in (1, 7))
    assert one.counts == many.counts and sorted(one.sample) == sorted(many.sample)
    of = [pattern for pattern, _ in one.sample]
    assert max(of.count(x) for x in of) == 5 and set(of) == set(one.counts)
