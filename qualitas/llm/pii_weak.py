"""Operator 3: personal data by weak supervision.

Candidates are the spans of four base kinds (e-mail, IP address, card number, phone number in international
form), which are always reported, and of further kinds that need a decision: spelled-out e-mail addresses, phone
numbers in groups, card numbers (both also where other numbers follow directly, which the base patterns run into),
national ids, bank accounts and names behind a title.  Labelers vote on every candidate (for,
against or not at all): its shape, its check digits or ranges, gazetteers, cue words around it and its borders.

The votes of all candidates of the corpus are counted by pattern; there are at most ``kinds * 3 ** labelers``
patterns, so the counts are small however large the corpus is.  Expectation-maximisation over them estimates how
reliable each labeler is and how likely each pattern is personal data, without labels; mild priors say that labelers
are better than chance.  The final span classifier is a logistic regression that doesn't see the votes but features
of its own: the span's characters, length, digits and check digits, its neighbours, the words around it and its
place in the text.  It is fitted to the patterns' probabilities on at most ``SAMPLE`` candidates of each pattern (those
of the least hashes of their features, so the same for any partitioning), which together weigh as much as the
pattern does among the candidates of its kind.  So what the labelers can't see, like a word that goes with rejected numbers, decides too.  A
candidate of a further kind is reported from 0.5 on.

Null texts are empty and have no spans.  All rules run in time linear in the text.  Rows are handled one by one:
repeated rows and other columns don't matter.  An empty table trains on the priors alone.
"""
from __future__ import annotations

import heapq
import re
from collections import Counter, defaultdict
from dataclasses import dataclass, field
from zlib import crc32

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from qualitas.llm.batches import flat_map
from qualitas.session import remove, work_folder, written

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "email_spelled", "phone_local", "card_apart", "national_id", "iban", "person")
LABELERS = ("shape", "check", "gazetteer", "context", "border")
#: Candidates of each pattern of votes that the classifier learns from, and places of its weights.
SAMPLE = 64
PLACES = 1 << 12

#: Pseudo-counts of votes (against, none, for) on clean and on personal candidates, eleven each: a failed check is
#: rare on personal data, a good shape says little, and the others are right more often than wrong.
BELIEFS = {"shape": ((3, 3, 5), (1, 3, 7)), "check": ((7, 2, 2), (0.2, 2.8, 8)), "gazetteer": ((3, 7, 1), (1, 7, 3)),
           "context": ((4, 6, 1), (0.5, 6, 4.5)), "border": ((3, 2, 6), (0.5, 2, 8.5))}

# The base patterns.
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

_ANY_DIGIT_OR_AT = re.compile(r"[0-9@]")
_SPELLED = re.compile(r"[A-Za-z0-9._%+-]{1,64}\s?(?:[\[({]\s?at\s?[\])}]|\sat\s)\s?[A-Za-z0-9-]{1,63}"
                      r"(?:\s?(?:[\[({]\s?dot\s?[\])}]|\sdot\s)\s?[A-Za-z0-9-]{1,63}){1,4}", re.IGNORECASE)
_LOCAL_PHONE = re.compile(r"(?<![0-9+(.-])(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{3}\)\s?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}"
                          r"(?![0-9-])")
_CARD_APART = re.compile(r"(?<![0-9])(?:[0-9]{4}([ -])[0-9]{4}\1[0-9]{4}\1[0-9]{4}|[0-9]{14,19})(?![0-9])")
_NATIONAL_ID = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
_PERSON = re.compile(r"(?<!\w)(?:Mrs?|Ms|Dr|Prof|Herr|Frau|Mme|Madame|Monsieur|Señora?)\.?[ ][A-ZÀ-Þ][\w'-]{1,30}"
                     r"(?:[ ][A-ZÀ-Þ][\w'-]{1,30})?")

# The gazetteers and cue words.
_TOP_DOMAINS = frozenset("com org net edu gov info io de fr es it uk eu ch at be nl us example test".split())
_FIRST_NAMES = frozenset("anna carlos claire david elena emma hans james jean john jose julia karl laura luis maria "
                         "marie mary michael paul peter pierre robert sarah sofia thomas".split())
_CARD_PREFIXES = ("4", "51", "52", "53", "54", "55", "34", "37", "36", "38", "6011", "65", "22", "35", "62")
_PRIVATE_NETS = ("10.", "127.", "0.", "255.", "192.168.", "169.254.")
_CUES = re.compile(r"e-?mail|contact|call|phone|tel|mobile|fax|kontakt|telefon|téléphone|teléfono|correo|courriel|"
                   r"card|visa|karte|tarjeta|carte|iban|konto|account|ssn|social security|ip|address|adresse", re.IGNORECASE)
_COUNTER_CUES = re.compile(r"isbn|issn|version|release|chapter|section|figure|invoice|order no|serial|part no|total|price",
                           re.IGNORECASE)


@dataclass(frozen=True)
class Candidate:
    """A span in code points, end exclusive."""

    start: int
    end: int
    kind: str

    @property
    def base(self) -> bool:
        return self.kind in BASE_KINDS


# -- candidates -----------------------------------------------------------------------------------------------

def _emails(text: str):
    last, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            yield Candidate(start, domain.end(), "email")
            last = domain.end()
        at = text.find("@", max(at + 1, last))


def _ips(text: str):
    for run in _DOTTED.finditer(text):
        parts = run.group().split(".")
        if len(parts) < 4:
            continue
        at = run.start()
        for i in range(0, len(parts) - 3, 4):
            four = parts[i:i + 4]
            end = at + sum(map(len, four)) + 3
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in four):
                yield Candidate(at, end, "ip")
            at = end + 1


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join([c for c in text if c in "0123456789"])


def base_candidates(text: str) -> list[Candidate]:
    """The base spans, by start and then kind."""
    if not _ANY_DIGIT_OR_AT.search(text):
        return []
    found = [*_emails(text), *_ips(text)]
    for m in _CARD.finditer(text):
        if 14 <= len(d := _digits(m.group())) <= 19 and luhn(d):
            found.append(Candidate(*m.span(), "card"))
    for m in _PHONE.finditer(text):
        if 10 <= len(_digits(m.group())) <= 15:
            found.append(Candidate(*m.span(), "phone"))
    return sorted(found, key=lambda c: (c.start, KINDS.index(c.kind)))


def candidates(text: str) -> list[Candidate]:
    """All spans to vote on, by start and then kind; further kinds don't overlap base spans."""
    found = base_candidates(text)
    further = []
    if _ANY_DIGIT_OR_AT.search(text):
        for kind, pattern in (("phone_local", _LOCAL_PHONE), ("card_apart", _CARD_APART),
                              ("national_id", _NATIONAL_ID), ("iban", _IBAN)):
            further += [Candidate(*m.span(), kind) for m in pattern.finditer(text)]
    if "dot" in text.lower():                           # every match has it, in some case
        further += [Candidate(*m.span(), "email_spelled") for m in _SPELLED.finditer(text)]
    further += [Candidate(*m.span(), "person") for m in _PERSON.finditer(text)]
    if not further:
        return found
    end, kept, bases = 0, [], sorted((c.start, c.end) for c in found)
    at = 0
    for c in sorted(further, key=lambda c: (c.start, KINDS.index(c.kind))):
        while at < len(bases) and bases[at][1] <= c.start:
            at += 1
        if c.start >= end and not any(b[0] < c.end and c.start < b[1] for b in bases[at:at + 4]):
            kept.append(c)
            end = c.end
    return sorted(found + kept, key=lambda c: (c.start, KINDS.index(c.kind)))


# -- labelers -------------------------------------------------------------------------------------------------

def _iban_check(span: str) -> bool:
    s = span.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def votes(text: str, c: Candidate) -> tuple[int, ...]:
    """A vote of each labeler: 1 for personal data, -1 against, 0 for none."""
    span = text[c.start:c.end]
    digits = _digits(span)
    shape = check = gazetteer = 0
    if c.kind in ("email", "email_spelled"):
        words = re.split(r"[^A-Za-z0-9-]+", span.lower())
        shape = 1 if c.kind == "email" or re.search(r"[\[({]", span) else -1
        gazetteer = 1 if words[-1] in _TOP_DOMAINS else 0
        check = 1 if words[-1].isalpha() and 2 <= len(words[-1]) <= 24 else -1
    elif c.kind == "ip":
        shape = 1
        check = -1 if any(len(p) > 1 and p[0] == "0" for p in span.split(".")) else 1
        gazetteer = -1 if span.startswith(_PRIVATE_NETS) else 0
    elif c.kind in ("card", "card_apart"):
        shape = 1 if len(set(digits)) > 2 else -1
        check = 1 if luhn(digits) else -1
        gazetteer = 1 if digits.startswith(_CARD_PREFIXES) else -1
    elif c.kind in ("phone", "phone_local"):
        shape = 1 if re.search(r"[ ().-]", span) else 0
        check = 1 if len(set(digits)) > 2 else -1
        gazetteer = -1 if c.kind == "phone_local" and digits[0] in "01" else 0
    elif c.kind == "national_id":
        area = int(digits[:3])
        shape, check = 1, 1 if 0 < area < 900 and area != 666 and digits[3:5] != "00" and digits[5:] != "0000" else -1
    elif c.kind == "iban":
        shape, check = 1, 1 if _iban_check(span) else -1
    else:
        shape = 1 if re.search(r"\. ", span) else 0
        gazetteer = 1 if any(w.lower() in _FIRST_NAMES for w in span.split()) else 0
    before = text[max(0, c.start - 40):c.start]
    context = 1 if _CUES.search(before) else -1 if _COUNTER_CUES.search(before) else 0
    around = text[max(0, c.start - 1):c.start] + text[c.end:c.end + 1]
    border = -1 if any(x.isalnum() or x in "/_=" for x in around) else 1
    return shape, check, gazetteer, context, border


# -- the model ------------------------------------------------------------------------------------------------

_WORD = re.compile(r"[^\W\d_]+")


def _class(char: str) -> str:
    """What a neighbour of a span is."""
    return ("edge" if not char else "line" if char in "\r\n" else "space" if char.isspace() else "digit" if char.isdigit()
            else "letter" if char.isalpha() else char if char in ".,;:/=_-+#()[]\"'" else "other")


def _outline(span: str) -> str:
    """The span's characters by class, runs as one: ``Aa``, ``9`` and signs."""
    return re.sub(r"(.)\1+", r"\1", "".join(
        "9" if x.isdigit() else "A" if x.isupper() else "a" if x.isalpha() else x for x in span))[:24]


def span_features(text: str, c: Candidate) -> list[int]:
    """Places of the classifier's weights that a span has, in order; place 0 is every span's."""
    span, kind = text[c.start:c.end], c.kind
    digits = _digits(span)
    valid = (luhn(digits) if kind in ("card", "card_apart") else _iban_check(span) if kind == "iban" else
             digits[:3] not in ("000", "666") and digits[:1] != "9" and digits[3:5] != "00" and digits[5:] != "0000"
             if kind == "national_id" else len(set(digits)) > 2 if digits else None)
    before, after = text[max(0, c.start - 40):c.start], text[c.end:c.end + 30]
    left, right = _class(before[-1:]), _class(after[:1])
    place = 3 * c.start // max(1, len(text))
    names = [kind, f"{kind} length {min(c.end - c.start, 60) // 4}", f"{kind} outline {_outline(span)}",
             f"{kind} valid {valid}", f"{kind} digits {min(len(set(digits)), 4)}", f"{kind} head {span[:1]}",
             f"left {left}", f"right {right}", f"{kind} left {left}", f"{kind} right {right}", f"place {place}",
             f"digits near {sum(x.isdigit() for x in before + after) > 6}"]
    names += [f"before {w}" for w in _WORD.findall(before.lower())[-3:]]
    names += [f"after {w}" for w in _WORD.findall(after.lower())[:2]]
    if kind == "person":
        names += [f"name {w}" for w in _WORD.findall(span.lower())[1:]]
    return sorted({0, *(1 + crc32(n.encode()) % (PLACES - 1) for n in names)})


@dataclass
class Evidence:
    """What training gathers: counts of the patterns of votes, and ``(pattern, features)`` of sampled candidates."""

    counts: dict[tuple[str, tuple[int, ...]], int]
    sample: list[tuple[tuple[str, tuple[int, ...]], list[int]]]


@dataclass
class Model:
    """The span classifier, and the labelers' reliabilities that it was trained with."""

    weights: np.ndarray
    reliability: np.ndarray = field(repr=False)         # [personal or not, labeler, vote + 1]
    prior: float = 0.5

    def score(self, text: str, c: Candidate) -> float:
        return float(1 / (1 + np.exp(-self.weights[span_features(text, c)].sum())))


def em(counts: dict[tuple[str, tuple[int, ...]], int], rounds: int = 50):
    """Probability of each pattern, the labelers' reliabilities and the share of personal data."""
    patterns = sorted(counts)
    n = np.array([counts[p] for p in patterns], float)
    ballots = np.array([b for _, b in patterns], int).reshape(len(patterns), len(LABELERS)) + 1
    belief = np.array([[BELIEFS[name][personal] for name in LABELERS] for personal in (0, 1)], float)
    reliability, prior = belief / belief.sum(2, keepdims=True), 0.5
    p = np.full(len(patterns), 0.5)
    for _ in range(rounds):
        log = np.log(reliability)[:, np.arange(len(LABELERS))[None, :], ballots].sum(2)
        log += np.log([[1 - prior], [prior]])
        p = 1 / (1 + np.exp(log[0] - log[1]))
        prior = (n @ p + 2) / (n.sum() + 4)
        for personal, weight in ((0, n * (1 - p)), (1, n * p)):
            seen = np.stack([(weight[:, None] * (ballots == v)).sum(0) for v in range(3)], axis=1)
            # beliefs weigh as much as a thirtieth of the candidates, so a corpus without any clean ones can't
            # turn the classes round
            total = seen + belief[personal] * max(1.0, n.sum() / 330)
            reliability[personal] = total / total.sum(1, keepdims=True)
    return patterns, n, p, reliability, float(prior)


def train(evidence: Evidence, steps: int = 300, ridge: float = 1e-4) -> Model:
    """Estimate reliabilities, and fit the classifier to the sampled candidates with their patterns' probabilities."""
    patterns, n, p, reliability, prior = em(evidence.counts)
    weights = np.zeros(PLACES)
    at = {pattern: i for i, pattern in enumerate(patterns)}
    sample = sorted((at[pattern], places) for pattern, places in evidence.sample)
    if sample:
        of = np.array([i for i, _ in sample])
        # a pattern weighs as its count within its kind, a kind as its root, so rare kinds count too
        kind = np.array([KINDS.index(k) for k, _ in patterns])
        each = (n / np.sqrt(np.bincount(kind, n))[kind] / np.maximum(np.bincount(of, minlength=len(n)), 1))[of]
        each = each / each.sum()
        target = p[of]
        row = np.repeat(np.arange(len(sample)), [len(places) for _, places in sample])
        place = np.concatenate([places for _, places in sample])
        mean, square = np.zeros(PLACES), np.zeros(PLACES)
        for step in range(1, steps + 1):                  # full gradients with adapted steps (Adam)
            q = 1 / (1 + np.exp(-np.bincount(row, weights[place], len(sample))))
            slope = np.bincount(place, (each * (q - target))[row], PLACES) + ridge * weights
            mean, square = 0.9 * mean + 0.1 * slope, 0.99 * square + 0.01 * slope * slope
            weights -= 0.05 * mean / (1 - 0.9 ** step) / (np.sqrt(square / (1 - 0.99 ** step)) + 1e-8)
    return Model(weights, reliability, prior)


def vote_counts(docs: DataFrame, text_col: str = "text", sample: int = SAMPLE) -> Evidence:
    """How often each pattern of votes occurs over all candidates of all texts, and candidates to learn from.

    A task gives a row for each of its patterns and at most ``sample`` candidates of each, whatever its texts hold.
    """
    schema = pa.schema([("kind", pa.string()), ("ballot", pa.string()), ("n", pa.int64()), ("hash", pa.int64()),
                        ("places", pa.list_(pa.int32()))])

    def count(batches):
        seen: Counter = Counter()
        least: dict = defaultdict(dict)                   # of each pattern: hash of the features -> features
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                for text in batch["text"].slice(at, 500).to_pylist():
                    for c in candidates(text):
                        pattern = c.kind, votes(text, c)
                        seen[pattern] += 1
                        places = span_features(text, c)
                        mine = least[pattern]
                        mine[xxhash.xxh3_64_intdigest(np.array(places, "<u4").tobytes()) >> 1] = places
                        if len(mine) > 8 * sample:
                            least[pattern] = {h: mine[h] for h in heapq.nsmallest(sample, mine)}
        rows = [(k, b, n, None, None) for (k, b), n in seen.items()]
        rows += [(k, b, 0, h, mine[h]) for (k, b), mine in least.items() for h in heapq.nsmallest(sample, mine)]
        for at in range(0, len(rows), 5_000):
            kind, ballot, n, hashes, places = zip(*rows[at:at + 5_000], strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(
                (kind, [",".join(map(str, b)) for b in ballot], n, hashes, places), schema, strict=True)], schema=schema)

    folder = work_folder(docs.sparkSession, "votes")
    rows = written(docs.select(F.coalesce(F.col(text_col), F.lit("")).alias("text"))
                   .mapInArrow(count, "kind string, ballot string, n long, hash long, places array<int>"), folder)
    pattern = lambda r: (r["kind"], tuple(map(int, r["ballot"].split(","))))
    # at most kinds * 3 ** labelers patterns, and so many candidates of each
    counts = rows.groupBy("kind", "ballot").agg(F.sum("n").alias("n")).collect()
    first = F.row_number().over(Window.partitionBy("kind", "ballot").orderBy("hash"))
    taken = (rows.where("hash IS NOT NULL").dropDuplicates(["kind", "ballot", "hash"]).withColumn("_at", first)
             .where(F.col("_at") <= sample).collect())
    remove(docs.sparkSession, folder)
    return Evidence({pattern(r): r["n"] for r in counts}, [(pattern(r), r["places"]) for r in taken])


# -- the operator ---------------------------------------------------------------------------------------------

def spans_of(text: str, model: Model) -> list[tuple[str, int, int, bool, float]]:
    """The reported spans of a text: kind, start, end, base, score."""
    out = []
    for c in candidates(text):
        score = model.score(text, c)
        if c.base or score >= 0.5:
            out.append((c.kind, c.start, c.end, c.base, score))
    return out


_SPAN = "struct<kind:string,start:long,end:long,base:boolean,score:double>"


def find(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, spans``: the reported spans of every row, by start and then kind."""
    span = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_()),
                      ("score", pa.float64())])
    schema = pa.schema([("doc_id", pa.int64()), ("spans", pa.list_(span))])
    names = ("kind", "start", "end", "base", "score")

    def rows(doc_id, text):
        yield doc_id, [dict(zip(names, s, strict=True)) for s in spans_of(text, model)]

    return (docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
            .mapInArrow(lambda batches: flat_map(batches, schema, rows), f"doc_id long, spans array<{_SPAN}>"))


def masked(text: str, model: Model) -> str:
    """The text with every reported span replaced by its kind in brackets; overlapping spans become one."""
    out, end = [], 0
    for kind, start, stop, _, _ in spans_of(text, model):
        if start >= end:
            out += [text[end:start], f"[{kind.upper()}]"]
        end = max(end, stop)
    return "".join([*out, text[end:]])


def mask(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``docs`` with personal data masked in the text; all other columns, and null texts, as they are."""
    names = docs.columns
    at = names.index(text_col)

    def run(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, 500):
                part = batch.slice(start, 500)
                texts = [t if t is None else masked(t, model) for t in part.column(at).to_pylist()]
                yield part.set_column(at, part.schema.field(at), pa.array(texts, part.schema.field(at).type))

    return docs.mapInArrow(run, docs.schema)
