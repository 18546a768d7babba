"""Operator 13: ranked lexical search by an Aho-Corasick scan of the documents.

Terms are runs of ASCII letters and digits and of non-ASCII characters, A-Z in lower case.  All terms of the items
(the queries) go into one automaton, each between two spaces; a document is read as its terms with spaces for
everything else, so the automaton finds whole terms only.  One run of the automaton over a text counts how often each
term occurs in it; no index of the documents is made, and nothing is joined with them.

1. A first scan counts the documents, their terms, and the documents of each item term: sums over all tasks.
2. A second scan computes every document's score for every item whose terms it has: each of the automaton's outputs
   leads to the items that have the term, and how often.  A task keeps the k best documents of each item.
3. The k best of all tasks' bests are the result.

The score of a document with n terms is the sum over the item's terms, repeats included, of

    w * ((10**9 * tf) // (1000 * tf + 12 * m)),    m = 75 + (25 * n * N) // L

with the term's weight w = floor(1000 * ln((2 N + 2) / (2 df + 1))), N documents with terms and L terms in all.

The automaton is broadcast; its size is bounded, as items are taken in blocks of at most about ``BLOCK_ITEMS`` items
and ``BLOCK_BYTES`` bytes of text (a longer item is a block), each of which scans the documents again.

Null texts and texts without terms score 0 and are not counted as documents; items without terms have no results.
Rows of ``docs`` without an id count in the statistics, but aren't ranked.  Repeated documents are ranked as often as
they occur; equal scores are ordered by id.  Repeated items count once; different texts under one item id are items
of their own.  Empty tables give an empty result.  Other columns are ignored.
"""
from __future__ import annotations

import math
from collections import Counter
from operator import itemgetter

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from qualitas.llm.importance_resampling import NORMAL

K = 20
BLOCK_ITEMS, BLOCK_BYTES = 1_000, 8_000_000
#: Scores held at once, and candidates gathered before they are reduced to the best.
CELLS = 1 << 21
PENDING = 1 << 17


def terms_of(text: str | None) -> list[str]:
    """The terms of a text in order."""
    return (text or "").encode().translate(NORMAL).decode().split(" ") if text else []


class Matcher:
    """The automaton of some items, and the items of each of its outputs."""

    def __init__(self, items: list[tuple[int | None, str]]):
        counted = [Counter(filter(None, terms_of(text))) for _, text in items]
        self.ids = [item_id for item_id, _ in items]
        self.terms = sorted(set().union(*counted))
        number = {t: i for i, t in enumerate(self.terms)}
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for term, i in number.items():
            self.automaton.add_word(f" {term} ", i)
        self.automaton.make_automaton()
        rows = sorted((number[t], item, n) for item, c in enumerate(counted) for t, n in c.items())
        self.first = np.searchsorted(np.array([t for t, _, _ in rows]), np.arange(len(self.terms) + 1))
        self.item = np.array([i for _, i, _ in rows], np.int64)
        self.times = np.array([n for _, _, n in rows], np.int64)

    def count(self, text: str) -> tuple[int, dict[int, int]]:
        """The number of terms of a text, and how often each item term occurs."""
        raw = text.encode().translate(NORMAL)
        inside = np.frombuffer(raw, np.uint8) != 0x20
        n = int(inside[:1].sum() + np.count_nonzero(inside[1:] & ~inside[:-1]))
        return n, Counter(map(itemgetter(1), self.automaton.iter(f" {raw.decode()} "))) if n else {}


def _rows(batches):
    """``(doc_id, text)`` of record batches, texts of a slice at a time."""
    for batch in batches:
        for start in range(0, batch.num_rows, 500):
            part = batch.slice(start, 500)
            yield from zip(part["doc_id"].to_pylist(), part["text"].to_pylist(), strict=True)


def statistics(texts: DataFrame, matcher) -> tuple[int, int, np.ndarray]:
    """Documents with terms, all their terms, and the number of documents with each item term."""
    schema = pa.schema([("term", pa.int32()), ("n", pa.int64())])
    size = len(matcher.value.terms)

    def run(batches):
        m = matcher.value
        documents = total = 0
        having = np.zeros(size, np.int64)
        for _, text in _rows(batches):
            n, found = m.count(text)
            documents += n > 0
            total += n
            if found:
                having[np.fromiter(found, np.int64, len(found))] += 1
        at = np.flatnonzero(having)
        yield pa.RecordBatch.from_arrays([pa.array([-1, -2, *at.tolist()], pa.int32()),
                                          pa.array([documents, total, *having[at].tolist()], pa.int64())], schema=schema)

    sums = {r["term"]: r["n"] for r in texts.mapInArrow(run, "term int, n long").groupBy("term")
            .agg(F.sum("n").alias("n")).collect()}               # a row per item term of the block
    return sums.get(-1, 0), sums.get(-2, 0), np.array([sums.get(t, 0) for t in range(size)], np.int64)


class _Best:
    """The k best documents of each item seen so far."""

    def __init__(self, items: int, k: int):
        self.k, self.least = k, np.ones(items, np.int64)         # a result's score is above 0
        self.held = [np.array([], np.int64)] * 3                 # item, score, document
        self.pending: list[list[np.ndarray]] = []
        self.waiting = 0

    def add(self, scores: np.ndarray, ids: np.ndarray) -> None:
        document, item = np.nonzero(scores >= self.least[None, :])
        self.pending.append([item, scores[document, item], ids[document]])
        self.waiting += len(item)
        if self.waiting >= PENDING:
            self.reduce()

    def reduce(self) -> None:
        item, score, doc_id = (np.concatenate(x) for x in zip(self.held, *self.pending, strict=True))
        order = np.lexsort((doc_id, -score, item))
        item, score, doc_id = item[order], score[order], doc_id[order]
        place = np.arange(len(item)) - np.searchsorted(item, item)
        best = place < self.k
        self.held = [item[best], score[best], doc_id[best]]
        full = place == self.k - 1
        self.least[item[full]] = score[full]                     # equal ones may still win by their id
        self.pending, self.waiting = [], 0


def best_of_tasks(texts: DataFrame, matcher, documents: int, total: int, weight: np.ndarray, k: int) -> DataFrame:
    """``item, item_id, doc_id, score``: the k best documents of every item among those of each task."""
    schema = pa.schema([("item", pa.int64()), ("item_id", pa.int64()), ("doc_id", pa.int64()), ("score", pa.int64())])

    def run(batches):
        m = matcher.value
        items = len(m.ids)
        best, room = _Best(items, k), max(1, CELLS // max(1, items))
        held: list[tuple[int, np.ndarray, np.ndarray]] = []       # id, terms, what each gives

        def score():
            if not held:
                return
            term = np.concatenate([t for _, t, _ in held])
            given = np.concatenate([g for _, _, g in held])
            row = np.repeat(np.arange(len(held)), [len(t) for _, t, _ in held])
            many = m.first[term + 1] - m.first[term]              # items of each term
            at = np.repeat(m.first[term] - (np.cumsum(many) - many), many) + np.arange(many.sum())
            scores = np.zeros((len(held), items), np.int64)
            np.add.at(scores, (np.repeat(row, many), m.item[at]), np.repeat(given, many) * m.times[at])
            best.add(scores, np.array([i for i, _, _ in held], np.int64))
            held.clear()

        for doc_id, text in _rows(batches):
            n, found = m.count(text) if doc_id is not None else (0, {})
            if not found:
                continue
            tf = np.fromiter(found.values(), np.int64, len(found))
            term = np.fromiter(found, np.int64, len(found))
            length = 75 + 25 * n * documents // total
            held.append((doc_id, term, weight[term] * (1_000_000_000 * tf // (1000 * tf + 12 * length))))
            if len(held) >= room:
                score()
        score()
        best.reduce()
        item, value, doc_id = best.held
        yield pa.RecordBatch.from_arrays([pa.array(item, pa.int64()), pa.array([m.ids[i] for i in item.tolist()], pa.int64()),
                                          pa.array(doc_id, pa.int64()), pa.array(value, pa.int64())], schema=schema)

    return texts.mapInArrow(run, "item long, item_id long, doc_id long, score long")


def weights(documents: int, having: np.ndarray) -> np.ndarray:
    return np.array([math.floor(1000 * math.log((2 * documents + 2) / (2 * df + 1))) for df in having.tolist()], np.int64)


def search(docs: DataFrame, items: DataFrame, k: int = K, id_col: str = "doc_id", text_col: str = "text",
           item_id_col: str = "item_id", item_text_col: str = "text", block_items: int = BLOCK_ITEMS,
           block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``item_id, rank, doc_id, score``: the k documents of the highest scores above 0 of every item."""
    spark = docs.sparkSession
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    asked = (items.select(F.col(item_id_col).cast("long").alias("item_id"), F.col(item_text_col).alias("text"))
             .where("text IS NOT NULL").distinct())
    size = asked.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("b")).first()
    blocks = max(1, -(-size["n"] // block_items), -(-size["b"] // block_bytes))
    block_of = F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks))
    out = spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    for block in range(blocks):
        rows = asked.where(block_of == block).collect()          # about block_items rows, block_bytes bytes
        matcher = Matcher([(r["item_id"], r["text"]) for r in sorted(rows, key=repr)])
        if not matcher.terms:
            continue
        shared = spark.sparkContext.broadcast(matcher)
        documents, total, having = statistics(texts, shared)
        if not documents:
            break
        best = best_of_tasks(texts, shared, documents, total, weights(documents, having), k)
        place = Window.partitionBy("item").orderBy(F.col("score").desc(), "doc_id")
        out = out.unionByName(best.withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= k)
                              .select("item_id", "rank", "doc_id", "score"))
    return out
