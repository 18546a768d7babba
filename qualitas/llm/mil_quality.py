"""Operator 1: document quality by attention-based multiple-instance learning.

A document is a bag of passages, all of them, of ``PASSAGE`` bytes each.  A passage is described by the square roots
of its byte frequencies and by a few rates (upper case, digits, marks, white space, non-ASCII, repeated words).  An
encoder layer turns that into a hidden vector; gated attention, tanh times sigmoid, weighs the passages; the weighted
mean of the hidden vectors gives the document's score.  Encoder, attention and score are trained together from
document labels only, with no label for any passage.

Training takes at most ``train_docs`` label rows of documents of at most ``train_chars`` code points, those with the
least hash of the id, and runs in numpy on the driver over their passages; scoring runs in Spark over every passage of
every document.  Neither labels nor ids nor other columns enter a score.

Null and empty texts are one empty passage and get a score.  Rows are scored one by one, so repeated rows and extra
columns don't matter.  An id with several rows is learnt from one of them, the text with the least hash.  Labels that
are null are ignored; several labels of one id all count.  Without any labelled
row, or with labels of one class only, the score is the share of label 1 (0.5 without rows).
"""
from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from qualitas.llm.batches import flat_map

PASSAGE = 1024
TRAIN_DOCS = 4_000
TRAIN_CHARS = 100_000
HIDDEN, ATTENTION = 24, 12
STEPS, BATCH, RATE, DECAY = 1_200, 64, 0.01, 1e-4
#: Passages described and scored at once.
BLOCK = 2_048

_RATES = 6
SIZE = 256 + _RATES


def _groups(table) -> np.ndarray:
    return np.array([[f(b) for b in range(256)] for f in table], np.float32).T


_CLASSES = _groups([lambda b: 65 <= b <= 90, lambda b: 48 <= b <= 57, lambda b: b in (32, *range(9, 14)),
                    lambda b: b >= 128, lambda b: 33 <= b < 127 and not chr(b).isalnum()])


def passage_blocks(raw: bytes):
    """The descriptions of a text's passages (at least one), in blocks."""
    n = max(1, -(-len(raw) // PASSAGE))
    for first in range(0, n, BLOCK):
        last = min(n, first + BLOCK)
        text = raw[first * PASSAGE:last * PASSAGE]
        places = np.frombuffer(text, np.uint8).astype(np.int64)
        places += (np.arange(len(places)) // PASSAGE) * 256
        counts = np.bincount(places, minlength=(last - first) * 256).reshape(-1, 256).astype(np.float32)
        share = counts / np.maximum(counts.sum(1, keepdims=True), 1)
        words = [text[i * PASSAGE:(i + 1) * PASSAGE].split() for i in range(last - first)]
        repeated = np.array([[1 - len(set(w)) / len(w) if w else 0] for w in words], np.float32)
        yield np.concatenate([np.sqrt(share), share @ _CLASSES, repeated], axis=1)


def passages(raw: bytes) -> np.ndarray:
    return np.concatenate(list(passage_blocks(raw)))


def _segments(values: np.ndarray, starts: np.ndarray, how) -> np.ndarray:
    return how.reduceat(values, starts, axis=0)


@dataclass
class Model:
    """Encoder, gated attention and score; ``constant`` replaces them where nothing could be learnt."""

    weights: dict = field(default_factory=dict, repr=False)
    constant: float | None = None

    def forward(self, x: np.ndarray, starts: np.ndarray) -> dict:
        """Everything on the way from passages to scores; document i begins at passage ``starts[i]``."""
        w = self.weights
        lengths = np.diff(np.append(starts, len(x)))
        h = np.maximum(x @ w["encode"] + w["encode0"], 0)
        t, g = np.tanh(h @ w["tanh"]), 1 / (1 + np.exp(-(h @ w["gate"])))
        a = (t * g) @ w["attend"]
        e = np.exp(a - np.repeat(_segments(a, starts, np.maximum), lengths))
        alpha = e / np.repeat(_segments(e, starts, np.add), lengths)
        z = _segments(alpha[:, None] * h, starts, np.add)
        score = 1 / (1 + np.exp(-np.clip(z @ w["score"] + w["score0"], -30, 30)))
        return {"lengths": lengths, "h": h, "t": t, "g": g, "alpha": alpha, "z": z, "score": score}

    def gradient(self, x: np.ndarray, starts: np.ndarray, y: np.ndarray) -> dict:
        """Gradient of the mean log loss."""
        w, f = self.weights, self.forward(x, starts)
        d_logit = (f["score"] - y) / len(y)
        d_z = np.repeat(d_logit[:, None] * w["score"], f["lengths"], axis=0)
        d_alpha = (f["h"] * d_z).sum(1)
        mean = _segments(f["alpha"] * d_alpha, starts, np.add)
        d_a = f["alpha"] * (d_alpha - np.repeat(mean, f["lengths"]))
        d_tg = d_a[:, None] * w["attend"]
        d_t, d_g = d_tg * f["g"] * (1 - f["t"] ** 2), d_tg * f["t"] * f["g"] * (1 - f["g"])
        d_h = (f["alpha"][:, None] * d_z + d_t @ w["tanh"].T + d_g @ w["gate"].T) * (f["h"] > 0)
        return {"encode": x.T @ d_h, "encode0": d_h.sum(0), "tanh": f["h"].T @ d_t, "gate": f["h"].T @ d_g,
                "attend": (f["t"] * f["g"]).T @ d_a, "score": f["z"].T @ d_logit, "score0": d_logit.sum()}

    def score(self, raw: bytes) -> float:
        """The score of one text; the attention's weighted mean is kept up to date block by block."""
        if self.constant is not None:
            return self.constant
        w, top, total, z = self.weights, -np.inf, 0.0, 0.0
        for x in passage_blocks(raw):
            h = np.maximum(x @ w["encode"] + w["encode0"], 0)
            a = (np.tanh(h @ w["tanh"]) / (1 + np.exp(-(h @ w["gate"])))) @ w["attend"]
            high = max(top, a.max())
            e, old = np.exp(a - high), np.exp(top - high)
            total, z, top = total * old + e.sum(), z * old + e @ h, high
        return float(1 / (1 + np.exp(-np.clip(z / total @ w["score"] + w["score0"], -30, 30))))


def fit(bags: list[np.ndarray], labels: list[int], seed: int = 7) -> Model:
    """Train on documents, each the array of its passages."""
    y = np.array(labels, float)
    if not len(y) or y.min() == y.max():
        return Model(constant=float(y.mean()) if len(y) else 0.5)
    rng = np.random.default_rng(seed)
    shapes = {"encode": (SIZE, HIDDEN), "encode0": (HIDDEN,), "tanh": (HIDDEN, ATTENTION), "gate": (HIDDEN, ATTENTION),
              "attend": (ATTENTION,), "score": (HIDDEN,), "score0": ()}
    model = Model({k: rng.normal(0, 1, s) / np.sqrt(s[0] if s else 1) for k, s in shapes.items()})
    model.weights["score0"] = np.zeros(())
    first = {k: np.zeros(s) for k, s in shapes.items()}
    second = {k: np.zeros(s) for k, s in shapes.items()}
    order = np.concatenate([rng.permutation(len(bags)) for _ in range(-(-STEPS * BATCH // len(bags)))])
    for step in range(STEPS):
        own = order[step * BATCH:(step + 1) * BATCH]
        x = np.concatenate([bags[i] for i in own]).astype(np.float64)
        starts = np.cumsum([0, *(len(bags[i]) for i in own[:-1])])
        rate = RATE * (1 - step / STEPS)
        for k, g in model.gradient(x, starts, y[own]).items():          # Adam
            first[k] = 0.9 * first[k] + 0.1 * g
            second[k] = 0.999 * second[k] + 0.001 * g * g
            ahead = first[k] / (1 - 0.9 ** (step + 1)) / (np.sqrt(second[k] / (1 - 0.999 ** (step + 1))) + 1e-8)
            model.weights[k] = model.weights[k] - rate * (ahead + DECAY * model.weights[k])
    return model


def train(docs: DataFrame, labels: DataFrame, label_col: str = "quality", train_docs: int = TRAIN_DOCS,
          train_chars: int = TRAIN_CHARS) -> Model:
    """Train from the labelled documents with the least hashes of the id; ``labels`` holds the rows to learn from."""
    sample = (labels.where(F.col(label_col).isNotNull() & F.col("doc_id").isNotNull())
              .select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("label"))
              .orderBy(F.xxhash64("doc_id"), "doc_id", "label").limit(train_docs)
              .groupBy("doc_id").agg(F.array_sort(F.collect_list("label")).alias("labels")))
    schema = pa.schema([("doc_id", pa.int64()), ("labels", pa.list_(pa.int32())), ("bag", pa.binary())])

    def bags(batches):
        yield from flat_map(batches, schema, lambda doc_id, labels, text: (
            (doc_id, labels, passages(text.encode()).astype(np.float16).tobytes()),))

    # the sample has ``train_docs`` small rows at most, so it goes to every task; only the sample's texts are
    # shuffled, one of each id and task, so ``train_docs`` bags at most are collected however often a row is repeated
    rows = (docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
            .where(F.length("text") <= train_chars).join(F.broadcast(sample), "doc_id")
            .groupBy("doc_id").agg(F.min(F.struct(F.xxhash64("text").alias("hash"), "text")).alias("least"),
                                   F.first("labels").alias("labels"))
            .select("doc_id", "labels", "least.text").mapInArrow(bags, "doc_id long, labels array<int>, bag binary").collect())
    rows.sort(key=lambda r: r["doc_id"])
    learnt = [(np.frombuffer(r["bag"], np.float16).reshape(-1, SIZE), label) for r in rows for label in r["labels"]]
    return fit([bag for bag, _ in learnt], [label for _, label in learnt])


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, score`` of every row."""
    schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])
    return (docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
            .mapInArrow(lambda batches: flat_map(batches, schema, lambda doc_id, text: ((doc_id, model.score(text.encode())),)),
                        "doc_id long, score double"))


def accepted(docs: DataFrame, model: Model, threshold: float, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose score reaches the threshold."""
    at = docs.columns.index(text_col)

    def run(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, 500):
                part = batch.slice(start, 500)
                yield part.filter(pa.array([model.score((t or "").encode()) >= threshold
                                            for t in part.column(at).to_pylist()], pa.bool_()))
    return docs.mapInArrow(run, docs.schema)
