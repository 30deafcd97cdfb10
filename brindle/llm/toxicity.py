"""Toxicity by multiple-instance learning: sentence scores joined by noisy-or, trained from document labels.

A document is a bag of sentences. Each sentence has odds exp(w.x + b) over its words and word beginnings, and a chance q
to make its document toxic: what these odds add to those of a sentence without any known feature. Sentences as such make
a background that saturates with their number, m = 1 + n * 100 / (n + 100), so that no clean text is toxic by its length.
The document is toxic with probability 1 - (1 - sigmoid(b)) ** m * prod(1 - q). Only documents are labelled; the
likelihood of the bag trains the sentence weights, so the sentences that carry a document's toxicity can be located
afterwards.

Defined results: a null text counts as empty; an empty text has no sentence and scores sigmoid(b).
Repeated rows are scored alike. Without labels of both classes the model knows only its prior and rejects nothing.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import held_out, labelled_sample, materialise, per_document, scratch, table

_SENTENCE = re.compile(r"(?<=[.!?])\s+|[\n\r]+")
_WORD = re.compile(r"[^\W\d_]+")
#: Lengths of word beginnings that are features beside the whole word.
PREFIXES = (3, 4, 5, 6)


@dataclass(frozen=True)
class ToxicityConfig:
    #: Training documents of each class at most: the documented bound of the sample that the fit sees.
    sample_per_class: int = 4000
    #: A feature must stand in so many toxic training documents, and be so many times as frequent there.
    min_documents: int = 4
    min_lift: float = 3.0
    steps: int = 200
    rate: float = 0.2
    l1: float = 1e-5
    l2: float = 1e-5
    start_bias: float = -7.0
    threshold: float = 0.5


@dataclass
class ToxicityModel:
    bias: float
    weights: dict[str, float] = field(default_factory=dict)

    def word_weight(self, word: str) -> float:
        get = self.weights.get
        return get(word, 0.0) + sum(get(f"{word[:k]}*", 0.0) for k in PREFIXES if len(word) > k)


def sentences(text: str) -> list[tuple[int, int]]:
    """Spans of the sentences of a text: cut after . ! ? before white space, and at line ends."""
    at, out = 0, []
    for m in _SENTENCE.finditer(text):
        if m.start() > at:
            out.append((at, m.start()))
        at = m.end()
    if len(text) > at:
        out.append((at, len(text)))
    return out


def _features(words: set[str]) -> set[str]:
    return words | {f"{w[:k]}*" for w in words for k in PREFIXES if len(w) > k}


def _sentence_features(text: str) -> list[set[str]]:
    return [_features(set(_WORD.findall(text[a:b].lower()))) for a, b in sentences(text)]


def screen(sample: DataFrame, config: ToxicityConfig) -> list[str]:
    """Features that stand in enough toxic documents, and in a larger share of them than of the others.

    Counted on the executors: each batch sends a feature's counts once. The sample bounds how many there are.
    """

    def count(cols):
        toxic: Counter = Counter()
        clean: Counter = Counter()
        for text, y in zip(cols["text"], cols["y"], strict=True):
            (toxic if y else clean).update(_features(set(_WORD.findall(text.lower()))))
        names = list(toxic.keys() | clean.keys())
        return {"f": names, "toxic": [toxic[f] for f in names], "clean": [clean[f] for f in names]}

    n = {r.y: r["count"] for r in sample.groupBy("y").count().collect()}
    counts = per_document(sample, ["text", "y"], count, "f string, toxic long, clean long").groupBy("f").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    lift = F.col("toxic") * max(n.get(0, 0), 1) / ((F.col("clean") + 0.5) * max(n.get(1, 0), 1))
    kept = counts.where((F.col("toxic") >= config.min_documents) & (lift >= config.min_lift))
    return sorted(r.f for r in kept.select("f").collect())


def fit(docs: DataFrame, labels: DataFrame, config: ToxicityConfig = ToxicityConfig(), label: str = "toxic") -> ToxicityModel:
    """Fit on a bounded sample of labelled rows: executors turn its texts into feature numbers, the driver fits."""
    with scratch(docs.sparkSession):
        sample = materialise(labelled_sample(docs, labels, label, config.sample_per_class), "toxicity-sample")
        names = screen(sample, config)
        number = {f: i for i, f in enumerate(names)}

        def bags(cols):
            y, size, body = [], [], []
            for text, v in zip(cols["text"], cols["y"], strict=True):
                bag = [sorted(number[f] for f in s if f in number) for s in _sentence_features(text)]
                y.append(v)
                size.append(np.array([len(s) for s in bag], "<u4").tobytes())
                body.append(np.array([i for s in bag for i in s], "<u4").tobytes())
            return {"y": y, "size": size, "body": body}

        rows = per_document(sample, ["text", "y"], bags, "y int, size binary, body binary").collect()
    if len({r.y for r in rows}) < 2 or not names:
        return ToxicityModel(config.start_bias)
    rows.sort(key=lambda r: (r.y, r.body, r.size))
    y = np.array([r.y for r in rows])
    sizes = [np.frombuffer(r.size, "<u4") for r in rows]
    sent_doc = np.repeat(np.arange(len(rows)), [len(s) for s in sizes])
    ids = np.concatenate([np.frombuffer(r.body, "<u4") for r in rows]).astype(np.int64)
    sent_of = np.repeat(np.arange(len(sent_doc)), np.concatenate(sizes).astype(np.int64))
    w, b = _noisy_or(ids, sent_of, sent_doc, y, len(names), config)
    return ToxicityModel(b, {f: float(v) for f, v in zip(names, w, strict=True) if abs(v) > 1e-3})


#: Sentences at which a document's background is half of its bound.
HALF = 100


def background(n):
    """How many times the odds of a sentence without features count in a document of n sentences: under HALF + 1."""
    return 1 + n * HALF / (n + HALF)


def likelihood(w, b, ids, sent_of, sent_doc, y):
    """(mean log loss of the bags, its gradient by w and b)."""
    n_doc = len(y)
    z = np.bincount(sent_of, w[ids], len(sent_doc)) + b
    soft, soft_b = np.logaddexp(0, z), np.logaddexp(0, b)
    p, p_b = np.exp(z - soft), math.exp(b - soft_b)
    counts = z > b
    times = background(np.bincount(sent_doc, minlength=n_doc))
    total = soft_b * times + np.bincount(sent_doc, np.where(counts, soft - soft_b, 0.0), n_doc)
    toxic = np.maximum(-np.expm1(-total), 1e-12)
    # of the loss by total: of a clean bag 1, of a toxic one minus its odds of being clean
    pull = np.where(y == 1, -np.exp(-total) / toxic, 1.0)
    g = np.where(counts, p * pull[sent_doc], 0.0)
    by_b = (p_b * times * pull).sum() + (np.where(counts, p - p_b, 0.0) * pull[sent_doc]).sum()
    loss = np.where(y == 1, -np.log(toxic), total).mean()
    return loss, np.append(np.bincount(ids, g[sent_of], len(w)), by_b) / n_doc


def _noisy_or(ids, sent_of, sent_doc, y, n, config):
    """Full-batch Adam on the bag likelihood; after each step weights shrink by l1 (proximal) and l2."""
    w, b = np.zeros(n), config.start_bias
    m, v = np.zeros(n + 1), np.zeros(n + 1)
    w += 1e-3  # above the bias, so that every sentence with a feature counts at first
    for step in range(1, config.steps + 1):
        _, grad = likelihood(w, b, ids, sent_of, sent_doc, y)
        grad[:n] += config.l2 * w
        m = 0.9 * m + 0.1 * grad
        v = 0.99 * v + 0.01 * grad * grad
        move = config.rate / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        new = np.append(w, b) - move * m / (1 - 0.9**step)
        w, b = new[:n], min(new[n], config.start_bias)
        w = np.sign(w) * np.maximum(np.abs(w) - config.l1 * move[:n], 0)
    return w, float(b)


class _Scorer:
    """Scores texts with a memo of word weights of bounded size."""

    def __init__(self, model: ToxicityModel, memo: int = 200_000):
        self.model, self.memo, self.known = model, memo, {}

    def weight(self, word: str) -> float:
        if len(self.known) >= self.memo:
            self.known.clear()
        v = self.known[word] = self.model.word_weight(word)
        return v

    def sentence(self, text: str) -> float:
        known, weight = self.known, self.weight
        total = 0.0
        for w in set(_WORD.findall(text)):
            v = known.get(w)
            total += weight(w) if v is None else v
        return total + self.model.bias

    def document(self, text: str) -> tuple[float, tuple[int, int] | None]:
        """(noisy-or of the sentences, span of the worst sentence)."""
        bias = self.model.bias
        base = math.log1p(math.exp(bias))
        spans = sentences(text)
        clean, worst, where = base * background(len(spans)), -math.inf, None
        for a, b in spans:
            z = self.sentence(text[a:b].lower())
            if z > bias:
                clean += (math.log1p(math.exp(z)) if z < 30 else z) - base
            if z > worst:
                worst, where = z, (a, b)
        return -math.expm1(-clean), where


def score(docs: DataFrame, model: ToxicityModel, threshold: float = 0.5) -> DataFrame:
    """Per document: doc_id, score, predicted, and the worst sentence (span and text) where it is predicted toxic.

    A narrow pass: no shuffle; the model is a few thousand weights and goes with the task.
    """

    def run(cols):
        scorer = _Scorer(model)
        got = [scorer.document(t or "") for t in cols["text"]]
        hit = [s >= threshold for s, _ in got]
        return {
            "doc_id": cols["doc_id"],
            "score": [s for s, _ in got],
            "predicted": [int(h) for h in hit],
            "worst_start": [w[0] if h and w else None for (_, w), h in zip(got, hit, strict=True)],
            "worst_sentence": [t[w[0] : w[1]] if h and w else None for (_, w), h, t in zip(got, hit, cols["text"], strict=True)],
        }

    return per_document(docs, ["doc_id", "text"], run, "doc_id long, score double, predicted int, worst_start int, worst_sentence string")


def reject(docs: DataFrame, model: ToxicityModel, threshold: float = 0.5) -> DataFrame:
    """The rows of docs that are not toxic, with all their columns: one narrow pass over whole rows."""

    def run(batches):
        import pyarrow as pa

        scorer = _Scorer(model)
        for batch in batches:
            text = batch.column(batch.schema.names.index("text"))
            yield batch.filter(pa.array([scorer.document(t.as_py() or "")[0] < threshold for t in text]))

    return docs.mapInArrow(run, docs.schema)


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    config = ToxicityConfig()
    model = fit(docs, table(spark, sf_dir, "labels"), config)
    out = score(docs, model, config.threshold)
    return out.select("doc_id", held_out(out.doc_id).alias("held_out"), "score", "predicted", "worst_start", "worst_sentence")
