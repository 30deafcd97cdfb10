"""Document quality from a linear-chain conditional random field over lines.

Each line gets small binned features (length, character classes, repeated words and lines, endings), its neighbours'
features too; the chain labels every line good or bad. Forward-backward marginals of good, weighted by line length,
give the share of good text, and a fitted logistic curve turns that share into the document's score.

Only documents are labelled. Training first fits the line potentials with each line under its document's label, then
takes as bad the lines of bad documents that those potentials call bad (all of them if none is), and fits the whole
chain, transitions included, to these line labels.

Defined results: a null text counts as empty; a text without lines has the mean share of the training documents and is
scored from that; repeated rows are scored alike. An empty label table gives score 0.5 everywhere.
"""

from __future__ import annotations

from bisect import bisect_right
from collections import Counter
from dataclasses import dataclass
from operator import eq

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from .common import held_out, labelled_sample, per_document, table

#: Bin edges of each feature of a line.
EDGES: dict[str, tuple[float, ...]] = {
    "length": (10, 25, 50, 100, 200, 400, 800),
    "words": (2, 4, 8, 16, 64),
    "upper": (0.02, 0.05, 0.1, 0.2, 0.35, 0.6),
    "digit": (0.01, 0.03, 0.1, 0.3),
    "symbol": (0.01, 0.03, 0.05, 0.08, 0.12, 0.2, 0.35),
    "bar": (0.005, 0.02, 0.05, 0.1),
    "bang": (0.005, 0.02, 0.05, 0.1, 0.2),
    "distinct": (0.1, 0.2, 0.35, 0.5, 0.65, 0.8, 0.9),
    "again": (0.02, 0.1, 0.3, 0.6),
    "word_length": (2, 3, 4, 5, 6, 8, 12),
    "copies": (2, 3, 5, 10),
    "same_as_before": (1,),
    "ends": (1, 2),
    "starts_low": (1,),
}
_NAMES = tuple(EDGES)
_WIDTH = max(len(e) for e in EDGES.values()) + 1


@dataclass(frozen=True)
class QualityConfig:
    #: Training documents of each class at most: the documented bound of the sample that the fit sees.
    sample_per_class: int = 2500
    steps: int = 150
    rate: float = 0.1
    l2: float = 1e-4
    threshold: float = 0.3


@dataclass
class QualityModel:
    #: Log-odds of good: per place (before, at, after the line), feature and bin; and a bias.
    unary: np.ndarray
    bias: float
    #: Log potentials of [from][to], 0 bad and 1 good.
    moves: np.ndarray
    slope: float = 0.0
    offset: float = 0.0
    #: The share taken for a text without lines.
    usual: float = 0.5


_kinds: dict[str, int] = {}


def _kind(c: str) -> int:
    """0 other letter or space, 1 capital, 2 digit, 3 other symbol, 4 bar, 5 exclamation mark."""
    k = 4 if c == "|" else 5 if c == "!" else 2 if c.isdigit() else 1 if c.isupper() else 0 if c.isalpha() or c.isspace() or c in ".,;:'\"()-?" else 3
    _kinds[c] = k
    return k


def line_bins(text: str) -> tuple[list[int], list[list[int]]]:
    """(length, bins of the features) of each line that has any text."""
    lines = [x for x in (line.strip() for line in text.split("\n")) if x]
    copies = Counter(lines)
    sizes, out, before = [], [], None
    get = _kinds.get
    for line in lines:
        n, words = len(line), line.split()
        m = [0] * 6
        for c, k in Counter(line).items():
            kind = get(c)
            m[_kind(c) if kind is None else kind] += k
        nw = len(words)
        last = line[-1]
        values = (
            n,
            nw,
            m[1] / n,
            m[2] / n,
            (m[3] + m[4] + m[5]) / n,
            m[4] / n,
            m[5] / n,
            len(set(words)) / nw,
            sum(map(eq, words, words[1:])) / nw,
            n / nw,
            copies[line],
            line == before,
            2 if last in ".?" else 1 if last.isalnum() else 0,
            line[0].islower(),
        )
        out.append([bisect_right(e, v) for e, v in zip(EDGES.values(), values, strict=True)])
        sizes.append(n)
        before = line
    return sizes, out


class Chains:
    """Lines of many documents, packed by place: at place t stand the documents with more than t lines, longest first."""

    def __init__(self, counts: np.ndarray, bins: np.ndarray):
        self.counts = counts
        self.order = np.argsort(-counts, kind="stable")
        self.steps = int(counts.max(initial=0))
        sorted_counts = counts[self.order]
        self.live = np.searchsorted(-sorted_counts, -np.arange(self.steps), "left")
        first = np.cumsum(counts) - counts
        self.rows = np.concatenate([first[self.order[:k]] + t for t, k in enumerate(self.live)]) if self.steps else np.zeros(0, np.int64)
        self.start = np.append(0, np.cumsum(self.live)).astype(np.int64)
        self.doc = np.repeat(np.arange(len(counts)), counts)
        f = np.arange(len(_NAMES))
        empty = len(_NAMES) * _WIDTH
        own = bins + f * _WIDTH
        pos = np.arange(len(bins)) - np.repeat(first, counts)
        prev = np.where((pos > 0)[:, None], np.roll(own, 1, axis=0), empty)
        follow = np.where((pos < np.repeat(counts, counts) - 1)[:, None], np.roll(own, -1, axis=0), empty)
        self.features = np.concatenate([prev, own + empty + 1, follow + 2 * (empty + 1)], axis=1)

    def unary(self, model: QualityModel) -> np.ndarray:
        return model.unary[self.features].sum(axis=1) + model.bias

    def marginals(self, u: np.ndarray, moves: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(P(good) of each line, expected counts of [from][to])."""
        good = 1 / (1 + np.exp(-np.clip(u, -40, 40)))
        phi = np.stack([1 - good, good], axis=1)[self.rows] + 1e-18
        m = np.exp(moves)
        a, c = np.empty_like(phi), np.empty(len(phi))
        for t in range(self.steps):
            i, j = self.start[t], self.start[t + 1]
            x = phi[i:j] if t == 0 else (a[self.start[t - 1] : self.start[t - 1] + j - i] @ m) * phi[i:j]
            c[i:j] = x.sum(axis=1)
            a[i:j] = x / c[i:j, None]
        b = np.ones_like(phi)
        pairs = np.zeros((2, 2))
        for t in range(self.steps - 2, -1, -1):
            i, j, k = self.start[t], self.start[t + 1], self.start[t + 2]
            y = phi[j:k] * b[j:k] / c[j:k, None]
            b[i : i + k - j] = y @ m.T
            pairs += (a[i : i + k - j].T @ y) * m
        g = a * b
        out = np.empty(len(phi))
        out[self.rows] = g[:, 1] / g.sum(axis=1)
        return out, pairs

    def seen_moves(self, y: np.ndarray) -> np.ndarray:
        same = self.doc[1:] == self.doc[:-1]
        out = np.zeros((2, 2))
        np.add.at(out, (y[:-1][same].astype(int), y[1:][same].astype(int)), 1)
        return out


def shares(chains: Chains, sizes: np.ndarray, model: QualityModel) -> np.ndarray:
    """Length-weighted share of good text of each document."""
    good, _ = chains.marginals(chains.unary(model), model.moves)
    n = len(chains.counts)
    total = np.bincount(chains.doc, sizes, n)
    return np.where(total > 0, np.bincount(chains.doc, good * sizes, n) / np.maximum(total, 1), model.usual)


def score_of(share: np.ndarray, model: QualityModel) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(model.slope * share + model.offset, -40, 40)))


def fit(docs: DataFrame, labels: DataFrame, config: QualityConfig = QualityConfig(), label: str = "quality") -> QualityModel:
    """Fit on a bounded sample of labelled rows: executors turn lines into bins, the driver fits the chain."""

    def run(cols):
        got = [line_bins(t) for t in cols["text"]]
        return {"y": cols["y"], "size": [np.array(s, "<u4").tobytes() for s, _ in got], "bins": [np.array(b, np.uint8).tobytes() for _, b in got]}

    sample = labelled_sample(docs, labels, label, config.sample_per_class)
    rows = per_document(sample, ["text", "y"], run, "y int, size binary, bins binary").collect()
    rows = sorted((r for r in rows if r.size), key=lambda r: (r.y, r.size, r.bins))
    n_features = 3 * (len(_NAMES) * _WIDTH + 1)
    model = QualityModel(np.zeros(n_features), 0.0, np.zeros((2, 2)))
    if len({r.y for r in rows}) < 2:
        return model
    label_of = np.array([r.y for r in rows])
    sizes = [np.frombuffer(r.size, "<u4") for r in rows]
    bins = np.concatenate([np.frombuffer(r.bins, np.uint8) for r in rows]).reshape(-1, len(_NAMES)).astype(np.int32)
    chains = Chains(np.array([len(s) for s in sizes]), bins)
    size = np.concatenate(sizes).astype(float)
    # a document's lines together weigh as much as any other document's
    weight = 1 / chains.counts[chains.doc]
    y = label_of[chains.doc]
    _fit(chains, y, weight, model, config, moves=False)
    called = chains.unary(model) > 0
    worst = np.bincount(chains.doc, ~called, len(label_of)) > 0
    y = np.where(y == 1, 1, np.where(worst[chains.doc], called, 0))
    _fit(chains, y, np.ones(len(y)), model, config, moves=True)
    share = shares(chains, size, model)
    model.usual = float(share.mean())
    model.slope, model.offset = _curve(share, label_of)
    return model


def _fit(chains: Chains, y: np.ndarray, weight: np.ndarray, model: QualityModel, config: QualityConfig, moves: bool) -> None:
    """Adam on the (weighted) log likelihood of the line labels."""
    n = len(model.unary)
    theta = np.concatenate([model.unary, [model.bias], model.moves.ravel()])
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    seen = chains.seen_moves(y)
    flat, width = chains.features.ravel(), chains.features.shape[1]
    for step in range(1, config.steps + 1):
        now = QualityModel(theta[:n], theta[n], theta[n + 1 :].reshape(2, 2))
        u = chains.unary(now)
        if moves:
            good, pairs = chains.marginals(u, now.moves)
        else:
            good, pairs = 1 / (1 + np.exp(-np.clip(u, -40, 40))), seen
        g = (y - good) * weight
        grad = np.concatenate([np.bincount(flat, np.repeat(g, width), n), [g.sum()], (seen - pairs).ravel() * moves]) / weight.sum()
        grad -= config.l2 * theta
        m = 0.9 * m + 0.1 * grad
        v = 0.999 * v + 0.001 * grad * grad
        theta = theta + config.rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    model.unary, model.bias, model.moves = theta[:n], float(theta[n]), theta[n + 1 :].reshape(2, 2)


def _curve(share: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a logistic curve from share to label, by Newton steps with a small ridge."""
    x = np.stack([share, np.ones_like(share)], axis=1)
    w = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -40, 40)))
        h = (x * (p * (1 - p))[:, None]).T @ x + 1e-2 * np.eye(2)
        w = w + np.linalg.solve(h, x.T @ (y - p) - 1e-2 * w)
    return float(w[0]), float(w[1])


def score(docs: DataFrame, model: QualityModel, threshold: float = 0.3) -> DataFrame:
    """Per document: doc_id, score, predicted, good_share, n_lines. A narrow pass."""

    def run(cols):
        got = [line_bins(t or "") for t in cols["text"]]
        counts = np.array([len(s) for s, _ in got])
        bins = np.array([b for _, x in got for b in x], np.int32).reshape(-1, len(_NAMES))
        share = shares(Chains(counts, bins), np.array([n for s, _ in got for n in s], float), model)
        p = score_of(share, model)
        return {"doc_id": cols["doc_id"], "score": p, "predicted": (p >= threshold).astype(np.int32), "good_share": share, "n_lines": counts}

    return per_document(docs, ["doc_id", "text"], run, "doc_id long, score double, predicted int, good_share double, n_lines long")


def op4_line_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    config = QualityConfig()
    out = score(docs, fit(docs, table(spark, sf_dir, "labels"), config), config.threshold)
    return out.select("doc_id", held_out(out.doc_id).alias("held_out"), "score", "predicted", "good_share", "n_lines")
