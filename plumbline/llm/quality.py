"""Quality by attention-based multiple-instance learning.

A document is a bag of passages of PASSAGE bytes. Every passage is encoded: frequencies of byte classes and of pairs
of neighbouring classes, and how its words repeat, pass through a learned tanh layer. A gated attention network
(tanh and sigmoid branches) weighs the passages; the weighted sum passes a logistic output. Encoder, attention and
output are learned together from document labels alone, by Adam on a bounded sample of labelled training rows
(at most MAX_DOCS, drawn by a hash of id and text; of a text with over MAX_BAG passages, as many evenly spaced ones over
the whole text teach). Every passage of every text is scored.

Defined results: null and empty texts are one passage without bytes and get a score too; without both labels among
the training rows every score is the share of label 1 (0.5 without any); repeated rows get equal scores; columns
named like outputs are replaced.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame

from plumbline.llm.common import arrow_limits, labelled_sample, map_text, others, run_hashes, runs

PASSAGE = 1024
MAX_DOCS = 4000
MAX_BAG = 16
HIDDEN, GATE, EPOCHS, RATE = 24, 16, 40, 0.01

_CLASSES = ["abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " \t", "\n\r", ".", ",", "!?", "|", "#$%&*~^", "'\"`", "()[]{}<>", "-_/\\=+:;@"]
CLASS = np.full(256, len(_CLASSES), np.int64)  # what no class names: control and non-ASCII bytes
for _i, _chars in enumerate(_CLASSES):
    CLASS[np.frombuffer(_chars.encode(), np.uint8)] = _i
N_CLASSES = len(_CLASSES) + 1
N_FEATURES = N_CLASSES + N_CLASSES**2 + 3
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[0x20, *range(0x09, 0x0E)]] = False
FOLD = np.arange(256, dtype=np.uint8)
FOLD[0x41:0x5B] += 32


def passages(data: np.ndarray, at: np.ndarray, size: int = PASSAGE) -> tuple[np.ndarray, np.ndarray]:
    """Features of each passage of each text, and the number of passages before each text."""
    length = np.diff(at)
    count = np.maximum(1, -(-length // size))
    first = np.concatenate([[0], np.cumsum(count)])
    n = int(first[-1])
    where = np.repeat(first[:-1], length) + (np.arange(len(data)) - np.repeat(at[:-1], length)) // size
    kind = CLASS[data]
    out = np.zeros((n, N_FEATURES), np.float32)
    held = np.maximum(1, np.bincount(where, minlength=n))[:, None]
    out[:, :N_CLASSES] = np.sqrt(np.bincount(where * N_CLASSES + kind, minlength=n * N_CLASSES).reshape(n, -1) / held)
    pair = (where[1:] * N_CLASSES + kind[:-1]) * N_CLASSES + kind[1:]
    pair = pair[where[1:] == where[:-1]]
    out[:, N_CLASSES:-3] = np.sqrt(np.bincount(pair, minlength=n * N_CLASSES**2).reshape(n, -1) / held)
    starts, ends, _, marks = runs(data, at, NOT_SPACE)
    if len(starts):
        word, of = run_hashes(FOLD[data], starts, ends, marks), where[starts]
        words = np.maximum(1, np.bincount(of, minlength=n))
        again = (word[1:] == word[:-1]) & (of[1:] == of[:-1])
        order = np.lexsort((word, of))
        known = (word[order][1:] == word[order][:-1]) & (of[order][1:] == of[order][:-1])
        out[:, -3] = np.bincount(of[1:][again], minlength=n) / words
        out[:, -2] = np.bincount(of[order][1:][known], minlength=n) / words
        out[:, -1] = np.log1p(np.bincount(of, ends - starts, n) / words) / 4
    return out, first


class Model:
    """x -> tanh layer -> gated attention over a bag -> logistic."""

    def __init__(self, x: np.ndarray, bags: np.ndarray, y: np.ndarray, *, seed: int = 7, epochs: int = EPOCHS) -> None:
        """x: passages; bags: passages before each document (one entry more than documents); y: labels."""
        rng = np.random.default_rng(seed)
        self.mean, self.scale = x.mean(0), x.std(0) + 0.02
        x = ((x - self.mean) / self.scale).astype(np.float32)
        f, h, g = x.shape[1], HIDDEN, GATE
        share = float(y.mean())
        self.w = {
            "w": rng.normal(0, 1 / np.sqrt(f), (f, h)), "b": np.zeros(h), "v": rng.normal(0, 1 / np.sqrt(h), (h, g)),
            "u": rng.normal(0, 1 / np.sqrt(h), (h, g)), "a": np.zeros(g), "c": np.zeros(h), "d": np.array([np.log(share / (1 - share))]),
        }
        m = {k: np.zeros_like(p) for k, p in self.w.items()}
        s = {k: np.zeros_like(p) for k, p in self.w.items()}
        step, docs = 0, len(y)
        for _ in range(epochs):
            order = rng.permutation(docs)
            for part in np.array_split(order, max(1, docs // 64)):
                rows = np.concatenate([np.arange(bags[i], bags[i + 1]) for i in part])
                sizes = bags[part + 1] - bags[part]
                grads = self._gradients(x[rows], np.concatenate([[0], np.cumsum(sizes)]), y[part])
                step += 1
                for k, grad in grads.items():
                    grad = grad + 1e-3 * self.w[k] * (k in "wvu")
                    m[k] = 0.9 * m[k] + 0.1 * grad
                    s[k] = 0.999 * s[k] + 0.001 * grad**2
                    self.w[k] -= RATE * (m[k] / (1 - 0.9**step)) / (np.sqrt(s[k] / (1 - 0.999**step)) + 1e-8)

    def _forward(self, x: np.ndarray, bags: np.ndarray):
        w = self.w
        hidden = np.tanh(x @ w["w"] + w["b"])
        left, right = np.tanh(hidden @ w["v"]), 1 / (1 + np.exp(-(hidden @ w["u"])))
        raw = (left * right) @ w["a"]
        sizes = np.diff(bags)
        raw = np.exp(raw - np.repeat(np.maximum.reduceat(raw, bags[:-1]), sizes))
        weight = raw / np.repeat(np.add.reduceat(raw, bags[:-1]), sizes)
        bag = np.add.reduceat(weight[:, None] * hidden, bags[:-1], axis=0)
        return hidden, left, right, weight, bag, 1 / (1 + np.exp(-(bag @ w["c"] + w["d"])))

    def _gradients(self, x: np.ndarray, bags: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        w, sizes = self.w, np.diff(bags)
        hidden, left, right, weight, bag, p = self._forward(x, bags)
        out = (p - y) / len(y)
        to_bag = np.repeat(out, sizes)[:, None] * w["c"]
        each = (to_bag * hidden).sum(1)
        mean = np.repeat(np.add.reduceat(weight * each, bags[:-1]), sizes)
        to_raw = weight * (each - mean)
        to_left = to_raw[:, None] * w["a"] * right * (1 - left**2)
        to_right = to_raw[:, None] * w["a"] * left * right * (1 - right)
        to_hidden = (weight[:, None] * to_bag + to_left @ w["v"].T + to_right @ w["u"].T) * (1 - hidden**2)
        return {"w": x.T @ to_hidden, "b": to_hidden.sum(0), "v": hidden.T @ to_left, "u": hidden.T @ to_right, "a": (left * right).T @ to_raw, "c": bag.T @ out, "d": np.array([out.sum()])}

    def score(self, x: np.ndarray, bags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Scores of bags, and attention weights of their passages."""
        got = self._forward((x - self.mean) / self.scale, bags)
        return got[5], got[3]


def fit(sample: DataFrame) -> Model | float:
    """The model of a bounded sample (y, text), or the share of label 1 where it doesn't hold both labels."""

    def make():
        def work(data: np.ndarray, at: np.ndarray) -> dict[str, object]:
            x, first = passages(data, at)
            return {"x": [x[np.unique(np.linspace(a, b - 1, min(b - a, MAX_BAG)).astype(int))].tobytes() for a, b in zip(first[:-1], first[1:], strict=True)]}

        return work

    got = map_text(sample, make, "x binary", ["y"]).toPandas()
    got = got.sort_values(["y", "x"])  # the order doesn't depend on partitions
    if got.y.nunique() < 2:
        return float(got.y.mean()) if len(got) else 0.5
    bags = [np.frombuffer(x, np.float32).reshape(-1, N_FEATURES) for x in got.x]
    return Model(np.concatenate(bags), np.concatenate([[0], np.cumsum([len(b) for b in bags])]), got.y.to_numpy(float))


def score(docs: DataFrame, model: Model | float, *, keep: list[str] | None = None, text: str = "text") -> DataFrame:
    """docs' columns `keep` (default: all) with score, n_passages and top_passage (the one of most weight, from 0)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    keep = others(docs.columns if keep is None else keep, ["score", "n_passages", "top_passage"])

    def make():
        known = shared.value

        def work(data: np.ndarray, at: np.ndarray) -> dict[str, object]:
            x, first = passages(data, at)
            count = np.diff(first)
            if isinstance(known, float):
                return {"score": np.full(len(count), known), "n_passages": count, "top_passage": np.zeros(len(count), int)}
            p, weight = known.score(x, first)
            of = np.repeat(np.arange(len(count)), count)
            order = np.lexsort((np.arange(len(of)), -weight, of))
            return {"score": p, "n_passages": count, "top_passage": order[first[:-1]] - first[:-1]}

        return work

    return map_text(docs, make, "score double, n_passages int, top_passage int", keep, text)


def classify(docs: DataFrame, labels: DataFrame, train: Column, *, label: str = "quality", doc_id: str = "doc_id", keep: list[str] | None = None, text: str = "text", max_docs: int = MAX_DOCS) -> DataFrame:
    """score() of docs by a model of labels' rows, joined by id. train: which documents may teach."""
    arrow_limits(docs.sparkSession)
    sample = labelled_sample(docs, labels, train, label=label, doc_id=doc_id, text=text, max_docs=max_docs)
    return score(docs, fit(sample), keep=keep, text=text)
