"""Quality by attention-based multiple-instance learning.

A document is a bag of passages (lines, long ones cut by words). Every passage is encoded
by a small network over its form; gated attention weights, learnt from the labels of
documents alone, combine the passages into one representation, which is scored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_LETTERS = 128
_STATS = 8
_BLOCK = 2048


def passages(text: str, words: int) -> Iterator[list[str]]:
    """The words of each passage; a text without words is one empty passage."""
    empty = True
    for line in text.split("\n"):
        parts = line.split()
        for at in range(0, len(parts), words):
            empty = False
            yield parts[at : at + words]
    if empty:
        yield []


def encode_form(bags: list[list[str]]) -> np.ndarray:
    """One row per passage: shares of byte values, and how its words vary and repeat."""
    joined = [" ".join(words).encode("utf-8", "replace") for words in bags]
    sizes = np.array([len(j) for j in joined])
    flat = np.minimum(np.frombuffer(b"".join(joined), dtype=np.uint8), _LETTERS - 1)
    cell = np.repeat(np.arange(len(bags)) * _LETTERS, sizes) + flat
    shares = np.bincount(cell, minlength=len(bags) * _LETTERS).reshape(len(bags), _LETTERS)
    shares = np.sqrt(shares / np.maximum(sizes, 1)[:, None])
    stats = np.zeros((len(bags), _STATS))
    for row, words in zip(stats, bags, strict=True):
        if words:
            n = len(words)
            row[:] = (
                np.log1p(n), len(set(words)) / n, sum(map(eq, words, words[1:])) / n,
                sum(map(str.isupper, words)) / n, sum(map(str.isalpha, words)) / n,
                sum(map(str.istitle, words)) / n, sum(map(len, words)) / n / 10, 1.0,
            )
    return np.hstack([shares, stats]).astype(np.float32)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


@dataclass
class BagModel:
    """Weights by name; ``mean`` and ``scale`` standardise the form of a passage."""

    weights: dict[str, np.ndarray]
    mean: np.ndarray
    scale: np.ndarray
    words: int

    def attend(self, form: np.ndarray) -> tuple[np.ndarray, ...]:
        """Encoded passages, both gates, and unnormalised attention.

        Gates lie in (-1, 1) and (0, 1), so the exponent is bounded by the weights.
        """
        w = self.weights
        hidden = np.tanh(form @ w["encode"] + w["encode_0"])
        content, gate = np.tanh(hidden @ w["content"]), _sigmoid(hidden @ w["gate"])
        return hidden, content, gate, np.exp(np.clip((content * gate) @ w["attend"], -30, 30))

    def scores(self, texts: list[str]) -> np.ndarray:
        """Probability of label 1; sums over passages run block by block."""
        size = len(self.weights["score"])
        mass, total = np.zeros(len(texts)), np.zeros((len(texts), size))
        bags, owners = [], []

        def add() -> None:
            form = (encode_form(bags) - self.mean) / self.scale
            hidden, _, _, attention = self.attend(form)
            np.add.at(mass, owners, attention)
            np.add.at(total, owners, attention[:, None] * hidden)
            bags.clear()
            owners.clear()

        for owner, text in enumerate(texts):
            for words in passages(text, self.words):
                bags.append(words)
                owners.append(owner)
                if len(bags) >= _BLOCK:
                    add()
        if bags:
            add()
        return _sigmoid((total / mass[:, None]) @ self.weights["score"] + self.weights["score_0"])


def fit(
    texts: list[str], labels: list[int], words: int = 100, hidden: int = 24, gates: int = 12, epochs: int = 25,
    rate: float = 4e-3, decay: float = 1e-4, batch: int = 64, seed: int = 11,
) -> BagModel | None:
    """Gradient descent (Adam) on the log loss of document labels; None without labels."""
    if not texts:
        return None
    bags = [list(passages(t, words)) for t in texts]
    sizes = np.array([len(b) for b in bags])
    form = np.vstack([encode_form(b) for b in bags])
    mean, scale = form.mean(axis=0), form.std(axis=0) + 0.02
    form = (form - mean) / scale
    starts = np.concatenate([[0], np.cumsum(sizes)])
    target = np.array(labels, dtype=np.float64)
    rng = np.random.default_rng(seed)
    shapes = {"encode": (form.shape[1], hidden), "encode_0": (hidden,), "content": (hidden, gates),
              "gate": (hidden, gates), "attend": (gates,), "score": (hidden,), "score_0": ()}
    w = {k: rng.normal(0, 1 / np.sqrt(s[0] if s else 1), s) if len(s) == 2 or k in ("attend", "score") else np.zeros(s)
         for k, s in shapes.items()}
    share = np.clip(target.mean(), 0.01, 0.99)
    w["score_0"] = np.array(np.log(share / (1 - share)))
    model = BagModel(w, mean, scale, words)
    first, second = ({k: np.zeros(s) for k, s in shapes.items()} for _ in range(2))
    step = 0
    for _ in range(epochs):
        order = rng.permutation(len(texts))
        for at in range(0, len(order), batch):
            docs = order[at : at + batch]
            x = np.vstack([form[starts[d] : starts[d + 1]] for d in docs])
            bounds = np.concatenate([[0], np.cumsum(sizes[docs])[:-1]])
            owner = np.repeat(np.arange(len(docs)), sizes[docs])
            h, content, gate, attention = model.attend(x)
            weight = attention / np.add.reduceat(attention, bounds)[owner]
            z = np.add.reduceat(weight[:, None] * h, bounds, axis=0)
            error = (_sigmoid(z @ w["score"] + w["score_0"]) - target[docs]) / len(docs)
            dz = (error[:, None] * w["score"])[owner]
            pull = (h * dz).sum(axis=1)
            de = weight * (pull - np.add.reduceat(weight * pull, bounds)[owner])
            dgated = de[:, None] * w["attend"]
            dcontent, dgate = dgated * gate * (1 - content**2), dgated * content * gate * (1 - gate)
            dh = weight[:, None] * dz + dcontent @ w["content"].T + dgate @ w["gate"].T
            dform = dh * (1 - h**2)
            gradient = {
                "encode": x.T @ dform, "encode_0": dform.sum(axis=0), "content": h.T @ dcontent, "gate": h.T @ dgate,
                "attend": (content * gate).T @ de, "score": z.T @ error, "score_0": error.sum(),
            }
            step += 1
            for k, g in gradient.items():
                g = g + decay * w[k]
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.999 * second[k] + 0.001 * g * g
                w[k] = w[k] - rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
    return model


def training_sample(
    docs: DataFrame, labels: DataFrame, doc_id: str, text: str, label: str, keep: Column, rows: int, longest_text: int
) -> list[tuple[str, int]]:
    """At most ``rows`` labelled texts, chosen by a hash of the id.

    The limit falls on the labels, so what is broadcast to the documents is bounded.
    """
    known = labels.where(F.col(label).isNotNull() & F.col(doc_id).isNotNull() & keep)
    known = known.groupBy(F.col(doc_id).alias("id")).agg(F.max(label).cast("int").alias("label"))
    chosen = known.orderBy(F.xxhash64("id"), "id").limit(rows)
    texts = docs.select(F.col(doc_id).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    found = texts.join(F.broadcast(chosen), "id").where(F.length("text") <= longest_text)
    return [(r["text"], r["label"]) for r in sorted(found.collect(), key=lambda r: (r["id"], r["text"]))]


def fit_on(
    docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality",
    keep: Column | None = None, rows: int = 6000, longest_text: int = 20_000, **options,
) -> BagModel | None:
    """Fit on a bounded sample: ``rows`` labels whose texts have up to ``longest_text`` letters.

    ``keep`` is a condition on the labels. Rows of ``labels`` with a null id or label
    teach nothing; of repeated ids the larger label counts.
    """
    condition = F.lit(True) if keep is None else keep
    sample = training_sample(docs, labels, doc_id, text, label, condition, rows, longest_text)
    return fit([t for t, _ in sample], [y for _, y in sample], **options)


def score(docs: DataFrame, model: BagModel | None, text: str = "text", out: str = "score") -> DataFrame:
    """``docs`` with the probability of label 1 for each whole text.

    A null or empty text is one empty passage and scored like any other. Without a model
    (no labels) every score is 0.5. Other columns are passed on.
    """

    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            texts = ["" if t is None else t for t in batch]
            yield pd.Series(model.scores(texts) if model else np.full(len(texts), 0.5), dtype="float64")

    return docs.withColumn(out, F.pandas_udf(scored, "double")(F.col(text)))
