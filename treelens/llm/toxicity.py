"""Toxicity: averaged subword-bag embeddings under a linear softmax.

A word is a bag of hashed character n-grams (with its padded whole form); a
window of text is the mean of its words' vectors; a linear softmax over that
mean gives the probability.  Embeddings and softmax are trained jointly in
numpy.  A document is judged by its most toxic window, and training uses that
window too: it is chosen anew before every pass (labels are per document).
Unseen misspellings share n-grams, and so vectors, with the words they twist.
"""

from __future__ import annotations

import re
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_sample, held_out, id_number, id_text, ship

BUCKETS, DIM = 1 << 17, 8
ORDERS = (3, 4, 5)
#: Words in a window; one window begins at every word.  Other words dilute a mean of few: by cross-validation on sf0.1's
#: training rows recall is 0.84 with three words and 0.91 with one, with as many false alarms (7 of 1365).
WINDOW = 1
EPOCHS, RATE = 16, 0.2
#: An n-gram is learned only if that many training texts have it (a hundredth of them, if that is less); the others stay at zero.
LEAST_TEXTS = 3
#: Weight of a toxic row's step; the other rows weigh 1.
POSITIVE = 1.0
#: Training rows at most, by a hash of their id.
TRAIN_ROWS = 6000

OUTPUT = "doc_id string, held_out boolean, score double, predicted int"
_WORD = re.compile(r"[^\W_]+")


def buckets(word: str) -> list[int]:
    """Hash buckets of the padded word and of its character n-grams."""
    padded = f"<{word}>".encode("utf-32-le", "surrogatepass")
    size = len(padded)
    return [crc32(padded) & (BUCKETS - 1)] + [crc32(padded[i : i + 4 * n]) & (BUCKETS - 1) for n in ORDERS for i in range(0, size - 4 * n + 1, 4)]


class Model:
    """Word vectors enter the softmax only through its weight difference, so a
    window's logit is the mean of one number per word, cached here."""

    def __init__(self, seed: int = 7):
        random = np.random.default_rng(seed)
        self.embed = random.normal(0, 0.02, (BUCKETS, DIM)).astype(np.float32)
        self.weight = random.normal(0, 0.5, (2, DIM)).astype(np.float32)
        self.bias = np.zeros(2, np.float32)
        self.pull: list[float] | None = None
        self.cache: dict[str, float] = {}

    def value(self, word: str) -> float:
        known = self.cache.get(word)
        if known is None:
            if len(self.cache) > 400_000:
                self.cache.clear()
            if self.pull is None:
                self.pull = (self.embed @ (self.weight[1] - self.weight[0])).tolist()
            of = buckets(word)
            known = self.cache[word] = sum(map(self.pull.__getitem__, of)) / len(of)
        return known

    def logit(self, text: str | None) -> float:
        """Largest window logit of the whole text; the bias alone without words."""
        words = _WORD.findall(text.lower()) if text else []
        return self._best(np.fromiter(map(self.value, words), np.float64, len(words)))[0]

    def _best(self, values: np.ndarray) -> tuple[float, tuple[int, int]]:
        offset, n = float(self.bias[1] - self.bias[0]), len(values)
        if not n:
            return offset, (0, 0)
        width = min(n, WINDOW)
        sums = np.concatenate([[0.0], np.cumsum(values)])
        means = (sums[width:] - sums[:-width]) / width
        best = int(np.argmax(means))
        return float(means[best]) + offset, (best, best + width)

    def train(self, rows: list[tuple[str, int]], epochs: int = EPOCHS, rate: float = RATE, seed: int = 7) -> None:
        """rows: (text, label 0 or 1)."""
        random = np.random.default_rng(seed)
        labels = np.array([y for _, y in rows], np.int64)
        if len(set(labels.tolist())) < 2:
            self.bias[:] = np.log(np.array([np.mean(labels == 0), np.mean(labels == 1)]) + 1e-3) if len(labels) else [1, 0]
            self.embed[:] = 0
            return
        known: dict[str, int] = {}
        texts = [np.fromiter((known.setdefault(w, len(known)) for w in _WORD.findall((t or "").lower())), np.int64) for t, _ in rows]
        bags = [np.array(buckets(w), np.int64) for w in known]
        sizes = np.array([len(b) for b in bags], np.int64)
        flat = np.concatenate(bags) if bags else np.empty(0, np.int64)
        first = np.concatenate([[0], np.cumsum(sizes)])
        had = np.zeros(BUCKETS, np.int64)
        for text in texts:
            of = np.unique(text)
            had[np.unique(np.concatenate([bags[w] for w in of]) if len(of) else of)] += 1
        frozen = had < min(LEAST_TEXTS, len(rows) / 100)
        self.embed[frozen] = 0
        # Adagrad's sums of squares
        speed = [np.full_like(self.embed, 1e-6), np.full_like(self.weight, 1e-2), np.full_like(self.bias, 1e-2)]
        for epoch in range(epochs):
            pull = self.embed @ (self.weight[1] - self.weight[0])
            value = np.add.reduceat(pull[flat], first[:-1]) / sizes if len(bags) else np.empty(0)
            # at first nothing is known: the whole text stands for its windows
            chosen = texts if epoch == 0 else [text[slice(*self._best(value[text])[1])] for text in texts]
            order = random.permutation(len(rows))
            for begin in range(0, len(order), 32):
                part = order[begin : begin + 32]
                self._step([chosen[i] for i in part], labels[part], rate * (1 - epoch / epochs), (flat, first, sizes), frozen, speed)
        self.pull, self.cache = None, {}

    def _step(self, texts: list[np.ndarray], labels: np.ndarray, rate: float, bags: tuple, frozen: np.ndarray, speed: list[np.ndarray]) -> None:
        flat, first, sizes = bags
        word = np.concatenate(texts)
        if not len(word):
            return
        row = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
        share = np.repeat(1 / np.maximum(1, [len(t) for t in texts]), [len(t) for t in texts]) / sizes[word]
        many = sizes[word]
        index = flat[np.repeat(first[word] - np.concatenate([[0], np.cumsum(many)[:-1]]), many) + np.arange(many.sum())]
        row, share = np.repeat(row, many), np.repeat(share, many)
        mean = np.stack([np.bincount(row, self.embed[index, d] * share, len(texts)) for d in range(DIM)], axis=1)
        scores = mean @ self.weight.T + self.bias
        p = np.exp(scores - scores.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        p[np.arange(len(texts)), labels] -= 1
        p *= np.where(labels == 1, POSITIVE, 1.0)[:, None]
        back = p @ self.weight
        moved, at = np.unique(index, return_inverse=True)
        slope = np.stack([np.bincount(at, back[row, d] * share, len(moved)) for d in range(DIM)], axis=1)
        slope[frozen[moved]] = 0
        for value, square, part, gradient in ((self.weight, speed[1], slice(None), p.T @ mean), (self.bias, speed[2], slice(None), p.sum(axis=0)), (self.embed, speed[0], moved, slope)):
            square[part] += gradient**2
            value[part] -= rate * gradient / np.sqrt(square[part])


def fit(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> Model:
    """Learns from at most ``train_rows`` labelled documents that are not held out.

    Labels other than 0 and 1 are ignored; of a document labelled more than
    once the largest label counts, of rows that repeat a doc_id one text.
    """
    known = labels.where("toxic in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    known = bounded_sample(known.where(~held_out(F.col("doc_id"))), "doc_id", train_rows)
    own = docs.select("doc_id", "text").join(F.broadcast(known), "doc_id")  # at most train_rows ids on the right
    rows = own.groupBy("doc_id").agg(F.min("text").alias("text"), F.first("toxic").alias("toxic")).orderBy("doc_id")
    model = Model()
    model.train([(r.text, r.toxic) for r in rows.select("text", "toxic").toLocalIterator()])
    return model


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every document's whole text.

    Null, empty and wordless texts get the score of the bias alone; repeated
    rows each get a row; a null doc_id has held_out null; extra columns are
    ignored; an empty table gives an empty table.
    """
    shared = ship(docs.sparkSession, model)

    def run(batches):
        model = shared()
        for batch in batches:
            logits = np.array([model.logit(t) for t in batch["text"]], np.float64)
            p = 1 / (1 + np.exp(-np.clip(logits, -500, 500)))
            yield pd.DataFrame({"doc_id": batch["doc_id"], "held_out": batch["held_out"], "score": p, "predicted": (p >= 0.5).astype("int32")})

    return id_number(docs.select(id_text("doc_id"), held_out(F.col("doc_id")).alias("held_out"), "text").mapInPandas(run, OUTPUT), "doc_id")
