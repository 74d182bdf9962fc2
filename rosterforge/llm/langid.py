"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Features are counts of character 1- to 3-grams of the lower-cased text in 2**bits hashed buckets, damped by ln(1 + tf), times
idf over all rows that may be learned from, scaled to length 1. The model is trained by follow-the-regularised-leader
(per-coordinate rates, L1 and L2 penalties) on a bounded sample, per_class rows of each language, and its
temperature is fitted on rows of the sample that training left out.

Texts are scored where they lie, whole, without a shuffle. Null texts and texts without a letter get "und" and score 0;
so does every text if there is nothing to learn from. Null languages are not learned from; "und" is never learned.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import ngrams as ng
from .common import in_arrow, learn_row, released

UND = "und"


@dataclass(frozen=True)
class Params:
    orders: tuple[int, ...] = (1, 2, 3)
    bits: int = 15
    per_class: int = 600
    epochs: int = 3
    rate: float = 1.0
    beta: float = 1.0
    l1: float = 0.02
    l2: float = 0.5
    seed: int = 7


@dataclass(frozen=True)
class Model:
    languages: list[str]
    idf: np.ndarray
    weights: np.ndarray  # buckets x languages
    bias: np.ndarray
    temperature: float
    orders: tuple[int, ...]
    bits: int

    def probabilities(self, tf: np.ndarray) -> np.ndarray:
        k = np.flatnonzero(tf)
        v = tfidf(tf[k], self.idf[k])
        return softmax((v @ self.weights[k] + self.bias) / self.temperature)


def tfidf(tf: np.ndarray, idf: np.ndarray) -> np.ndarray:
    v = np.log1p(tf) * idf
    return v / max(np.sqrt((v * v).sum()), 1e-9)


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def follow_the_leader(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, size: int, classes: int, p: Params) -> tuple[np.ndarray, np.ndarray]:
    """FTRL-proximal: weights (size x classes) and bias. The bias has no penalty."""
    z, n = np.zeros((size + 1, classes)), np.zeros((size + 1, classes))
    rng = np.random.default_rng(p.seed)

    def weights(zz: np.ndarray, nn: np.ndarray, l1: float, l2: float) -> np.ndarray:
        return np.where(np.abs(zz) <= l1, 0.0, -(zz - np.sign(zz) * l1) / ((p.beta + np.sqrt(nn)) / p.rate + l2))

    for _ in range(p.epochs):
        for i in rng.permutation(len(rows)):
            k, v = rows[i]
            w, b = weights(z[k], n[k], p.l1, p.l2), weights(z[-1], n[-1], 0, 0)
            g = softmax(v @ w + b)
            g[y[i]] -= 1
            for at, grad, old in ((k, v[:, None] * g, w), (size, g, b)):
                s = (np.sqrt(n[at] + grad * grad) - np.sqrt(n[at])) / p.rate
                z[at] += grad - s * old
                n[at] += grad * grad
    return weights(z[:-1], n[:-1], p.l1, p.l2), weights(z[-1], n[-1], 0, 0)


def fit_temperature(logits: np.ndarray, y: np.ndarray) -> float:
    """The temperature of least log loss, by golden-section search on its logarithm."""
    loss = lambda t: -np.log(np.maximum(softmax(logits / np.exp(t))[np.arange(len(y)), y], 1e-12)).mean()
    a, b, r = -3.0, 3.0, (5**0.5 - 1) / 2
    for _ in range(40):
        c, d = b - r * (b - a), a + r * (b - a)
        a, b = (a, d) if loss(c) < loss(d) else (c, b)
    return float(np.exp((a + b) / 2))


def learn(docs: DataFrame, params: Params = Params(), lang_col: str = "lang") -> Model | None:
    """A model from text and language of the rows that may be learned from; None if there are none."""
    rows = docs.select("doc_id", "text", F.col(lang_col).alias("lang")).filter(learn_row(F.col("doc_id")) & F.col("lang").isNotNull() & (F.col("lang") != UND) & F.col("text").isNotNull())
    sizes = {r[0]: r[1] for r in rows.groupBy("lang").count().collect()}  # one row per language
    if not sizes:
        return None
    languages = sorted(sizes)
    n, df = ng.document_frequencies(rows.withColumn("_c", F.lit(0)), "_c", "text", ng.char_rows, params.orders, params.bits, 1)
    idf = np.log((1 + n[0]) / (1 + df[0])) + 1

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k, v = [], []
            for r in ng.char_rows(batch.column("text")):
                tf = ng.counts(r, params.orders, params.bits)
                k.append(np.flatnonzero(tf).astype(np.int32).tobytes())
                v.append(tf[tf > 0].astype(np.int32).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("lang"), pa.array(k, pa.binary()), pa.array(v, pa.binary())], ["doc_id", "lang", "k", "v"])

    sample = ng.bounded_sample(rows, "lang", params.per_class, "doc_id", sizes)
    got = in_arrow(sample.select("doc_id", "lang", "text"), features, "doc_id long, lang string, k binary, v binary").toPandas().sort_values(["doc_id", "lang", "k", "v"]).reset_index(drop=True)
    x = [(k := np.frombuffer(a, np.int32), tfidf(np.frombuffer(b, np.int32), idf[k])) for a, b in zip(got.k, got.v, strict=True)]
    y = got.lang.map({c: i for i, c in enumerate(languages)}).to_numpy()
    mine = np.arange(len(y)) % 5 != 0
    w, b = follow_the_leader([r for r, m in zip(x, mine, strict=True) if m], y[mine], 1 << params.bits, len(languages), params)
    temperature = 1.0
    if (~mine).sum() >= 20:
        temperature = fit_temperature(np.stack([v @ w[k] + b for (k, v), m in zip(x, mine, strict=True) if not m]), y[~mine])
    return Model(languages, idf, w, b, temperature, params.orders, params.bits)


def predict(docs: DataFrame, model: Model | None, text_col: str = "text") -> DataFrame:
    """docs with lang_pred and lang_score."""
    keep = [c for c in docs.columns if c not in ("lang_pred", "lang_score")]
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, alpha = sent.value, ng.letters()
        for batch in batches:
            lang, score = [], []
            for row in ng.char_rows(batch.column(text_col)):
                if m is None or not alpha[row].any():
                    lang.append(UND)
                    score.append(0.0)
                    continue
                p = m.probabilities(ng.counts(row, m.orders, m.bits))
                best = int(p.argmax())
                lang.append(m.languages[best])
                score.append(float(p[best]))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(lang, pa.string()), pa.array(score, pa.float64())], [*keep, "lang_pred", "lang_score"])

    schema = docs.select(*keep).withColumns({"lang_pred": F.lit(""), "lang_score": F.lit(0.0)}).schema
    return in_arrow(docs.select(*keep), released(run), schema)
