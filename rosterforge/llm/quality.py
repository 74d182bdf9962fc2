"""Quality classifier: naive Bayes support vectors.

The features are indicators of byte 1- to 3-grams, hashed into 2**bits buckets. A feature's value is its class
log-count ratio, counted over all labelled rows that may be learned from. A linear hinge-loss model over these, rows scaled
to length 1, is fitted by dual coordinate descent on a bounded, documented sample (per_class rows of each label) and
interpolated with the naive Bayes weights; Platt's logistic curve, fitted on rows of the sample that the model didn't
see, makes a score of it.

Texts are scored where they lie: one pass, no shuffle. Null and empty texts get the score of a text without features.
Labels of one id that differ, null labels and null ids are not learned from. Without rows of both labels all scores are the
share of label 1 (0.5 without any).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import ngrams as ng
from .common import in_arrow, learn_row

#: Labelled rows are broadcast up to this count (16 bytes each); beyond it the texts are shuffled to them.
LABEL_ROWS = 1_000_000


@dataclass(frozen=True)
class Params:
    orders: tuple[int, ...] = (1, 2, 3)
    bits: int = 17
    per_class: int = 3000
    alpha: float = 1.0
    cost: float = 1.0
    epochs: int = 15
    beta: float = 0.5
    seed: int = 3


@dataclass(frozen=True)
class Model:
    weights: np.ndarray  # of an indicator, ratio included
    ratio: np.ndarray
    bias: float
    slope: float
    shift: float
    orders: tuple[int, ...]
    bits: int

    def margin(self, features: np.ndarray) -> float:
        r = self.ratio[features]
        return float(self.weights[features].sum() / max(np.sqrt((r * r).sum()), 1e-9) + self.bias)

    def score(self, features: np.ndarray) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.slope * self.margin(features) + self.shift, -40, 40))))


def log_count_ratio(df: np.ndarray, alpha: float) -> np.ndarray:
    """ln of the features' shares under label 1 over those under label 0."""
    p, q = df[1] + alpha, df[0] + alpha
    return np.log((p / p.sum()) / (q / q.sum())) * (df.sum(0) > 0)


def dual_coordinate_descent(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, size: int, cost: np.ndarray, epochs: int, seed: int) -> np.ndarray:
    """w of min |w|**2 / 2 + sum of cost * hinge: one dual variable at a time, in a seeded order. The last place is the bias."""
    w, a = np.zeros(size + 1), np.zeros(len(rows))
    q = np.array([(v * v).sum() + 1 for _, v in rows])
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        most = 0.0
        for i in rng.permutation(len(rows)):
            k, v = rows[i]
            g = y[i] * (v @ w[k] + w[-1]) - 1
            new = min(max(a[i] - g / q[i], 0.0), cost[i])
            if step := new - a[i]:
                w[k] += step * y[i] * v
                w[-1] += step * y[i]
                a[i] = new
                most = max(most, abs(step))
        if most < 1e-4:
            break
    return w


def platt(m: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """slope, shift of the logistic curve with smoothed targets, by Newton's method."""
    t = np.where(y > 0, ((y > 0).sum() + 1) / ((y > 0).sum() + 2), 1 / ((y <= 0).sum() + 2))
    x = np.stack([m, np.ones_like(m)], 1)
    b = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -40, 40)))
        h = (x * (p * (1 - p))[:, None]).T @ x + 1e-6 * np.eye(2)
        step = np.linalg.solve(h, x.T @ (t - p))
        b += np.clip(step, -5, 5)
        if abs(step).max() < 1e-8:
            break
    return float(b[0]), float(b[1])


def learn(docs: DataFrame, labels: DataFrame, params: Params = Params(), label_col: str = "quality") -> Model | float:
    """A model from the rows of docs that may be learned from, or the score of all rows if it takes both labels."""
    named = labels.select("doc_id", F.col(label_col).alias("y")).filter("doc_id IS NOT NULL AND y IN (0, 1)").groupBy("doc_id").agg(F.min("y").alias("y"), F.max("y").alias("z")).filter("y = z").drop("z").filter(learn_row(F.col("doc_id"))).select("doc_id", F.col("y").cast("int").alias("y"))
    if named.count() <= LABEL_ROWS:
        named = F.broadcast(named)
    rows = docs.select("doc_id", "text").filter(learn_row(F.col("doc_id"))).join(named, "doc_id")
    n, df = ng.document_frequencies(rows, "y", "text", ng.byte_rows, params.orders, params.bits, 2)
    if not n.all():
        return float(n[1] / n.sum()) if n.sum() else 0.5
    ratio = log_count_ratio(df, params.alpha)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [ng.indicators(r, params.orders, params.bits).astype(np.int32).tobytes() for r in ng.byte_rows(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("y"), pa.array(own, pa.binary())], ["doc_id", "y", "f"])

    sample = ng.bounded_sample(rows, "y", params.per_class, "doc_id", {c: int(n[c]) for c in (0, 1)})
    got = in_arrow(sample, features, "doc_id long, y int, f binary").toPandas().sort_values(["doc_id", "y", "f"]).reset_index(drop=True)
    if got.y.nunique() < 2:
        return float(n[1] / n.sum())
    x = []
    for f in got.f:
        k = np.frombuffer(f, np.int32)
        x.append((k, ratio[k] / max(np.sqrt((ratio[k] ** 2).sum()), 1e-9)))
    y = np.where(got.y.to_numpy() > 0, 1, -1)
    mine = np.arange(len(y)) % 5 != 0
    # Both labels weigh alike, as in their sample.
    cost = params.cost * len(y) / (2 * np.where(y > 0, (y > 0).sum(), (y < 0).sum()))
    part = lambda keep: dual_coordinate_descent([r for r, k in zip(x, keep, strict=True) if k], y[keep], len(ratio), cost[keep], params.epochs, params.seed)

    def model(w: np.ndarray, slope: float = 1.0, shift: float = 0.0) -> Model:
        v = w[:-1]
        v = (1 - params.beta) * np.abs(v).mean() + params.beta * v
        return Model((v * ratio).astype(np.float32), ratio.astype(np.float32), float(w[-1]), slope, shift, params.orders, params.bits)

    first = model(part(mine))
    margins = np.array([first.margin(k) for (k, _), m in zip(x, mine, strict=True) if not m])
    # Platt's curve for the shares that the labels have outside the sample.
    slope, shift = platt(margins, y[~mine])
    prior = np.log(n[1] / n[0]) - np.log((y > 0).sum() / (y < 0).sum())
    return model(part(np.ones(len(y), bool)), slope, float(shift + prior))


def score(docs: DataFrame, model: Model | float, text_col: str = "text") -> DataFrame:
    """docs with `score` in place of the text."""
    keep = [c for c in docs.columns if c not in (text_col, "score")]
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for batch in batches:
            if isinstance(m, float):
                s = [m] * len(batch)
            else:
                s = [m.score(ng.indicators(r, m.orders, m.bits)) for r in ng.byte_rows(batch.column(text_col))]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(s, pa.float64())], [*keep, "score"])

    sent_cols = docs.select(*keep, text_col)
    return in_arrow(sent_cols, run, docs.select(*keep).withColumn("score", F.lit(0.0)).schema)
