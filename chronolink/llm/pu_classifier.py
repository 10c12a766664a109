"""Quality classifier by positive-unlabelled learning with a non-negative risk.

Trusted positives are rows labelled good; everything else of the learning part
counts as unlabelled, whatever its label says. A network with one hidden layer
over whole-text statistics minimises the non-negative unbiased risk
prior * E_P[loss(+)] + max(0, E_U[loss(-)] - prior * E_P[loss(-)]); where the
second part turns negative, its gradient is reversed. The class prior among the
unlabelled is estimated by the best bin: over thresholds of a classifier of
positives against unlabelled, the smallest ratio of the unlabelled to the
positive share above it, with a confidence margin.

The learner sees samples of bounded size (sample_rows of each kind, drawn by a
hash of the id); statistics and scores cover all whole texts.

Defined results: null and empty texts have all statistics 0 and are scored like
others; with no positive or no unlabelled row every score is 0.5; labels that
are null are no labels; rows with a null id are never held out; repeated rows
are scored alike; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronolink.llm.common import remainder, store
from chronolink.llm.quality_rules import FEATURES
from chronolink.llm.text_stats import with_statistics


@dataclass
class Scaler:
    """Each statistic twice: its place among the sample's quantiles, and its standardised logarithm."""

    knots: list[np.ndarray]
    mean: np.ndarray
    spread: np.ndarray

    @staticmethod
    def fit(x: np.ndarray, cuts: int = 64) -> Scaler:
        knots = [np.unique(np.quantile(c, np.linspace(0, 1, cuts))) for c in x.T]
        logs = np.log1p(1000 * np.maximum(x, 0))
        return Scaler(knots, logs.mean(0), logs.std(0) + 1e-9)

    def apply(self, x: np.ndarray) -> np.ndarray:
        places = [np.interp(c, k, np.linspace(-1, 1, len(k))) if len(k) > 1 else np.zeros(len(c)) for c, k in zip(x.T, self.knots)]
        logs = (np.log1p(1000 * np.maximum(x, 0)) - self.mean) / self.spread
        return np.concatenate([np.stack(places, 1), np.clip(logs, -8, 8)], 1)


@dataclass
class Network:
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: np.ndarray

    @staticmethod
    def fresh(width: int, hidden: int, seed: int) -> Network:
        rng = np.random.default_rng(seed)
        return Network(rng.normal(0, width**-0.5, (width, hidden)), np.zeros(hidden), rng.normal(0, hidden**-0.5, hidden), np.zeros(1))

    def forward(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        h = np.tanh(x @ self.w1 + self.b1)
        return h, h @ self.w2 + self.b2[0]

    def gradient(self, x: np.ndarray, h: np.ndarray, d: np.ndarray) -> list[np.ndarray]:
        dh = np.outer(d, self.w2) * (1 - h * h)
        return [x.T @ dh, dh.sum(0), h.T @ d, np.array([d.sum()])]


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def fit_network(positive: np.ndarray, unlabelled: np.ndarray, prior: float | None, hidden: int = 24, epochs: int = 40, rate: float = 3e-3, batch: int = 512, seed: int = 0) -> Network:
    """Minimises the non-negative risk at the prior; with None, plainly separates positives from unlabelled."""
    net = Network.fresh(positive.shape[1], hidden, seed)
    rng = np.random.default_rng(seed)
    params = [net.w1, net.b1, net.w2, net.b2]
    m, v = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    step, size = 0, max(len(positive), len(unlabelled))
    for _ in range(epochs):
        p_order = rng.permutation(np.resize(np.arange(len(positive)), size))
        u_order = rng.permutation(np.resize(np.arange(len(unlabelled)), size))
        for at in range(0, size, batch):
            xp, xu = positive[p_order[at : at + batch]], unlabelled[u_order[at : at + batch]]
            hp, gp = net.forward(xp)
            hu, gu = net.forward(xu)
            up, uu = _sigmoid(gp), _sigmoid(gu)  # derivatives of log(1 + e^g); minus 1 for the positive loss
            if prior is None:
                dp, du = (up - 1) / len(gp), uu / len(gu)
            else:
                negative = np.logaddexp(0, gu).mean() - prior * np.logaddexp(0, gp).mean()
                if negative >= 0:
                    dp, du = (prior * (up - 1) - prior * up) / len(gp), uu / len(gu)
                else:
                    dp, du = prior * up / len(gp), -uu / len(gu)
            grads = [a + b + 1e-4 * p for a, b, p in zip(net.gradient(xp, hp, dp), net.gradient(xu, hu, du), params)]
            step += 1
            for p, g, mi, vi in zip(params, grads, m, v):
                mi += 0.1 * (g - mi)
                vi += 0.001 * (g * g - vi)
                p -= rate * (mi / (1 - 0.9**step)) / (np.sqrt(vi / (1 - 0.999**step)) + 1e-8)
    return net


def estimate_prior(positive_scores: np.ndarray, unlabelled_scores: np.ndarray, confidence: float = 0.1) -> float:
    """The best bin's estimate of the share of positives among the unlabelled."""
    cuts = np.unique(positive_scores)
    above_p = 1 - np.searchsorted(np.sort(positive_scores), cuts) / len(positive_scores)
    above_u = 1 - np.searchsorted(np.sort(unlabelled_scores), cuts) / len(unlabelled_scores)
    margin = np.sqrt(np.log(4 / confidence) / 2) * (len(positive_scores) ** -0.5 + len(unlabelled_scores) ** -0.5)
    best = np.argmin((above_u + margin) / above_p)
    return float(np.clip(above_u[best] / above_p[best], 0.01, 0.99))


@dataclass
class Model:
    scaler: Scaler
    network: Network
    prior: float

    def score(self, x: np.ndarray) -> np.ndarray:
        return _sigmoid(self.network.forward(self.scaler.apply(x))[1])


def fit(positive: np.ndarray, unlabelled: np.ndarray, seed: int = 0) -> Model | None:
    """The model for two samples of statistics; None if either is empty."""
    if not len(positive) or not len(unlabelled):
        return None
    scaler = Scaler.fit(np.concatenate([positive, unlabelled]))
    p, u = scaler.apply(positive), scaler.apply(unlabelled)
    half_p, half_u = max(1, len(p) // 2), max(1, len(u) // 2)
    plain = fit_network(p[:half_p], u[:half_u], None, epochs=15, seed=seed)
    rest_p, rest_u = (p[half_p:], u[half_u:]) if len(p) > half_p and len(u) > half_u else (p, u)
    prior = estimate_prior(plain.forward(rest_p)[1], plain.forward(rest_u)[1])
    return Model(scaler, fit_network(p, u, prior, seed=seed + 1), prior)


def learn(stats: DataFrame, labels: DataFrame, sample_rows: int = 20_000) -> Model | None:
    """Learns from stats' rows (doc_id and the statistics); labels: doc_id, quality of the rows that may teach."""
    good = labels.where(F.col("quality") == 1).select("doc_id").distinct().withColumn("good", F.lit(True))
    values = stats.join(good, "doc_id", "left").select(F.coalesce("good", F.lit(False)).alias("good"), F.xxhash64("doc_id").alias("draw"), *[F.expr(e).alias(f) for f, e in FEATURES.items()])
    found = []
    for kind in (F.col("good"), ~F.col("good")):
        rows = values.where(kind).orderBy("draw").limit(sample_rows).select(*FEATURES).toArrow()
        found.append(np.stack([rows[f].to_numpy() for f in FEATURES], 1).astype(float) if rows.num_rows else np.zeros((0, len(FEATURES))))
    return fit(*found)


def score_documents(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", sample_rows: int = 20_000, threshold: float = 0.7) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of docs; labels of held-out rows are not used."""
    spark = docs.sparkSession
    stats = store(with_statistics(docs.withColumnRenamed(key, "doc_id"), text), "pu-stats")
    held = F.coalesce(remainder(F.col("doc_id"), 4) == 2, F.lit(False))
    model = learn(stats.where(~held), labels.where(~held), sample_rows)
    shared = spark.sparkContext.broadcast(model)  # a few KB
    key_type = stats.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            x = np.stack([batch.column(2 + i).to_numpy() for i in range(len(FEATURES))], 1).astype(float)
            score = np.full(len(x), 0.5) if shared.value is None else shared.value.score(x)
            columns = [batch.column(0), batch.column(1), pa.array(score), pa.array((score >= threshold).astype(np.int32))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "held_out", "score", "predicted"])

    values = stats.select("doc_id", held.alias("held_out"), *[F.expr(e).alias(f) for f, e in FEATURES.items()])
    return values.mapInArrow(run, f"doc_id {key_type}, held_out boolean, score double, predicted int")
