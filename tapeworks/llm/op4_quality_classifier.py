"""Quality classifier: positive-unlabelled learning with a non-negative risk.

Trusted positives are the labelled good documents outside the held-out fold; the unlabelled set is a sample of
all documents outside it, whose labels are not looked at. A small network over document statistics minimises
``prior * R+(positives) + max(0, R-(unlabelled) - prior * R-(positives))``. The class prior is estimated from
the two samples alone: a set that holds a share ``a`` of the positives and ``b`` of the unlabelled bounds it by
``b / a``, and a low quantile of such bounds over the sets "score above t" is taken.

Only ``max_rows`` documents of either kind are fetched for the fit; scoring is one pass over all documents without
a shuffle. Null and empty texts get the score of a text without words. Rows are kept one to one. Without
positives every score is 0.5.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeworks.llm.docstats import SHARES, map_stats, matrix, sample_by_hash
from tapeworks.llm.shared import fold, fresh, table, training_labels
from tapeworks.session import staged


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


@dataclass
class Network:
    """One hidden layer over standardised and clipped statistics."""

    names: list[str]
    mean: np.ndarray
    scale: np.ndarray
    hidden: np.ndarray
    bias: np.ndarray
    out: np.ndarray
    shift: float = 0.0

    def inputs(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -6, 6)

    def margin(self, x: np.ndarray) -> np.ndarray:
        z = np.tanh(self.inputs(x) @ self.hidden + self.bias)
        return z @ self.out[:-1] + self.out[-1] + self.shift

    def score(self, x: np.ndarray) -> np.ndarray:
        return _sigmoid(self.margin(x))


def _train(network: Network, parts: list[tuple[np.ndarray, object]], steps: int, rate: float = 0.02) -> None:
    """Adam on full batches; ``parts`` are inputs and functions from margins to their gradients, called together."""
    names, state = ("hidden", "bias", "out"), {}
    for step in range(1, steps + 1):
        layers = [np.tanh(x @ network.hidden + network.bias) for x, _ in parts]
        margins = [z @ network.out[:-1] + network.out[-1] for z in layers]
        grads = {name: np.zeros_like(getattr(network, name)) for name in names}
        for (x, slope), z in zip(parts, layers, strict=True):
            g = slope(margins)
            grads["out"][:-1] += z.T @ g
            grads["out"][-1] += g.sum()
            back = np.outer(g, network.out[:-1]) * (1 - z * z)
            grads["hidden"] += x.T @ back
            grads["bias"] += back.sum(axis=0)
        for name in names:
            m, v = state.get(name, (0.0, 0.0))
            g = grads[name] + (1e-4 * getattr(network, name) if name == "hidden" else 0)
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            state[name] = m, v
            change = rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
            setattr(network, name, getattr(network, name) - change)


def _new(x: np.ndarray, names: list[str], width: int) -> Network:
    rng = np.random.default_rng(5)
    low, high = np.quantile(x, [0.02, 0.98], axis=0)
    scale = np.maximum(x.std(axis=0), 1e-3)
    return Network(
        names, (low + high) / 2, scale, rng.normal(0, 0.4, (x.shape[1], width)), np.zeros(width),
        rng.normal(0, 0.1, width + 1),
    )


def estimate_prior(positive: np.ndarray, unlabelled: np.ndarray, names: list[str], width: int = 12) -> float:
    """Upper bound of the share of positives among the unlabelled, from a classifier of one against the other.

    Scores of rows outside the fit are compared (two folds), over sets that hold at least a tenth of the positives;
    the tenth part of the bounds instead of the least keeps small sets from winning by chance.
    """
    bounds = []
    for odd in (0, 1):
        fit_p, fit_u = positive[odd::2], unlabelled[odd::2]
        network = _new(np.vstack([fit_p, fit_u]), names, width)
        n_p, n_u = max(len(fit_p), 1), max(len(fit_u), 1)
        _train(network, [
            (network.inputs(fit_p), lambda m: (_sigmoid(m[0]) - 1) / (2 * n_p)),
            (network.inputs(fit_u), lambda m: _sigmoid(m[1]) / (2 * n_u)),
        ], 150)
        s_p, s_u = network.margin(positive[1 - odd :: 2]), network.margin(unlabelled[1 - odd :: 2])
        for t in np.quantile(s_p, np.linspace(0, 0.9, 91)) if len(s_p) and len(s_u) else ():
            a, b = (s_p >= t).mean(), (s_u >= t).mean()
            bounds.append(b / max(a, 1e-3))
    return float(np.clip(np.quantile(bounds, 0.1) if bounds else 0.5, 0.05, 0.97))


def fit_network(
    positive: np.ndarray, unlabelled: np.ndarray, names: list[str], prior: float, width: int = 16, steps: int = 400,
) -> Network:
    """Minimise the non-negative risk under the logistic loss."""
    network = _new(np.vstack([positive, unlabelled]), names, width)
    n_p, n_u = len(positive), len(unlabelled)

    def losses(m):
        return np.logaddexp(0, m[1]).mean(), prior * np.logaddexp(0, m[0]).mean()

    def negative_sign(m):
        unl, pos = losses(m)
        return 1.0 if unl >= pos else -1.0

    def slope_positive(m):
        sign = negative_sign(m)
        p = _sigmoid(m[0])
        # below zero only the negative part is walked back up, as the non-negative estimator asks
        return prior * ((p - 1) * (sign > 0) - sign * p) / n_p

    def slope_unlabelled(m):
        return negative_sign(m) * _sigmoid(m[1]) / n_u

    _train(network, [(network.inputs(positive), slope_positive), (network.inputs(unlabelled), slope_unlabelled)], steps)
    return network


def fit_quality(
    docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality",
    max_rows: int = 20_000,
) -> Network | None:
    """Fit on at most ``max_rows`` trusted positives and as many unlabelled documents.

    Documents of one id, however many, are cut to ``max_rows`` different rows of each kind before any are fetched.
    """
    known = training_labels(labels, doc_id, label).where("label = 1")
    positives = sample_by_hash(known, ["_id"], max_rows).select("_id", F.lit(1).alias("_kind"))
    everyone = docs.where(fold(doc_id) != 1).select(F.col(doc_id).alias("_id"))
    unlabelled = sample_by_hash(everyone, ["_id"], max_rows, seed=29).select("_id", F.lit(0).alias("_kind"))
    chosen = positives.unionByName(unlabelled)
    texts = docs.select(F.col(doc_id).alias("_id"), F.col(text).alias("_text")).join(F.broadcast(chosen), "_id")
    schema = ", ".join(f"{name} double" for name in SHARES)
    found = map_stats(texts, "_text", ["_id", "_kind"], schema, lambda stats: {n: stats[n] for n in SHARES})
    found = staged(found, "sample-stats")
    kinds = [sample_by_hash(found.where(F.col("_kind") == kind), found.columns, max_rows) for kind in (0, 1)]
    rows = kinds[0].unionByName(kinds[1]).toPandas()
    x, kind = rows[SHARES].to_numpy(), rows["_kind"].to_numpy()
    order = np.lexsort(x.T)
    x, kind = x[order], kind[order]
    positive, unlabelled_x = x[kind == 1], x[kind == 0]
    if not len(positive) or not len(unlabelled_x):
        return None
    return fit_network(positive, unlabelled_x, SHARES, estimate_prior(positive, unlabelled_x, SHARES))


def score_quality(docs: DataFrame, network: Network | None, keep: list[str], text: str = "text") -> DataFrame:
    """The columns ``keep`` with ``score`` (0 to 1) and ``predicted`` (1 from 0.5 on)."""

    def build(stats):
        n = len(stats["n_words"])
        score = np.full(n, 0.5) if network is None else network.score(matrix(stats, network.names))
        return {"score": score, "predicted": (score >= 0.5).astype(np.int32)}

    return map_stats(docs, text, keep, "score double, predicted int", build)


def keep_good(docs: DataFrame, network: Network | None, text: str = "text") -> DataFrame:
    """The documents that are not rejected, with their own columns."""
    score, predicted = fresh(docs, "score"), fresh(docs, "predicted")

    def build(stats):
        n = len(stats["n_words"])
        s = np.full(n, 0.5) if network is None else network.score(matrix(stats, network.names))
        return {score: s, predicted: (s >= 0.5).astype(np.int32)}

    scored = map_stats(docs, text, docs.columns, f"`{score}` double, `{predicted}` int", build)
    return scored.where(F.col(predicted) == 1).select(*[F.col(f"`{c}`") for c in docs.columns])


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    network = fit_quality(docs, table(spark, sf_dir, "labels"))
    scored = score_quality(docs, network, ["doc_id"])
    return scored.select("doc_id", (fold("doc_id") == 1).alias("held_out"), "score", "predicted")
