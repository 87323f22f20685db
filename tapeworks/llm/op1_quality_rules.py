"""Quality rules: gradient-boosted trees over document statistics.

Trees are grown with histograms of quantile bins under monotonic constraints, flattened into node arrays and
applied to whole batches of documents at once. Only a bounded sample of labelled rows is fetched for the
fit (``max_rows``); scoring is one pass over all documents without a shuffle.

Null or empty texts have all counts 0 and fail the base rules. Rows are kept one to one, whatever ids they
have. Without labels of both kinds the base rules alone decide.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeworks.llm.docstats import COUNTS, SHARES, map_stats, matrix, sample_by_hash
from tapeworks.llm.shared import table, training_labels
from tapeworks.session import staged

#: +1: more is never worse, -1: more is never better. Others are free.
MONOTONE = {
    "symbols_per_word": -1, "dup_line_share": -1, "echo_share": -1, "upper_share": -1, "mark_share": -1,
    "odd_share": -1, "distinct_share": 1,
}


@dataclass
class Trees:
    """A boosted ensemble as arrays of shape (trees, nodes); a leaf is its own child."""

    names: list[str]
    base: float
    feature: np.ndarray = field(repr=False)
    threshold: np.ndarray = field(repr=False)
    left: np.ndarray = field(repr=False)
    right: np.ndarray = field(repr=False)
    value: np.ndarray = field(repr=False)
    depth: int = 3

    def margin(self, x: np.ndarray) -> np.ndarray:
        total, rows = np.full(len(x), self.base), np.arange(len(x))
        for feature, threshold, left, right, value in zip(
            self.feature, self.threshold, self.left, self.right, self.value, strict=True
        ):
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                node = np.where(x[rows, feature[node]] <= threshold[node], left[node], right[node])
            total += value[node]
        return total


def _best_split(sums: np.ndarray, sign: np.ndarray, low: float, high: float, penalty: float):
    """Best (gain, feature, bin, left value, right value) of histograms (feature, bin, 2), or None."""
    left = np.cumsum(sums, axis=1)[:, :-1]
    total = sums.sum(axis=1, keepdims=True)
    right = total - left

    def value(part):
        return np.clip(-part[..., 0] / (part[..., 1] + penalty), low, high)

    def gain(part, v):
        return -(part[..., 0] * v + 0.5 * (part[..., 1] + penalty) * v * v)

    lv, rv = value(left), value(right)
    gains = gain(left, lv) + gain(right, rv) - gain(total, value(total))
    ordered = sign[:, None] * (rv - lv) >= 0
    gains = np.where(ordered & (left[..., 1] > 1) & (right[..., 1] > 1), gains, -np.inf)
    f, b = np.unravel_index(np.argmax(gains), gains.shape)
    return (gains[f, b], f, b, lv[f, b], rv[f, b]) if gains[f, b] > 1e-6 else None


def fit_trees(
    x: np.ndarray, y: np.ndarray, names: list[str], monotone: dict[str, int], n_trees: int = 60, depth: int = 3,
    rate: float = 0.2, bins: int = 64, penalty: float = 1.0,
) -> Trees:
    """Logistic boosting. Each split keeps both sides within bounds that make constrained features monotonic."""
    cuts = [np.unique(np.quantile(column, np.linspace(0, 1, bins)[1:-1])) for column in x.T]
    binned = np.column_stack([np.searchsorted(c, column, "left") for c, column in zip(cuts, x.T, strict=True)])
    sign = np.array([monotone.get(name, 0) for name in names])
    rate_of = y.mean()
    base = float(np.log(rate_of / (1 - rate_of)))
    margin, nodes, trees = np.full(len(y), base), 2 ** (depth + 1) - 1, []
    columns = np.arange(x.shape[1])
    for _ in range(n_trees):
        p = 1 / (1 + np.exp(-margin))
        grad, hess = p - y, p * (1 - p)
        feature, left = np.zeros(nodes, np.int64), np.arange(nodes)
        threshold, right, value = np.full(nodes, np.inf), np.arange(nodes), np.zeros(nodes)
        bounds, place = {0: (-np.inf, np.inf)}, np.zeros(len(y), np.int64)
        value[0] = -grad.sum() / (hess.sum() + penalty)
        for node in range(2**depth - 1):
            rows = np.flatnonzero(place == node) if node in bounds else ()
            if not len(rows):
                continue
            flat = (binned[rows] + columns * bins).ravel()
            sums = np.stack([
                np.bincount(flat, np.repeat(w[rows], len(columns)), len(columns) * bins) for w in (grad, hess)
            ], axis=1).reshape(len(columns), bins, 2)
            low, high = bounds[node]
            if not (split := _best_split(sums, sign, low, high, penalty)):
                continue
            _, f, b, lv, rv = split
            if b >= len(cuts[f]):
                continue
            feature[node], threshold[node] = f, cuts[f][b]
            left[node], right[node] = 2 * node + 1, 2 * node + 2
            value[2 * node + 1], value[2 * node + 2] = lv, rv
            middle = (lv + rv) / 2
            bounds[2 * node + 1] = (low, middle) if sign[f] > 0 else (middle, high) if sign[f] < 0 else (low, high)
            bounds[2 * node + 2] = (middle, high) if sign[f] > 0 else (low, middle) if sign[f] < 0 else (low, high)
            place[rows] = np.where(binned[rows, f] <= b, 2 * node + 1, 2 * node + 2)
        trees.append((feature, threshold, left, right, rate * value))
        margin += rate * value[place]
    return Trees(names, base, *(np.array(part) for part in zip(*trees, strict=True)), depth=depth)


def fit_quality_trees(
    docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality",
    max_rows: int = 20_000, **options,
) -> Trees | None:
    """Fit on at most ``max_rows`` labelled documents, those with the smallest id hashes.

    Documents of one id, however many, are cut to ``max_rows`` different rows before any are fetched.
    """
    chosen = sample_by_hash(training_labels(labels, doc_id, label), ["_id", "label"], max_rows)
    known = docs.select(F.col(doc_id).alias("_id"), F.col(text).alias("_text")).join(F.broadcast(chosen), "_id")
    schema = ", ".join(f"{name} double" for name in SHARES)
    found = map_stats(known, "_text", ["_id", "label"], schema, lambda stats: {n: stats[n] for n in SHARES})
    rows = sample_by_hash(staged(found, "labelled-stats"), found.columns, max_rows).toPandas()
    if rows["label"].nunique() < 2:
        return None
    rows = rows.sort_values(found.columns)
    return fit_trees(rows[SHARES].to_numpy(), rows["label"].to_numpy(np.float64), SHARES, MONOTONE, **options)


def quality_rules(
    docs: DataFrame, trees: Trees | None, keep: list[str], text: str = "text", min_words: int = 50,
    max_repeat_percent: int = 50, threshold: float = 0.5,
) -> DataFrame:
    """The columns ``keep``, the exact counts, ``base_failed``, the trees' ``tree_score`` and ``kept``."""

    def build(stats):
        n, repeats = stats["n_words"], stats["n_repeat_words"]
        failed = (n < min_words) | (100 * repeats > max_repeat_percent * n)
        if trees is None:
            score = np.where(failed, 0.0, 1.0)
        else:
            score = 1 / (1 + np.exp(-trees.margin(matrix(stats, trees.names))))
        new = {name: stats[name] for name in COUNTS}
        return new | {"base_failed": failed, "kept": ~failed & (score >= threshold), "tree_score": score}

    schema = ", ".join(f"{n} long" for n in COUNTS) + ", base_failed boolean, kept boolean, tree_score double"
    return map_stats(docs, text, keep, schema, build)


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    trees = fit_quality_trees(docs, table(spark, sf_dir, "labels"))
    return quality_rules(docs, trees, ["doc_id"])
