"""Next-step price models per symbol by least squares.

Everything a fit needs is a set of sums, so the work is aggregation: rows are reduced to sums where
they are, and only the sums of a symbol meet.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapeworks.functions.scaling import minmax, minmax_back
from tapeworks.operators.joins import lookup
from tapeworks.operators.series import DAY, SYMBOL, by_day, by_symbol, chrono_split, latest, newer_than
from tapeworks.schemas import FEATURES

PRICE = "last_price"
MODEL = "LAG1"
FLUSH_KEYS = 5_000
STATE = ["n", "sx", "sy", "sxx", "sxy"]

#: Added to the variances of scaled regressors: far below any that matters, and above rounding.
RIDGE = 1e-9

# One lag: price of the next row from the price of this row


def price_pairs(series: DataFrame, price: str = PRICE) -> DataFrame:
    """Consecutive prices ``x`` then ``y`` of every symbol, raw and with the bounds ``lo`` and ``hi``."""
    rows = series.select(
        SYMBOL,
        DAY,
        F.col(price).alias("x"),
        F.lead(price).over(by_day()).alias("y"),
        F.lead(DAY).over(by_day()).alias("label_date"),
        F.min(price).over(by_symbol()).alias("lo"),
        F.max(price).over(by_symbol()).alias("hi"),
    )
    return rows.where("label_date is not null")


def scaled_pairs(pairs: DataFrame) -> DataFrame:
    lo, hi = F.col("lo"), F.col("hi")
    return pairs.withColumns({"sx": minmax(F.col("x"), lo, hi), "sy": minmax(F.col("y"), lo, hi)})


def fit_lag1(pairs: DataFrame) -> DataFrame:
    """Slope and intercept between scaled prices, with the bounds the scale was made from."""
    return scaled_pairs(pairs).groupBy(SYMBOL).agg(
        F.count("*").alias("n"),
        F.regr_slope("sy", "sx").alias("slope"),
        F.regr_intercept("sy", "sx").alias("intercept"),
        F.max("lo").alias("lo"),
        F.max("hi").alias("hi"),
    )


def _predicted(x):
    lo, hi = F.col("lo"), F.col("hi")
    return minmax_back(F.col("intercept") + F.col("slope") * minmax(x, lo, hi), lo, hi)


def predict_next(models: DataFrame, series: DataFrame, price: str = PRICE) -> DataFrame:
    """The price expected after the latest row of every modelled symbol."""
    last = latest(series.select(SYMBOL, DAY, price))
    scored = last.join(models, SYMBOL)
    return scored.select(SYMBOL, DAY, price, _predicted(F.col(price)).alias("predicted_price"))


def with_fit(pairs: DataFrame, used: Column) -> DataFrame:
    """Pairs with the slope and intercept fitted to those of their symbol that are ``used``.

    The fit is a window over the pairs, which are partitioned by symbol already; nothing is joined.
    """
    ready = scaled_pairs(pairs)
    x, y = F.when(used, F.col("sx")), F.when(used, F.col("sy"))
    fits = {"slope": F.regr_slope(y, x).over(by_symbol()), "intercept": F.regr_intercept(y, x).over(by_symbol())}
    return ready.withColumns(fits)


def backtest(series: DataFrame, share: float = 0.8) -> DataFrame:
    """Predictions for every pair by a model fitted to the first ``share`` of the pairs."""
    pairs = chrono_split(price_pairs(series), DAY, share)
    return with_fit(pairs, F.col("is_train")).withColumn("predicted", _predicted(F.col("x")))


def error_metrics(scored: DataFrame, actual: str = "y", predicted: str = "predicted") -> DataFrame:
    """MSE, MAE and R² per symbol; NULL where there is nothing to compare."""
    y, error = F.col(actual), F.col(actual) - F.col(predicted)
    sums = scored.groupBy(SYMBOL).agg(
        F.count(error).alias("test_rows"),
        F.avg(error * error).alias("mse"),
        F.avg(F.abs(error)).alias("mae"),
        F.sum(error * error).alias("_left"),
        F.var_pop(F.when(error.isNotNull(), y)).alias("_variance"),
    )
    total = F.col("_variance") * F.col("test_rows")
    r2 = 1 - F.col("_left") / F.nullif(total, F.lit(0.0))
    return sums.select(SYMBOL, "test_rows", "mse", "mae", r2.alias("r2"))


def evaluate(series: DataFrame, share: float = 0.8) -> DataFrame:
    """Hold-out metrics in price units for every symbol with a pair, test rows or not."""
    scored = backtest(series, share)
    held_out = scored.withColumn("predicted", F.when(~F.col("is_train"), F.col("predicted")))
    return error_metrics(held_out)


def actual_vs_predicted(series: DataFrame) -> DataFrame:
    """The price of every row after the first beside its prediction; the last row is marked."""
    scored = with_fit(price_pairs(series), F.lit(True))
    is_last = F.col("label_date") == F.max("label_date").over(by_symbol())
    return scored.select(
        SYMBOL,
        F.col("label_date").alias(DAY),
        F.col("y").alias("actual"),
        _predicted(F.col("x")).alias("predicted"),
        is_last.alias("is_last"),
    )


# Incremental training: the model is kept as sums, so new rows add to it


def pair_sums(series: DataFrame, price: str = PRICE) -> DataFrame:
    """Training state of a series: sums over its consecutive prices, bounds, and the last day with its price."""
    pairs = series.select(SYMBOL, DAY, F.col(price).alias("x"), F.lead(price).over(by_day()).alias("y"))
    have = F.col("y").isNotNull()
    x, y = F.when(have, F.col("x")), F.col("y")
    return pairs.groupBy(SYMBOL).agg(
        F.count("y").alias("n"),
        F.coalesce(F.sum(x), F.lit(0.0)).alias("sx"),
        F.coalesce(F.sum(y), F.lit(0.0)).alias("sy"),
        F.coalesce(F.sum(x * x), F.lit(0.0)).alias("sxx"),
        F.coalesce(F.sum(x * y), F.lit(0.0)).alias("sxy"),
        F.min("x").alias("lo"),
        F.max("x").alias("hi"),
        F.max(DAY).alias("last_train_date"),
        F.max_by("x", DAY).alias("last_x"),
    )


def merge_states(old: DataFrame, new: DataFrame) -> DataFrame:
    """Add new sums to the stored ones; symbols in only one of them keep what they have."""
    return old.unionByName(new).groupBy(SYMBOL).agg(
        *[F.sum(c).alias(c) for c in STATE],
        F.min("lo").alias("lo"),
        F.max("hi").alias("hi"),
        F.max("last_train_date").alias("last_train_date"),
        F.max_by("last_x", "last_train_date").alias("last_x"),
    )


def new_sums(series: DataFrame, state: DataFrame, price: str = PRICE) -> DataFrame:
    """Sums over the rows after each symbol's mark, the pair that crosses the mark included.

    The state keeps the last price before the mark, which the first new price follows. Symbols without
    new rows have no sums.
    """
    fresh = newer_than(series, state).select(SYMBOL, DAY, price)
    before = state.select(SYMBOL, F.col("last_train_date").alias(DAY), F.col("last_x").alias(price))
    before = before.join(fresh.select(SYMBOL).distinct(), SYMBOL, "left_semi")
    return pair_sums(before.unionByName(fresh), price)


def incremental_fit(series: DataFrame, state: DataFrame) -> DataFrame:
    """The stored state after training on the rows that came after each symbol's mark: training in steps
    gives the sums of training at once."""
    return merge_states(state, new_sums(series, state))


def line_of(state: DataFrame) -> DataFrame:
    """Slope and intercept in price units from a training state."""
    n, sx, sy, sxx, sxy = [F.col(c) for c in STATE]
    spread = F.nullif(n * sxx - sx * sx, F.lit(0.0))
    fitted = state.withColumn("slope", (n * sxy - sx * sy) / spread)
    return fitted.withColumn("intercept", (sy - F.col("slope") * sx) / F.nullif(n, F.lit(0)))


def predict_line(lines: DataFrame, series: DataFrame, price: str = PRICE) -> DataFrame:
    """The price expected after the latest row of every symbol with a fitted line."""
    last = latest(series.select(SYMBOL, DAY, price))
    fitted = lines.where("slope is not null").select(SYMBOL, "slope", "intercept")
    expected = F.col("intercept") + F.col("slope") * F.col(price)
    return last.join(fitted, SYMBOL).select(SYMBOL, DAY, price, expected.alias("predicted_price"))


# Result tables


def target_rows(predictions: DataFrame) -> DataFrame:
    return predictions.select(SYMBOL, DAY, F.round("predicted_price", 2).alias("target_next_day_price"))


def model_name():
    return F.concat(F.lit(f"{MODEL}_"), F.col(SYMBOL))


def prediction_rows(predictions: DataFrame) -> DataFrame:
    return predictions.select(
        SYMBOL,
        DAY,
        F.round(PRICE, 2).alias(PRICE),
        F.round("predicted_price", 6).alias("predicted_next_day_price"),
        model_name().alias("model_name"),
        F.lit(MODEL).alias("model_type"),
    )


def model_rows(state: DataFrame, metrics: DataFrame) -> DataFrame:
    """One row per symbol of a training state: name, mark, hold-out metrics, and the line in price units."""
    return line_of(state).join(metrics, SYMBOL, "left").select(
        SYMBOL,
        model_name().alias("model_name"),
        F.lit(MODEL).alias("model_type"),
        F.concat(F.lit("models/"), model_name()).alias("model_path"),
        "last_train_date", "mse", "mae", "r2", "lo", "hi", "slope", "intercept",
    )


# Many lags and features


def _regressors(features: Sequence[str]) -> Column:
    """All features of all steps as one array, the oldest step first."""
    return F.flatten(F.transform("steps", lambda s: F.array(*[s[c].cast("double") for c in features])))


def fit_products(
    sequences: DataFrame, features: Sequence[str] = FEATURES, key: str = SYMBOL
) -> DataFrame:
    """Sums per key of the products of (1, regressors, label): ``key, row, column, total``, upper triangle only.

    Each task reduces its rows to one triangle per key; Spark adds the cells up. Rows with a missing value
    are left out.
    """
    rows = sequences.where("label is not null").select(
        F.col(key).cast("string").alias("_key"), _regressors(features).alias("_x"), F.col("label").cast("double").alias("_y")
    )
    sums = rows.mapInPandas(_partial_products, "_key string, _width int, _products array<double>")
    cells = sums.select("_key", "_width", F.posexplode("_products").alias("_at", "_product"))
    added = cells.groupBy("_key", "_width", "_at").agg(F.sum("_product").alias("total"))
    return added.select(F.col("_key").alias(key), F.col("_width").alias("width"), F.col("_at").alias("at"), "total")


def fit_sequences(
    sequences: DataFrame, length: int, features: Sequence[str] = FEATURES, key: str = SYMBOL
) -> DataFrame:
    """Least squares of ``label`` on all features of all ``steps``, one model per key.

    Features should be scaled alike (to [0, 1], say). The covariances of the regressors get ``RIDGE`` on their
    diagonal: a regressor that does not vary gets no weight, and regressors that repeat one another share
    theirs, so that every key has one solution.
    """
    width = length * len(features) + 2  # constant, regressors, label
    cells = fit_products(sequences, features, key).groupBy(F.col(key).alias("_key")).agg(
        F.sort_array(F.collect_list(F.struct("at", "total"))).alias("_cells")
    )
    added = cells.select("_key", F.transform("_cells", lambda c: c["total"]).alias("_products"))

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame([_solve(k, p, width) for k, p in zip(batch["_key"], batch["_products"])],
                               columns=["_key", "n", "intercept", "weights", "train_mse"])

    solved = added.mapInPandas(solve, "_key string, n bigint, intercept double, weights array<double>, train_mse double")
    return solved.withColumnRenamed("_key", key)


def _partial_products(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Sums of products of (1, x, y) per key; emitted when many keys are held, and at the end."""
    held: dict[str, np.ndarray] = {}

    def emit() -> pd.DataFrame:
        width = len(next(iter(held.values())))
        upper = np.triu_indices(width)
        out = pd.DataFrame({"_key": list(held), "_width": width, "_products": [m[upper] for m in held.values()]})
        held.clear()
        return out

    for batch in batches:
        for key, part in batch.groupby("_key", sort=False):
            x = np.vstack(part["_x"].to_numpy())
            full = np.column_stack([np.ones(len(part)), x, part["_y"].to_numpy()])
            full = full[np.isfinite(full).all(axis=1)]
            product = full.T @ full
            held[key] = held[key] + product if key in held else product
        if len(held) >= FLUSH_KEYS:
            yield emit()
    if held:
        yield emit()


def _solve(key: str, products: np.ndarray, width: int) -> tuple:
    moments = np.zeros((width, width))
    moments[np.triu_indices(width)] = products
    n = moments[0, 0]
    if n == 0:
        return key, 0, None, None, None
    means = moments[0, 1:] / n
    upper = moments[1:, 1:] / n - np.outer(means, means)
    covariance = np.triu(upper) + np.triu(upper, 1).T
    left, right = covariance[:-1, :-1], covariance[:-1, -1]
    weights = np.linalg.solve(left + RIDGE * np.eye(len(left)), right)
    error = covariance[-1, -1] - 2 * weights @ right + weights @ left @ weights
    return key, int(n), float(means[-1] - weights @ means[:-1]), weights.tolist(), float(max(error, 0.0))


def score_sequences(models: DataFrame, scoring: DataFrame, features: Sequence[str] = FEATURES) -> DataFrame:
    """The scaled price each fitted model expects after the scoring sequence of its symbol."""
    terms = F.zip_with("weights", _regressors(features), lambda w, x: w * x)
    value = F.aggregate(terms, F.col("intercept"), lambda total, term: total + term)
    return scoring.join(models, SYMBOL).select(SYMBOL, DAY, value.alias("predicted_scaled"))
