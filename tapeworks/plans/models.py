"""Queries: daily series, sequences, tick sequences and forecasts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeworks.etl import JOBS
from tapeworks.functions.numbers import rounded
from tapeworks.functions.scaling import minmax, minmax_back
from tapeworks.functions.times import clock_key
from tapeworks.operators import forecast, series, ticks
from tapeworks.operators.joins import lookup
from tapeworks.plans import oracle as o
from tapeworks.plans.catalog import query
from tapeworks.plans.inputs import Inputs
from tapeworks.schemas import FEATURES
from tapeworks.session import scratch_path, staged
from tapeworks.sources.stores import ParquetStore

MARK = "1999-06-30"
SERIES_SQL = (o.TRADE, o.SERIES)
DAY = o.day_text("tradingdate") + " AS tradingdate"
BY_DAY = "OVER (PARTITION BY symbol ORDER BY series.tradingdate)"
BY_SYMBOL = "OVER (PARTITION BY symbol)"
ROUNDED = ", ".join(f"round({c}, 4) AS {c}" for c in FEATURES)
MARKED = "symbol::INT % 3 <> 0"  # symbols that have been trained up to the mark


def _shown(rows: DataFrame, *first: str) -> DataFrame:
    return rows.select(*first, *[rounded(F.col(c), 4).alias(c) for c in FEATURES])


def _daily(t: Inputs) -> DataFrame:
    return series.daily_series(t.trades())


def _stored(t: Inputs) -> DataFrame:
    """The series as a stored feature table, for queries that read it more than once."""
    return staged(_daily(t), "feature_data")


def _marks(rows: DataFrame) -> DataFrame:
    """Two symbols of three have been trained up to the mark."""
    trained = rows.where((F.col("symbol").cast("int") % 3 != 0) & (F.col("tradingdate") <= MARK))
    return staged(trained.groupBy("symbol").agg(F.max("tradingdate").alias("last_train_date")), "marks")


# Series


@query("sorted_series", o.with_(*SERIES_SQL) + f"SELECT symbol, {DAY}, {ROUNDED} FROM series ORDER BY symbol, series.tradingdate")
def sorted_series(t: Inputs) -> DataFrame:
    return _shown(_daily(t), "symbol", "tradingdate").orderBy("symbol", "tradingdate")


@query(
    "feature_minmax",
    o.with_(*SERIES_SQL)
    + "SELECT symbol, "
    + ", ".join(f"round(min({c}), 4) AS {c}_min, round(max({c}), 4) AS {c}_max" for c in FEATURES)
    + " FROM series GROUP BY symbol",
)
def feature_minmax(t: Inputs) -> DataFrame:
    bounds = series.feature_bounds(_daily(t))
    return bounds.select("symbol", *[F.round(c, 4).alias(c) for c in bounds.columns if c != "symbol"])


def _scaled_sql(c: str) -> str:
    return (f"round(coalesce(({c} - min({c}) {BY_SYMBOL}) / nullif(max({c}) {BY_SYMBOL} - min({c}) {BY_SYMBOL}, 0), 0), 6)"
            f" AS {c}")


@query(
    "minmax_scale",
    o.with_(*SERIES_SQL) + f"SELECT symbol, {DAY}, {', '.join(map(_scaled_sql, FEATURES))} FROM series",
)
def minmax_scale(t: Inputs) -> DataFrame:
    scaled = series.scaled(_daily(t))
    return scaled.select("symbol", "tradingdate", *[rounded(F.col(c), 6).alias(c) for c in FEATURES])


@query(
    "minmax_inverse",
    o.with_(*SERIES_SQL)
    + f"SELECT symbol, {DAY}, round(last_price, 4) AS last_price, {_scaled_sql('last_price').replace(' AS last_price', ' AS scaled')}"
    " FROM series",
)
def minmax_inverse(t: Inputs) -> DataFrame:
    """Prices scaled, and scaled back."""
    rows = _daily(t).select("symbol", "tradingdate", "last_price")
    low, high = [f("last_price").over(series.by_symbol()) for f in (F.min, F.max)]
    kept = rows.withColumns({"_low": low, "_high": high})
    scaled = series.scaled(kept, ["last_price"])
    back = minmax_back(F.col("last_price"), F.col("_low"), F.col("_high"))
    return scaled.select(
        "symbol", "tradingdate", F.round(back, 4).alias("last_price"), F.round("last_price", 6).alias("scaled")
    )


@query(
    "min_history",
    o.with_(*SERIES_SQL) + f"SELECT symbol, {DAY}, {ROUNDED} FROM series QUALIFY count(*) {BY_SYMBOL} >= 580",
)
def min_history(t: Inputs) -> DataFrame:
    return _shown(series.with_min_history(_daily(t), 580), "symbol", "tradingdate")


@query(
    "newer_than_mark",
    o.with_(*SERIES_SQL)
    + f"""SELECT symbol, {DAY}, {ROUNDED} FROM series WHERE series.tradingdate > coalesce(
  (SELECT max(m.tradingdate) FROM series AS m WHERE m.symbol = series.symbol AND m.tradingdate <= '{MARK}' AND m.{MARKED}),
  DATE '1900-01-01')""",
)
def newer_than_mark(t: Inputs) -> DataFrame:
    daily = _stored(t)
    return _shown(series.newer_than(daily, _marks(daily)), "symbol", "tradingdate")


@query("symbol_count", "SELECT count(DISTINCT l_suppkey) AS symbols FROM lineitem")
def symbol_count(t: Inputs) -> DataFrame:
    return t.trades(dealt_out=False).agg(F.countDistinct(F.trim("symbol")).alias("symbols"))


@query(
    "latest_per_symbol",
    o.with_(*SERIES_SQL) + f"SELECT symbol, {DAY}, {ROUNDED} FROM series QUALIFY row_number() OVER ("
    "PARTITION BY symbol ORDER BY series.tradingdate DESC) = 1",
)
def latest_per_symbol(t: Inputs) -> DataFrame:
    return _shown(series.latest(_daily(t)), "symbol", "tradingdate")


# Sequences


def _steps_sql(length: int, shift: int, rounded: int = 4) -> str:
    """Steps ``length`` rows up to ``shift`` rows before the current one, oldest first."""
    return ", ".join(
        f"round(lag({c}, {length - 1 - i + shift}) {BY_DAY}, {rounded}) AS {c}_{i + 1}" for i in range(length) for c in FEATURES
    )


def _flat(rows: DataFrame, length: int, *first) -> DataFrame:
    return rows.select(*first, *series.step_columns(rows, length))


def _rounded_days(daily: DataFrame) -> DataFrame:
    """Every day rounded once, where its sequences would round it once for each step and label."""
    return _shown(daily, "symbol", "tradingdate")


@query(
    "sequences",
    o.with_(*SERIES_SQL)
    + f"""SELECT symbol, strftime(tradingdate, '%Y-%m-%d') AS label_date, round(last_price, 4) AS label, {_steps_sql(2, 1)}
FROM series QUALIFY row_number() {BY_DAY} > 2""",
)
def sequences(t: Inputs) -> DataFrame:
    return _flat(series.sequences(_rounded_days(_daily(t)), 2), 2, "symbol", "label_date", "label")


@query(
    "sequence_label",
    o.with_(*SERIES_SQL)
    + f"""SELECT symbol, strftime(tradingdate, '%Y-%m-%d') AS label_date, round(last_price, 4) AS label
FROM series QUALIFY row_number() {BY_DAY} > 10""",
)
def sequence_label(t: Inputs) -> DataFrame:
    return series.labels(_daily(t), 10).select("symbol", "label_date", F.round("label", 4).alias("label"))


@query(
    "scoring_sequence",
    o.with_(*SERIES_SQL)
    + f"SELECT symbol, {DAY}, {_steps_sql(3, 0)} FROM series QUALIFY row_number() OVER ("
    f"PARTITION BY symbol ORDER BY series.tradingdate DESC) = 1 AND count(*) {BY_SYMBOL} >= 3",
)
def scoring_sequence(t: Inputs) -> DataFrame:
    return _flat(series.scoring_sequence(_rounded_days(_daily(t)), 3), 3, "symbol", "tradingdate")


_SPLIT = """row_number() OVER (PARTITION BY symbol ORDER BY {0}) <= floor(0.8 * count(*) OVER (PARTITION BY symbol))"""


@query(
    "chrono_split",
    o.with_(*SERIES_SQL)
    + f"""SELECT symbol, strftime(d, '%Y-%m-%d') AS label_date, {_SPLIT.format('d')} AS is_train
FROM (SELECT symbol, series.tradingdate AS d FROM series QUALIFY row_number() {BY_DAY} > 3) AS x""",
)
def chrono_split(t: Inputs) -> DataFrame:
    runs = series.sequences(_daily(t), 3)
    return series.chrono_split(runs, "label_date").select("symbol", "label_date", "is_train")


_NEWER_STEPS = ", ".join(
    f"round(lag({c}, {2 - i}) {BY_DAY}, 4) AS {c}_{i + 1}" for i in range(2) for c in FEATURES
)


@query(
    "incremental_sequences",
    o.with_(*SERIES_SQL)
    + f"""SELECT symbol, strftime(series.tradingdate, '%Y-%m-%d') AS label_date, round(last_price, 4) AS label, {_NEWER_STEPS}
FROM series WHERE NOT ({MARKED}) OR series.tradingdate > '{MARK}' QUALIFY row_number() {BY_DAY} > 2""",
)
def incremental_sequences(t: Inputs) -> DataFrame:
    daily = _stored(t)
    runs = series.incremental_sequences(_rounded_days(daily), _marks(daily), 2)
    return _flat(runs, 2, "symbol", "label_date", "label")


# Sequences over single trades; a busy symbol's trades are cut along their order

TICK_ORDER = ["tradingdate", "time_key", "last_price", "avg_price", "total_val", "change", "ratio_change"]
TICK_LENGTH = 10


def _tick_rows(t: Inputs, odd_times: bool = False) -> DataFrame:
    """Trades as ticks; with ``odd_times`` some have no time, and some a malformed one."""
    trades, cents = t.trades(), F.round(F.col("total_val") * 100).cast("bigint")
    if odd_times:
        malformed = F.when(cents % 13 == 0, "9:30:00").otherwise(F.col("time"))
        trades = trades.withColumn("time", F.when(cents % 11 != 0, malformed))
    clock = clock_key(F.col("time"))
    return trades.select(
        F.trim("symbol").alias("symbol"),
        F.col("trading_date").alias("tradingdate"),
        ticks.hour_slot(F.col("trading_date"), clock).alias("hour_slot"),
        clock.alias("time_key"),
        *FEATURES,
    )


_ODD_TRADE = o.TRADE + """,
odd AS (SELECT * REPLACE (CASE WHEN round(total_val * 100)::BIGINT % 11 <> 0 AND round(total_val * 100)::BIGINT % 13 <> 0
  THEN tk END AS tk) FROM trade)"""
_TICK_WINDOW = ("OVER (PARTITION BY symbol ORDER BY {0}.trading_date NULLS FIRST, tk NULLS FIRST, last_price, avg_price,"
                " total_val, change, ratio_change)")


def _tick_sequences_sql(table: str) -> str:
    window = _TICK_WINDOW.format(table)
    steps = ", ".join(
        f"lag({c}, {TICK_LENGTH - i}) {window} AS {c}_{i + 1}" for i in range(TICK_LENGTH) for c in FEATURES
    )
    return (f"SELECT symbol, {o.day_text('trading_date')} AS tradingdate, tk AS time_key, last_price AS label, {steps}"
            f" FROM {table} QUALIFY row_number() {window} > {TICK_LENGTH}")


def _tick_sequences(rows: DataFrame, target: int) -> DataFrame:
    runs = ticks.tick_sequences(rows, "symbol", "hour_slot", TICK_ORDER, FEATURES, TICK_LENGTH, target)
    return runs.select("symbol", "tradingdate", "time_key", "label", *series.step_columns(runs, TICK_LENGTH))


@query("tick_sequences", o.with_(o.TRADE) + _tick_sequences_sql("trade"))
def tick_sequences(t: Inputs) -> DataFrame:
    """All features of the ten trades before each trade."""
    return _tick_sequences(_tick_rows(t), ticks.SEGMENT_ROWS)


@query("tick_sequences_cut", o.with_(_ODD_TRADE) + _tick_sequences_sql("odd"))
def tick_sequences_cut(t: Inputs) -> DataFrame:
    """The same over trades without a readable time, in segments of a hundred rows."""
    return _tick_sequences(_tick_rows(t, odd_times=True), 100)


def _tick_split_sql(table: str) -> str:
    return f"""SELECT symbol, last_price, position, total, position <= floor(0.8 * total) AS is_train FROM (
  SELECT symbol, last_price, row_number() {_TICK_WINDOW.format(table)} AS position,
    count(*) OVER (PARTITION BY symbol) AS total FROM {table}) AS x"""


def _tick_split(rows: DataFrame, target: int) -> DataFrame:
    placed = ticks.tick_positions(rows, "symbol", "hour_slot", TICK_ORDER, target)
    is_train = F.col("position") <= F.floor(F.col("total") * 0.8)
    return placed.select("symbol", "last_price", "position", "total", is_train.alias("is_train"))


@query("tick_split", o.with_(o.TRADE) + _tick_split_sql("trade"))
def tick_split(t: Inputs) -> DataFrame:
    """Chronological split of single trades by their position within the symbol."""
    return _tick_split(_tick_rows(t), ticks.SEGMENT_ROWS)


@query("tick_split_cut", o.with_(_ODD_TRADE) + _tick_split_sql("odd"))
def tick_split_cut(t: Inputs) -> DataFrame:
    return _tick_split(_tick_rows(t, odd_times=True), 100)


# Models with one lag

_PAIRS = """
pairs AS (
  SELECT symbol, tradingdate AS d, last_price AS x, lead(last_price) OVER w AS y, lead(tradingdate) OVER w AS label_date,
    min(last_price) OVER (PARTITION BY symbol) AS lo, max(last_price) OVER (PARTITION BY symbol) AS hi
  FROM series WINDOW w AS (PARTITION BY symbol ORDER BY tradingdate)
  QUALIFY lead(tradingdate) OVER w IS NOT NULL),
scaled AS (
  SELECT *, coalesce((x - lo) / nullif(hi - lo, 0), 0) AS sx, coalesce((y - lo) / nullif(hi - lo, 0), 0) AS sy FROM pairs)"""
_FIT = """
fit AS (
  SELECT symbol, count(*) AS n, regr_slope(sy, sx) AS slope, regr_intercept(sy, sx) AS intercept, max(lo) AS lo, max(hi) AS hi
  FROM scaled GROUP BY symbol)"""
_LAST = """
last AS (
  SELECT * FROM series QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY tradingdate DESC) = 1),
prediction AS (
  SELECT symbol, tradingdate, last_price,
    (intercept + slope * coalesce((last_price - lo) / nullif(hi - lo, 0), 0)) * (hi - lo) + lo AS predicted_price
  FROM last JOIN fit USING (symbol))"""
_TEST = f"""
split AS (SELECT *, {_SPLIT.format('d')} AS is_train FROM scaled),
train_fit AS (
  SELECT symbol, regr_slope(sy, sx) AS slope, regr_intercept(sy, sx) AS intercept FROM split WHERE is_train GROUP BY symbol),
scored AS (
  SELECT symbol, y, (intercept + slope * sx) * (hi - lo) + lo AS predicted, is_train
  FROM split LEFT JOIN train_fit USING (symbol)),
tested AS (SELECT symbol, CASE WHEN NOT is_train THEN y - predicted END AS e, CASE WHEN NOT is_train THEN y END AS y FROM scored),
metrics AS (
  SELECT symbol, count(e) AS test_rows, avg(e * e) AS mse, avg(abs(e)) AS mae,
    1 - sum(e * e) / nullif(var_pop(CASE WHEN e IS NOT NULL THEN y END) * count(e), 0) AS r2
  FROM tested GROUP BY symbol)"""
MODEL_SQL = o.with_(*SERIES_SQL, _PAIRS, _FIT, _LAST)


def _rounded(rows: DataFrame, **digits: int) -> DataFrame:
    return rows.withColumns({c: F.round(c, n) for c, n in digits.items()})


@query(
    "lag1_fit",
    MODEL_SQL + "SELECT symbol, n, round(slope, 6) AS slope, round(intercept, 6) AS intercept, round(lo, 4) AS lo,"
    " round(hi, 4) AS hi FROM fit",
)
def lag1_fit(t: Inputs) -> DataFrame:
    return _rounded(forecast.fit_lag1(forecast.price_pairs(_daily(t))), slope=6, intercept=6, lo=4, hi=4)


@query(
    "next_price",
    MODEL_SQL + f"SELECT symbol, {DAY}, last_price, round(predicted_price, 5) AS predicted_price FROM prediction",
)
def next_price(t: Inputs) -> DataFrame:
    daily = _stored(t)
    predicted = forecast.predict_next(forecast.fit_lag1(forecast.price_pairs(daily)), daily)
    return _rounded(predicted, predicted_price=5)


def _trained(t: Inputs, steps: bool = False) -> ParquetStore:
    """A warehouse after the training job; with ``steps`` some symbols were trained up to the mark before."""
    warehouse, daily = ParquetStore(t.spark, scratch_path(t.spark, "trained")), _stored(t)
    if steps:
        early = daily.where((F.col("symbol").cast("int") % 3 != 0) & (F.col("tradingdate") <= MARK))
        warehouse.replace("daily_features", early)
        JOBS["train"](warehouse, warehouse)
    warehouse.replace("daily_features", daily)
    JOBS["train"](warehouse, warehouse)
    return warehouse


@query(
    "target_data",
    MODEL_SQL + f"SELECT symbol, {DAY}, round(predicted_price, 2) AS target_next_day_price FROM prediction",
)
def target_data(t: Inputs) -> DataFrame:
    return _trained(t).read("target_data")


@query(
    "prediction_log",
    MODEL_SQL + f"""SELECT symbol, {DAY}, round(last_price, 2) AS last_price,
  round(predicted_price, 6) AS predicted_next_day_price, 'LAG1_' || symbol AS model_name, 'LAG1' AS model_type
FROM prediction""",
)
def prediction_log(t: Inputs) -> DataFrame:
    return _rounded(_trained(t).read("prediction_log"), predicted_next_day_price=6)


@query(
    "model_metrics",
    o.with_(*SERIES_SQL, _PAIRS, _TEST)
    + "SELECT symbol, test_rows, round(mse, 2) AS mse, round(mae, 4) AS mae, round(r2, 6) AS r2 FROM metrics",
)
def model_metrics(t: Inputs) -> DataFrame:
    return _rounded(forecast.evaluate(_daily(t)), mse=2, mae=4, r2=6)


@query(
    "actual_vs_predicted",
    MODEL_SQL
    + f"""SELECT symbol, strftime(label_date, '%Y-%m-%d') AS tradingdate, round(y, 4) AS actual,
  round((intercept + slope * sx) * (fit.hi - fit.lo) + fit.lo, 5) AS predicted,
  label_date = max(label_date) OVER (PARTITION BY symbol) AS is_last
FROM scaled JOIN fit USING (symbol)""",
)
def actual_vs_predicted(t: Inputs) -> DataFrame:
    return _rounded(forecast.actual_vs_predicted(_daily(t)), actual=4, predicted=5)


@query(
    "model_info",
    o.with_(*SERIES_SQL, _PAIRS, _TEST, """
line AS (SELECT symbol, regr_slope(y, x) AS slope, regr_intercept(y, x) AS intercept, max(lo) AS lo, max(hi) AS hi
  FROM pairs GROUP BY symbol),
marks AS (SELECT symbol, max(tradingdate) AS last_train_date FROM series GROUP BY symbol)""")
    + """SELECT symbol, 'LAG1_' || symbol AS model_name, 'LAG1' AS model_type, 'models/LAG1_' || symbol AS model_path,
  strftime(last_train_date, '%Y-%m-%d') AS last_train_date, round(mse, 2) AS mse, round(mae, 4) AS mae, round(r2, 6) AS r2,
  round(lo, 4) AS lo, round(hi, 4) AS hi, round(slope, 6) AS slope, round(intercept, 4) AS intercept
FROM line JOIN marks USING (symbol) LEFT JOIN metrics USING (symbol)""",
)
def model_info(t: Inputs) -> DataFrame:
    """The model table after two runs of the training job."""
    return _rounded(_trained(t, steps=True).read("model_info"), mse=2, mae=4, r2=6, lo=4, hi=4, slope=6, intercept=4)


@query(
    "incremental_fit",
    o.with_(*SERIES_SQL, _PAIRS)
    + """SELECT symbol, count(*) AS n, strftime(max(label_date), '%Y-%m-%d') AS last_train_date, round(max(lo), 4) AS lo,
  round(max(hi), 4) AS hi, round(regr_slope(y, x), 6) AS slope, round(regr_intercept(y, x), 4) AS intercept
FROM pairs GROUP BY symbol""",
)
def incremental_fit(t: Inputs) -> DataFrame:
    """Training up to the mark for some symbols, then of all symbols on what is newer: the same as training at once."""
    daily = _stored(t)
    early = daily.where((F.col("symbol").cast("int") % 3 != 0) & (F.col("tradingdate") <= MARK))
    state = forecast.incremental_fit(daily, staged(forecast.pair_sums(early), "model_state"))
    line = forecast.line_of(state).select("symbol", "n", "last_train_date", "lo", "hi", "slope", "intercept")
    return _rounded(line, lo=4, hi=4, slope=6, intercept=4)


# Models with many lags and features


def _solved_sql(width: int, ridge: float) -> str:
    """CTEs from ``obs(symbol, id, x, y)``, x a list of ``width`` regressors, to ``solution(symbol, r, w)``.

    Covariances with the ridge on the diagonal, then one step of Gauss and Jordan's elimination for each regressor.
    """
    last = width + 1
    return f"""
cells AS (SELECT symbol, id, unnest(range(1, {last + 1})) AS i, unnest(list_append(x, y)) AS v FROM obs),
means AS (SELECT symbol, i, avg(v) AS m FROM cells GROUP BY symbol, i),
near AS (SELECT id, symbol, i, v - m AS v FROM cells JOIN means USING (symbol, i)),
lists AS (SELECT symbol, id, list(v ORDER BY i) AS v FROM near GROUP BY symbol, id),
half AS (
  SELECT symbol, r, c, avg(v[r] * v[c]) AS v FROM lists, (SELECT unnest(range(1, {last + 1})) AS r) AS a,
    (SELECT unnest(range(1, {last + 1})) AS c) AS b WHERE r <= c GROUP BY symbol, r, c),
cov AS (SELECT * FROM half UNION ALL SELECT symbol, c, r, v FROM half WHERE r < c),
steps AS (
  SELECT 0 AS k, symbol, r, c, v + CASE WHEN r = c THEN {ridge!r} ELSE 0 END AS v FROM cov WHERE r <= {width}
  UNION ALL
  SELECT s.k + 1, s.symbol, s.r, s.c, CASE WHEN s.r = s.k + 1 THEN p.v / d.v ELSE s.v - q.v * p.v / d.v END
  FROM steps AS s
  JOIN steps AS p ON p.symbol = s.symbol AND p.r = s.k + 1 AND p.c = s.c
  JOIN steps AS q ON q.symbol = s.symbol AND q.r = s.r AND q.c = s.k + 1
  JOIN steps AS d ON d.symbol = s.symbol AND d.r = s.k + 1 AND d.c = s.k + 1
  WHERE s.k < {width}),
solution AS (SELECT symbol, r, v AS w FROM steps WHERE k = {width} AND c = {last})"""


_SCALED_SERIES = "scaled_series AS (SELECT symbol, tradingdate, " + ", ".join(
    f"coalesce(({c} - min({c}) OVER s) / nullif(max({c}) OVER s - min({c}) OVER s, 0), 0) AS {c}" for c in FEATURES
) + " FROM series WINDOW s AS (PARTITION BY symbol))"


def _lagged(names: list[str], length: int, shift: int = 1) -> str:
    """List of the features ``names`` of ``length`` rows up to ``shift`` rows before, the oldest first."""
    return "[" + ", ".join(f"lag({c}, {length - 1 - i + shift}) OVER w" for i in range(length) for c in names) + "]"


_AR_OBS = f"""
{_SCALED_SERIES},
obs AS (
  SELECT symbol, row_number() OVER () AS id, {_lagged(FEATURES, 2)} AS x, last_price AS y
  FROM scaled_series WINDOW w AS (PARTITION BY symbol ORDER BY tradingdate) QUALIFY row_number() OVER w > 2)"""


@query(
    "fit_products",
    o.with_(*SERIES_SQL, _AR_OBS)
    + """SELECT symbol, (r * 18 - r * (r - 1) // 2 + c - r)::INT AS at, round(sum(z[r + 1] * z[c + 1]), 4) AS total
FROM (SELECT symbol, list_append(list_prepend(1.0, x), y) AS z FROM obs) AS o,
  (SELECT unnest(range(0, 18)) AS r) AS a, (SELECT unnest(range(0, 18)) AS c) AS b WHERE r <= c GROUP BY symbol, r, c""",
)
def fit_products(t: Inputs) -> DataFrame:
    """Sums of products of the constant, the sixteen regressors and the label, upper triangle in row order."""
    products = forecast.fit_products(series.sequences(series.scaled(_stored(t)), 2))
    return products.select("symbol", "at", F.round("total", 4).alias("total"))


@query(
    "ar_fit",
    "WITH RECURSIVE" + o.with_(*SERIES_SQL, _AR_OBS, _solved_sql(16, forecast.RIDGE), f"""
last AS (
  SELECT symbol, tradingdate, {_lagged(FEATURES, 2, 0)} AS x FROM scaled_series
  WINDOW w AS (PARTITION BY symbol ORDER BY tradingdate)
  QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY tradingdate DESC) = 1 AND count(*) OVER (PARTITION BY symbol) >= 2),
fitted AS (
  SELECT symbol, any_value(tradingdate) AS tradingdate, sum(w * (x[r] - m)) AS lift FROM solution JOIN last USING (symbol)
    JOIN means ON means.symbol = solution.symbol AND i = r GROUP BY symbol),
errors AS (
  SELECT l.symbol, id, any_value(v[17]) - sum(w * v[r]) AS e FROM lists AS l JOIN solution AS s ON s.symbol = l.symbol
  GROUP BY l.symbol, id)""").removeprefix("WITH")
    + f"""SELECT symbol, {DAY}, n, round(train_mse, 6) AS train_mse, round(m + lift, 6) AS predicted_scaled
FROM fitted JOIN (SELECT symbol, count(*) AS n, avg(e * e) AS train_mse FROM errors GROUP BY symbol) AS x USING (symbol)
JOIN (SELECT symbol, m FROM means WHERE i = 17) AS y USING (symbol)""",
)
def ar_fit(t: Inputs) -> DataFrame:
    """Two days of eight scaled features, and the price expected next."""
    scaled = series.scaled(_stored(t))
    models = staged(forecast.fit_sequences(series.sequences(scaled, 2), 2), "ar_models")
    scored = forecast.score_sequences(models, series.scoring_sequence(scaled, 2))
    fit = models.select("symbol", "n", F.round("train_mse", 6).alias("train_mse"))
    return fit.join(scored, "symbol").select(
        "symbol", "tradingdate", "n", "train_mse", F.round("predicted_scaled", 6).alias("predicted_scaled")
    )


_TICK_OBS = f"""
scaled_trade AS (SELECT symbol, trading_date, tk, {', '.join(f'{c} AS raw_{c}' for c in FEATURES)}, {', '.join(
    f'coalesce(({c} - min({c}) OVER s) / nullif(max({c}) OVER s - min({c}) OVER s, 0), 0) AS {c}' for c in FEATURES
)} FROM trade WINDOW s AS (PARTITION BY symbol)),
obs AS (
  SELECT symbol, row_number() OVER () AS id, {_lagged(FEATURES, TICK_LENGTH)} AS x, last_price AS y FROM scaled_trade
  WINDOW w AS (PARTITION BY symbol ORDER BY trading_date NULLS FIRST, tk NULLS FIRST, raw_last_price, raw_avg_price,
    raw_total_val, raw_change, raw_ratio_change)
  QUALIFY row_number() OVER w > {TICK_LENGTH})"""


@query(
    "tick_fit",
    "WITH RECURSIVE" + o.with_(o.TRADE, _TICK_OBS, _solved_sql(8 * TICK_LENGTH, forecast.RIDGE)).removeprefix("WITH")
    + f"""SELECT symbol, any_value(n) AS n, round(any_value(yy) - sum(w * v) - {forecast.RIDGE!r} * sum(w * w), 6) AS train_mse
FROM solution JOIN (SELECT symbol, r, v FROM half WHERE c = {8 * TICK_LENGTH + 1}) AS h USING (symbol, r)
JOIN (SELECT symbol, count(*) AS n FROM obs GROUP BY symbol) AS z USING (symbol)
JOIN (SELECT symbol, v AS yy FROM half WHERE r = c AND c = {8 * TICK_LENGTH + 1}) AS q USING (symbol) GROUP BY symbol""",
)
def tick_fit(t: Inputs) -> DataFrame:
    """Ten trades of eight features scaled per symbol, fitted over all trades of a symbol."""
    rows = _tick_rows(t)
    scales = rows.groupBy("symbol").agg(*[
        f(c).alias(f"{n}_{c}") for c in FEATURES for n, f in (("lo", F.min), ("hi", F.max))
    ])
    kept = lookup(rows, scales, {"symbol": "symbol"}, [c for c in scales.columns if c != "symbol"])
    names = {c: f"scaled_{c}" for c in FEATURES}
    kept = kept.select(*rows.columns, *[
        minmax(F.col(c), F.col(f"lo_{c}"), F.col(f"hi_{c}")).alias(names[c]) for c in FEATURES
    ])
    used = list(names.values())
    runs = ticks.tick_sequences(kept, "symbol", "hour_slot", TICK_ORDER, used, TICK_LENGTH)
    models = forecast.fit_sequences(runs, TICK_LENGTH, used)
    return models.select("symbol", "n", F.round("train_mse", 6).alias("train_mse"))
