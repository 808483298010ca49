"""Registered queries: every operator over the given tables.

Each takes ``(spark, sf_dir)`` and reads whole tables.  Doubles are rounded so
that results of two engines can be compared by value.
"""

from __future__ import annotations

from collections.abc import Callable
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidepanel.functions.metrics import eval_metrics
from tidepanel.operators import (
    baselines,
    features,
    folds,
    forecast,
    forests,
    grid,
    impute,
    learners,
    moments,
    ranking,
    search,
)
from tidepanel.operators.chunks import positions
from tidepanel.plans import pipeline
from tidepanel.sources import generator, models, panels, readers, sinks
from tidepanel.sources.panels import table
from tidepanel.sources.sinks import rounded

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

HORIZONS = (1, 12, 24)
SPLIT = folds.RollingOrigin(test_window=50, n_splits=3)
SEASON = 24
DEPTH = 24
TARGET_P = 60.0
WINDOW = 24
OPTIONS = {"nearest_p": {"target_p": TARGET_P}, "day_copy": {"freq": "H"}}
STRATEGIES = tuple(impute.METHODS)
CHUNK_ROWS = "tidepanel.chunkRows"


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


@contextmanager
def chunks_of(spark, rows: int):
    """Plans built inside cut series into chunks of so many steps."""
    before = spark.conf.get(CHUNK_ROWS, None)
    spark.conf.set(CHUNK_ROWS, str(rows))
    try:
        yield
    finally:
        spark.conf.unset(CHUNK_ROWS) if before is None else spark.conf.set(CHUNK_ROWS, before)


# ---- shared stages ---------------------------------------------------------------------------


def hourly_grid(spark, sf_dir) -> DataFrame:
    return grid.regular_grid(panels.events_hourly(spark, sf_dir), "H")


def hourly_filled(spark, sf_dir) -> DataFrame:
    return impute.impute(hourly_grid(spark, sf_dir), "interpolate")


def filled_once(spark, sf_dir) -> DataFrame:
    """The filled panel as a written table, for what reads it several times."""
    return sinks.materialize(hourly_filled(spark, sf_dir), "filled")


def sample_rows(spark, sf_dir) -> DataFrame:
    """Rows with a complete feature history: what models are trained and scored on."""
    return positions(features.feature_rows(hourly_filled(spark, sf_dir), DEPTH))


def predictions(spark, sf_dir) -> DataFrame:
    # every forecaster reads the samples several times: write them once
    rows = sinks.materialize(sample_rows(spark, sf_dir), "samples")
    simple = baselines.baseline_predictions(
        rows, HORIZONS, SPLIT, (SEASON,), targets=("P", "Q")
    )
    linear = baselines.linear_lag_predictions(rows, HORIZONS, SPLIT)
    return simple.unionByName(linear)


def results(spark, sf_dir) -> DataFrame:
    return eval_metrics(predictions(spark, sf_dir))


def filled_by(method: str) -> Query:
    def run(spark, sf_dir):
        filled = impute.impute(hourly_grid(spark, sf_dir), method, **OPTIONS.get(method, {}))
        return shown(filled, "P", "Q")

    return run


def shown(df: DataFrame, *cols, freq="H", digits=6) -> DataFrame:
    """Series, timestamp and the given columns, rounded."""
    return rounded(grid.with_time(df, freq).select("sid", "ts", *cols), digits)


# ---- sources ---------------------------------------------------------------------------------


@query
def scan_panel(spark, sf_dir):
    return rounded(panels.shipments_daily(spark, sf_dir).drop("k"), 3)


@query
def scan_glob(spark, sf_dir):
    df = readers.with_file_series(readers.read_table(spark, sf_dir, glob="event*.parquet"))
    return df.groupBy("sid", "event_type").agg(
        F.count(F.lit(1)).alias("rows"), F.round(F.sum("value"), 2).alias("P")
    )


@query
def detect_columns(spark, sf_dir):
    raw = table(spark, sf_dir, "events").select(
        F.col("event_type").alias("kind"),
        F.col("ts").alias("Timestamp"),
        F.col("user_id").alias("reactive_power"),
        F.col("value").alias("Active_Power"),
    )
    return readers.load_panel(raw, sid_col="kind")


@query
def project_rename(spark, sf_dir):
    return readers.project_rename(
        table(spark, sf_dir, "lineitem"),
        "l_shipdate",
        "l_extendedprice",
        "l_quantity",
        ["l_discount", "l_tax"],
        "l_returnflag",
    )


@query
def parse_time(spark, sf_dir):
    text = F.when(F.col("o_orderstatus") == "P", F.lit("2024-13-01")).otherwise(
        F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss")
    )
    df = table(spark, sf_dir, "orders").select("o_orderstatus", text.alias("text"))
    df = df.withColumn("ts", readers.parse_time(F.col("text")))
    return df.groupBy("o_orderstatus").agg(
        F.count(F.lit(1)).alias("rows"),
        readers.count_rejects(F.col("text"), F.col("ts")).alias("rejected"),
        F.min("ts").alias("first_ts"),
        F.max("ts").alias("last_ts"),
    )


@query
def tz_localize(spark, sf_dir):
    df = table(spark, sf_dir, "events")
    return df.select(
        "event_id", "ts", readers.localize(F.col("ts"), "Europe/Berlin").alias("ts_utc")
    )


@query
def coerce_numeric(spark, sf_dir):
    df = table(spark, sf_dir, "orders").select(
        "o_orderpriority",
        readers.coerce_numeric(F.col("o_orderpriority")).alias("bad"),
        readers.coerce_numeric(F.substring("o_orderpriority", 1, 1)).alias("level"),
        readers.coerce_numeric(F.col("o_totalprice").cast("string")).alias("price"),
    )
    out = df.groupBy("o_orderpriority").agg(
        F.count_if(F.col("bad").isNull()).alias("bad_nulls"),
        F.sum("level").alias("level_sum"),
        F.sum("price").alias("price_sum"),
    )
    return rounded(out, 2)


@query
def sort_time(spark, sf_dir):
    df = table(spark, sf_dir, "events")
    return df.select(F.col("event_type").alias("sid"), "ts", "event_id").orderBy("sid", "ts")


@query
def gen_panel(spark, sf_dir):
    series = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("sid"))
    return rounded(generator.generate_panel(series, n_days=30, noise=False), 6)


@query
def write_forecast(spark, sf_dir):
    history = forecast.recent_history(hourly_filled(spark, sf_dir), WINDOW)
    path = sinks.scratch_path(spark, "forecast")
    sinks.write_forecast(forecast.mean_reverting(history, 72), path)
    return sinks.read_forecast(spark, path)


@query
def metrics_roundtrip(spark, sf_dir):
    path = sinks.scratch_path(spark, "results")
    sinks.write_results(results(spark, sf_dir).withColumn("strategy", F.lit("interpolate")), path)
    return rounded(sinks.read_results(spark, path), 6)


# ---- grid and audit --------------------------------------------------------------------------


@query
def grid_asfreq(spark, sf_dir):
    return shown(hourly_grid(spark, sf_dir), "P", "Q")


@query
def grid_users(spark, sf_dir):
    users = panels.events_by_user(spark, sf_dir)
    return shown(grid.regular_grid(users, "D"), "P", "Q", freq="D")


@query
def coverage(spark, sf_dir):
    return grid.coverage(panels.events_hourly(spark, sf_dir))


@query
def gap_list(spark, sf_dir):
    return grid.gap_report(panels.events_hourly(spark, sf_dir))


@query
def null_counts(spark, sf_dir):
    return grid.null_counts(hourly_grid(spark, sf_dir))


@query
def missing_map(spark, sf_dir):
    return shown(grid.missing_map(hourly_grid(spark, sf_dir)), "column", "is_missing")


@query
def impute_diff(spark, sf_dir):
    filled = impute.impute(hourly_grid(spark, sf_dir), "interpolate", keep_raw=True)
    return rounded(impute.impute_diff(filled), 6)


@query
def impute_count(spark, sf_dir):
    every = impute.impute_each(
        hourly_grid(spark, sf_dir), STRATEGIES, options=OPTIONS, keep_raw=True
    )
    return impute.impute_count(every, by=("strategy", "sid"))


@query
def nonfinite_counts(spark, sf_dir):
    ship = table(spark, sf_dir, "lineitem")
    ratio = ship.select(
        F.col("l_returnflag").alias("sid"),
        F.when(F.col("l_tax") == 0, F.lit(float("inf")))
        .otherwise(F.col("l_discount") / F.nullif(F.col("l_tax"), F.lit(0.0)))
        .alias("P"),
        F.when(F.col("l_discount") == 0, F.lit(float("nan"))).otherwise(F.col("l_tax")).alias("Q"),
    )
    return grid.nonfinite_counts(ratio)


# ---- imputation ------------------------------------------------------------------------------

for _method in STRATEGIES:
    QUERIES[f"impute_{_method}"] = filled_by(_method)


@query
def impute_interpolate_both(spark, sf_dir):
    filled = impute.impute(hourly_grid(spark, sf_dir), "interpolate", both=True)
    return shown(filled, "P", "Q")


@query
def impute_seasonal_level(spark, sf_dir):
    filled = impute.impute(hourly_grid(spark, sf_dir), "seasonal", mode="level")
    return shown(filled, "P", "Q")


@query
def seasonal_decompose(spark, sf_dir):
    parts = impute.seasonal_decompose(hourly_grid(spark, sf_dir), cols=("P",))
    resid = F.col("P__fill") - F.col("P__trend") - F.col("P__seasonal")
    return shown(
        parts,
        F.col("P__trend").alias("trend"),
        F.col("P__seasonal").alias("seasonal"),
        resid.alias("resid"),
        digits=7,
    )


@query
def impute_users(spark, sf_dir):
    users = grid.regular_grid(panels.events_by_user(spark, sf_dir), "D")
    filled = impute.impute(users, "interpolate")
    return shown(filled, "P", "Q", freq="D")


@query
def strategy_compare(spark, sf_dir):
    every = impute.impute_each(hourly_grid(spark, sf_dir), STRATEGIES, options=OPTIONS)
    return compared(every, SKIP_SHORT, SEASON)


@query
def strategy_compare_users(spark, sf_dir):
    """Series of mixed lengths: the short ones are counted, not forgotten."""
    users = grid.regular_grid(panels.events_by_user(spark, sf_dir), "D")
    every = impute.impute_each(users, ("forward", "interpolate"))
    return compared(every, folds.RollingOrigin(5, 3, short="skip"), 7)


SKIP_SHORT = folds.RollingOrigin(SPLIT.test_window, SPLIT.n_splits, short="skip")


def compared(every: DataFrame, split: folds.RollingOrigin, season: int) -> DataFrame:
    """Baseline scores per strategy, and how many series were too short to be scored."""
    every = sinks.materialize(every, "strategies")
    rows = features.complete_rows(every)
    scored = baselines.baseline_predictions(rows, (1,), split, (season,), by=("strategy", "sid"))
    results = eval_metrics(scored, by=("strategy", "model", "horizon", "fold", "target"))
    complete = F.count_if(F.col("P").isNotNull() & F.col("Q").isNotNull())
    short = (
        every.groupBy("strategy", "sid")
        .agg(complete.alias("n"))
        .groupBy("strategy")
        .agg(F.count_if(F.col("n") - 1 < split.min_rows).alias("skipped"))
    )
    return rounded(short.join(results, "strategy", "left"), 6)


# a long daily series, cut into several chunks
def _orders(method: str) -> Query:
    def run(spark, sf_dir):
        with chunks_of(spark, 256):
            daily = grid.regular_grid(panels.orders_daily(spark, sf_dir), "D")
            options = OPTIONS.get(method, {}) | ({"freq": "D"} if method == "day_copy" else {})
            return shown(impute.impute(daily, method, **options), "P", "Q", freq="D")

    return run


for _method in STRATEGIES:
    QUERIES[f"impute_{_method}_orders"] = _orders(_method)


@query
def grid_raw(spark, sf_dir):
    """Raw rows: off the grid, several to a step; the latest of a step counts."""
    raw = table(spark, sf_dir, "events").select(
        F.col("event_type").alias("sid"), "ts", F.col("value").alias("P"), "event_id"
    )
    hours = raw.withColumn("ts", F.date_trunc("hour", "ts").cast("timestamp_ntz"))
    return shown(grid.regular_grid(hours, "H", ("P",), latest_by="event_id"), "P")


# ---- features --------------------------------------------------------------------------------


@query
def lag_features(spark, sf_dir):
    wide = features.lag_features(hourly_grid(spark, sf_dir), lags=range(1, 25))
    return grid.with_time(wide).drop("chunk", "k")


def _rolling(stat: str) -> Query:
    def run(spark, sf_dir):
        wide = features.rolling_features(hourly_filled(spark, sf_dir), stats=[stat])
        return rounded(grid.with_time(wide).drop("chunk", "k", "P", "Q"), 6)

    return run


for _stat in features.ROLLING:
    QUERIES[f"rolling_{_stat}"] = _rolling(_stat)


@query
def calendar_features(spark, sf_dir):
    wide = features.calendar_features(hourly_grid(spark, sf_dir))
    return rounded(grid.with_time(wide).drop("chunk", "k", "P", "Q"), 6)


MATRIX = {"max_lag": 24, "windows": (6, 12, 24), "exog": ("discount", "tax")}
EXOG = ("P", "Q", "discount", "tax")


def shipments_filled(spark, sf_dir):
    daily = grid.regular_grid(panels.shipments_daily(spark, sf_dir), "D", EXOG)
    return impute.impute(daily, "interpolate", EXOG)


@query
def feature_matrix(spark, sf_dir):
    wide = features.feature_matrix(shipments_filled(spark, sf_dir), freq="D", **MATRIX)
    names = features.feature_names(EXOG, MATRIX["max_lag"], MATRIX["windows"])
    cells = [F.col("features")[i].alias(name) for i, name in enumerate(names)]
    return shown(wide, "P", "Q", *cells, freq="D")


@query
def sequence_windows(spark, sf_dir):
    wide = features.sequence_windows(hourly_filled(spark, sf_dir), length=24, horizons=(2,))
    long = wide.select("sid", "k", "P_h2", F.posexplode("x").alias("step", "x"))
    return shown(long, "step", "x.P", "x.Q", F.col("P_h2").alias("y"))


@query
def sequence_windows_time(spark, sf_dir):
    """Windows of the unfilled panel that never reach across a missing hour."""
    rows = features.islands(hourly_grid(spark, sf_dir))
    wide = features.sequence_windows(rows, length=6, horizons=(2,), by=("sid", "island"))
    long = wide.select("sid", "k", "P_h2", F.posexplode("x").alias("step", "x"))
    return shown(long, "step", "x.P", "x.Q", F.col("P_h2").alias("y"))


@query
def baselines_time(spark, sf_dir):
    """Baselines whose sources lie in the same run of successive hours."""
    rows = features.islands(hourly_grid(spark, sf_dir))
    split = folds.RollingOrigin(3, 2, short="skip")
    scored = baselines.baseline_predictions(rows, (1,), split, (4,), by=("sid", "island"))
    return rounded(eval_metrics(scored, by=["sid", "model", "horizon", "fold", "target"]), 6)


@query
def horizon_target(spark, sf_dir):
    out = features.horizon_targets(sample_rows(spark, sf_dir), (12,), ("P", "Q"))
    return shown(out, "P", "P_h12", "Q_h12")


@query
def multi_horizon_targets(spark, sf_dir):
    out = features.horizon_targets(sample_rows(spark, sf_dir), HORIZONS, ("P",))
    return shown(out, *[f"P_h{h}" for h in HORIZONS])


@query
def sequence_standardize(spark, sf_dir):
    rows = positions(features.complete_rows(hourly_filled(spark, sf_dir)))
    windows = F.col("n") - (WINDOW - 1) - 1
    scaler = features.window_scaler(rows, WINDOW, SPLIT.first_train(windows))
    return shown(features.standardize(rows, scaler), "P", "Q")


# ---- folds -----------------------------------------------------------------------------------


@query
def rolling_origin_folds(spark, sf_dir):
    return SPLIT.folds(folds.series_lengths(sample_rows(spark, sf_dir)))


@query
def fold_assignment(spark, sf_dir):
    return shown(SPLIT.assign(sample_rows(spark, sf_dir)), "rn", "fold", "role")


@query
def leak_check(spark, sf_dir):
    return folds.leak_check(SPLIT.assign(sample_rows(spark, sf_dir)))


# ---- metrics ---------------------------------------------------------------------------------


def _one_metric(name: str) -> Query:
    def run(spark, sf_dir):
        out = eval_metrics(
            predictions(spark, sf_dir), by=["sid", "model", "horizon", "target"], names=[name]
        )
        return rounded(out, 6)

    return run


for _name in ("rmse", "mae", "smape", "wape", "acc"):
    QUERIES[f"metric_{_name}"] = _one_metric(_name)


@query
def eval_metrics_all(spark, sf_dir):
    out = eval_metrics(predictions(spark, sf_dir), by=["sid", "model", "horizon", "fold", "target"])
    return rounded(out, 6)


QUERIES["eval_metrics"] = QUERIES.pop("eval_metrics_all")


# ---- forecasters -----------------------------------------------------------------------------


@query
def naive_forecast(spark, sf_dir):
    return rounded(baselines.naive_forecast(hourly_filled(spark, sf_dir), 24), 6)


def _seasonal(rule: str) -> Query:
    def run(spark, sf_dir):
        rows = hourly_filled(spark, sf_dir)
        return rounded(baselines.seasonal_naive_forecast(rows, SEASON, 72, 1, rule), 6)

    return run


QUERIES["seasonal_naive"] = _seasonal("textbook")
QUERIES["seasonal_naive_wrapped"] = _seasonal("wrapped")


@query
def eval_baselines(spark, sf_dir):
    scored = baselines.baseline_predictions(
        sample_rows(spark, sf_dir), HORIZONS, SPLIT, (SEASON,), targets=("P", "Q")
    )
    return rounded(eval_metrics(scored, by=["sid", "model", "horizon", "fold", "target"]), 6)


@query
def eval_baselines_textbook(spark, sf_dir):
    scored = baselines.baseline_predictions(
        sample_rows(spark, sf_dir), HORIZONS, SPLIT, (SEASON,), rule="textbook"
    )
    return rounded(eval_metrics(scored, by=["sid", "model", "horizon", "fold", "target"]), 6)


@query
def ar1_direct(spark, sf_dir):
    scored = baselines.linear_lag_predictions(sample_rows(spark, sf_dir), HORIZONS, SPLIT)
    return shown(scored, "horizon", "fold", "y", "yhat")


# ---- future forecast -------------------------------------------------------------------------

# Weights of the demonstration window model, oldest input first.
WEIGHTS = (0.05, 0.05, 0.1, 0.1, 0.2, 0.3)
Q_WEIGHT, INTERCEPT = 0.5, 2.0


@query
def forecast_spine(spark, sf_dir):
    return forecast.forecast_spine(forecast.last_step(hourly_grid(spark, sf_dir)))


@query
def recursive_linear(spark, sf_dir):
    history = forecast.recent_history(hourly_filled(spark, sf_dir), len(WEIGHTS))
    return forecast.recursive_linear(history, WEIGHTS, 72, INTERCEPT, {"Q": Q_WEIGHT})


@query
def mean_reverting(spark, sf_dir):
    history = forecast.recent_history(hourly_filled(spark, sf_dir), WINDOW)
    return forecast.mean_reverting(history, 72)


@query
def forecast_range(spark, sf_dir):
    history = forecast.recent_history(hourly_filled(spark, sf_dir), WINDOW)
    return forecast.over_range(history, forecast.mean_reverting, "2024-02-01", "2024-02-02")


@query
def forecast_summary(spark, sf_dir):
    return rounded(forecast.forecast_summary(mean_reverting(spark, sf_dir)), 6)


@query
def head_tail(spark, sf_dir):
    rows = features.complete_rows(hourly_filled(spark, sf_dir))
    return forecast.head_tail(rows, "P")


# ---- result analytics ------------------------------------------------------------------------


@query
def metrics_agg(spark, sf_dir):
    return rounded(ranking.metrics_agg(results(spark, sf_dir)), 6)


@query
def metrics_pivot(spark, sf_dir):
    return rounded(ranking.metrics_pivot(results(spark, sf_dir), HORIZONS), 6)


@query
def best_per_horizon(spark, sf_dir):
    return ranking.best_per_horizon(results(spark, sf_dir))


@query
def best_model(spark, sf_dir):
    return rounded(ranking.best_model(results(spark, sf_dir)), 6)


@query
def recommend_model(spark, sf_dir):
    return ranking.recommend_model(results(spark, sf_dir))


@query
def error_by_horizon(spark, sf_dir):
    return rounded(ranking.error_by_horizon(results(spark, sf_dir)), 6)


@query
def metrics_long(spark, sf_dir):
    return rounded(ranking.metrics_long(results(spark, sf_dir)), 6)


@query
def pred_vs_actual(spark, sf_dir):
    out = ranking.pred_vs_actual(predictions(spark, sf_dir))
    return shown(out, *[c for c in out.columns if c not in ("sid", "season", "k")])


@query
def distinct_models(spark, sf_dir):
    return ranking.distinct_models(results(spark, sf_dir))


@query
def model_metadata(spark, sf_dir):
    return rounded(ranking.model_metadata(results(spark, sf_dir)), 6)


@query
def skill_vs_naive(spark, sf_dir):
    return rounded(ranking.skill_vs_naive(results(spark, sf_dir)), 6)


# ---- parameter search ------------------------------------------------------------------------

SEASONS = (12, 24, 48, 168)


@query
def search_space(spark, sf_dir):
    base = table(spark, sf_dir, "events").select(F.col("event_type").alias("sid")).distinct()
    widths = {"d_model": [64, 128, 192, 256, 320], "nhead": [4, 8, 12, 16]}
    return search.grid_space(base, widths, F.col("d_model") % F.col("nhead") == 0)


@query
def search_space_random(spark, sf_dir):
    """Reproducible trials over lists, a uniform and a log-uniform range, under a constraint."""
    base = table(spark, sf_dir, "events").select(F.col("event_type").alias("sid")).distinct()
    space = {
        "d_model": [64, 128, 192, 256, 320],
        "nhead": [4, 8, 12, 16],
        "learning_rate": search.Range(1e-5, 1e-3, log=True),
        "dropout": search.Range(0.05, 0.3),
    }
    out = search.sequence_space(base, 50, space, F.col("d_model") % F.col("nhead") == 0)
    return rounded(out, 8)


@query
def search_seasonal_length(spark, sf_dir):
    out = search.search_seasonal_length(sample_rows(spark, sf_dir), SEASONS, split=ONE_FOLD)
    return rounded(out, 6)


ONE_FOLD = folds.RollingOrigin(100, 1)


@query
def best_trial(spark, sf_dir):
    trials = search.search_seasonal_length(sample_rows(spark, sf_dir), SEASONS, split=ONE_FOLD)
    return rounded(search.best_trial(trials, "season"), 6)


# ---- learned forecasters ---------------------------------------------------------------------

TREE_LAGS, TREE_WINDOWS = 24, (6, 24)
TREE_SPLIT = folds.RollingOrigin(100, 1)


def _matrix(spark, sf_dir, targets=("P",)) -> DataFrame:
    filled = hourly_filled(spark, sf_dir)
    wide = features.training_matrix(filled, TREE_LAGS, TREE_WINDOWS, (1,), targets)
    return sinks.materialize(wide, "matrix")


def _forest():
    return learners.random_forest(20, 3, minInstancesPerNode=10)


def _boosted():
    return learners.boosted_trees(20, 2, 0.3, subsamplingRate=0.5)


def _trees(spark, sf_dir, estimators, targets=("P",)):
    matrix = _matrix(spark, sf_dir, targets)
    return learners.evaluate_trees(matrix, estimators, 1, targets, TREE_SPLIT)


@query
def rf_forecast(spark, sf_dir):
    return _trees(spark, sf_dir, {learners.RANDOM_FOREST: _forest()})[0]


@query
def gbt_forecast(spark, sf_dir):
    return _trees(spark, sf_dir, {learners.BOOSTED: _boosted()})[0]


@query
def multi_target(spark, sf_dir):
    scored, _ = _trees(spark, sf_dir, {learners.RANDOM_FOREST: _forest()}, ("P", "Q"))
    return eval_metrics(scored)


@query
def feature_importance(spark, sf_dir):
    _, models = _trees(spark, sf_dir, {learners.RANDOM_FOREST: _forest()}, ("P", "Q"))
    names = learners.matrix_names(TREE_LAGS, TREE_WINDOWS)
    return learners.feature_importance(list(models.values()), names, top=20)


@query
def eval_trees(spark, sf_dir):
    both = {learners.RANDOM_FOREST: _forest(), learners.BOOSTED: _boosted()}
    return eval_metrics(_trees(spark, sf_dir, both)[0])


WINDOW_SPLIT = folds.RollingOrigin(100, 2)


# no bootstrap, all features, a bin for every value: the best single split, which SQL can find
STUMP = {"max_depth": 1, "featureSubsetStrategy": "all", "maxBins": 4096}


@query
def stump_forecast(spark, sf_dir):
    """Two folds, horizons 1 and 12, targets P and Q, by a forest and a boosted model of one split."""
    matrix = features.training_matrix(
        filled_once(spark, sf_dir), 2, (), (1, 12), ("P", "Q"), use_time=False, partial=True
    )
    matrix = sinks.materialize(matrix, "stump-matrix")
    both = {
        learners.RANDOM_FOREST: learners.random_forest(1, bootstrap=False, **STUMP),
        learners.BOOSTED: learners.boosted_trees(1, **STUMP),
    }
    parts = [learners.evaluate_trees(matrix, both, h, ("P", "Q"), WINDOW_SPLIT)[0] for h in (1, 12)]
    scored = parts[0].unionByName(parts[1])
    return shown(scored, "model", "horizon", "fold", "target", "y", "yhat")


@query
def eval_stumps(spark, sf_dir):
    return rounded(eval_metrics(stump_forecast(spark, sf_dir)), 6)


@query
def strategy_run(spark, sf_dir):
    """A run over strategies, one of which fails, and the same run again: it tries only that one."""
    grid_, path = sinks.materialize(hourly_grid(spark, sf_dir), "grid"), sinks.scratch_path(spark, "strategies-run")

    def evaluate(filled):
        rows = features.complete_rows(filled)
        return eval_metrics(baselines.baseline_predictions(rows, (1,), SPLIT, (SEASON,)))

    for _ in range(2):
        pipeline.run_strategies(grid_, ["forward", "spline", "interpolate"], evaluate, path)
    status = pipeline.read_status(spark, path).select("strategy", "state", "attempts", "rows")
    out = rounded(status.join(sinks.read_results(spark, f"{path}/results"), "strategy", "left"), 6)
    return out.fillna(0, ["rows"]).fillna(-1, ["horizon", "fold"]).fillna("", ["model", "target"])


def _sequences(strategy: str) -> Query:
    def run(spark, sf_dir):
        scored, _ = moments.evaluate_windows(
            filled_once(spark, sf_dir), WINDOW, HORIZONS, strategy, targets=("P", "Q"), split=WINDOW_SPLIT
        )
        return eval_metrics(scored, by=["sid", "horizon", "fold", "target"])

    return run


QUERIES["seq_direct"] = _sequences("direct")
QUERIES["seq_multi_output"] = _sequences("multi_output")


def _two_inputs(strategy: str) -> Query:
    """Windows of one row of P and Q, whose normal equations SQL can solve."""

    def run(spark, sf_dir):
        scored, _ = moments.evaluate_windows(
            filled_once(spark, sf_dir), 1, (1, 12), strategy, targets=("P", "Q"), split=WINDOW_SPLIT, reg=0.0
        )
        return shown(scored, "horizon", "fold", "target", "y", "yhat")

    return run


QUERIES["seq_direct_two"] = _two_inputs("direct")
QUERIES["seq_multi_output_two"] = _two_inputs("multi_output")


@query
def fold_scalers(spark, sf_dir):
    fitted = moments.fit_windows(filled_once(spark, sf_dir), WINDOW, (1,), split=SPLIT)
    return rounded(moments.fold_scalers(fitted).where(F.col("fold") < SPLIT.n_splits), 6)


@query
def search_ar_lags(spark, sf_dir):
    return moments.search_ar_lags(filled_once(spark, sf_dir), 24, split=ONE_FOLD, reg=1e-6)


@query
def best_ar_lag(spark, sf_dir):
    return search.best_trial(search_ar_lags(spark, sf_dir), "lag")


@query
def search_ar_lags_two(spark, sf_dir):
    return rounded(moments.search_ar_lags(filled_once(spark, sf_dir), 2, split=ONE_FOLD), 6)


@query
def run_evaluation(spark, sf_dir):
    run = pipeline.Evaluation(
        horizons=(1, 12),
        targets=("P", "Q"),
        split=WINDOW_SPLIT,
        max_lag=TREE_LAGS,
        windows=TREE_WINDOWS,
        trees={learners.RANDOM_FOREST: learners.random_forest(5, 3, minInstancesPerNode=10)},
    )
    return pipeline.run_evaluation(hourly_filled(spark, sf_dir), run)


@query
def best_model_forecast(spark, sf_dir):
    run = pipeline.Evaluation(
        split=TREE_SPLIT,
        max_lag=TREE_LAGS,
        windows=TREE_WINDOWS,
        trees={learners.RANDOM_FOREST: _forest()},
    )
    return pipeline.best_model_forecast(hourly_filled(spark, sf_dir), run)


@query
def model_reload_eval(spark, sf_dir):
    """Models of two versions are saved; the first is asked for again and scored."""
    filled, path = filled_once(spark, sf_dir), sinks.scratch_path(spark, "model-table")
    options = {"length": 1, "horizons": (1, 12), "targets": ("P", "Q"), "split": WINDOW_SPLIT}
    fitted = moments.fit_windows(filled, **options, reg=0.0)
    models.save_models(fitted, path, 1)
    models.save_models(fitted.withColumn("intercept", F.lit(0.0)), path, 2)
    scored = moments.window_predictions(filled, models.load_models(spark, path, 1), **options)
    return rounded(eval_metrics(scored, by=["sid", "model", "horizon", "fold", "target"]), 6)


USER_SPLIT = folds.RollingOrigin(5, 3, short="skip")


def users_filled(spark, sf_dir) -> DataFrame:
    daily = grid.regular_grid(panels.events_by_user(spark, sf_dir, "D"), "D")
    return sinks.materialize(impute.impute(daily, "interpolate"), "users-filled")


@query
def recursive_models(spark, sf_dir):
    """Every user's own model: fitted on all history, saved, read again, rolled 72 days."""
    filled, path = users_filled(spark, sf_dir), sinks.scratch_path(spark, "user-models")
    models.save_models(moments.fit_windows(filled, 1, (1,), split=USER_SPLIT, reg=1e-3), path, 1)
    whole = models.load_models(spark, path).where(F.col("fold") == USER_SPLIT.n_splits)
    history = forecast.recent_history(features.complete_rows(filled), 1, short="null")
    return forecast.recursive_models(history, whole, 1, 72, freq="D")


@query
def forecast_range_users(spark, sf_dir):
    """One range of dates for users whose data end on different days."""
    history = forecast.recent_history(users_filled(spark, sf_dir), 6, short="skip")
    return forecast.over_range(history, forecast.mean_reverting, "2024-03-01", "2024-03-07", "D")


@query
def recursive_tree(spark, sf_dir):
    filled = hourly_filled(spark, sf_dir)
    _, fitted = _trees(spark, sf_dir, {learners.RANDOM_FOREST: _forest()})
    model = fitted[learners.RANDOM_FOREST, "P"]
    return learners.recursive_tree(filled, model, 72, TREE_LAGS, TREE_WINDOWS)


def _named(name: str) -> int:
    return learners.matrix_names(TREE_LAGS, TREE_WINDOWS).index(name)


def _node(name: str, threshold: float, left, right) -> dict:
    return {"feature": _named(name), "threshold": threshold, "left": left, "right": right}


def small_forest() -> forests.Forest:
    """A small forest over the feature matrix, for a forecast that SQL can follow."""
    return forests.Forest.of(
        (
            _node("P_lag_1", 60.0, _node("P_roll_mean_6", 55.0, 51.5, 57.0), _node("P_lag_24", 65.0, 62.0, 71.5)),
            _node("Q_lag_1", 3.0, 48.5, _node("hour_sin", 0.1, 66.0, 58.5)),
        )
    )


@query
def recursive_forest(spark, sf_dir):
    return forests.recursive_forest(
        hourly_filled(spark, sf_dir), small_forest(), 72, TREE_LAGS, TREE_WINDOWS
    )


@query
def search_trees(spark, sf_dir):
    trials = [{"n_estimators": n, "max_depth": d} for n in (5, 10) for d in (2, 4)]
    return search.search_trees(
        _matrix(spark, sf_dir), trials, learners.random_forest, split=TREE_SPLIT
    )
