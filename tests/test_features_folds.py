import numpy as np
import pandas as pd
import pytest
from frames import column, gridded

from pyspark.sql import functions as F

from tidepanel.functions.metrics import eval_metrics, metric
from tidepanel.operators import baselines, features, folds, forecast, ranking
from tidepanel.operators.chunks import positions

RNG = np.random.default_rng(5)
VALUES = [float(v) for v in RNG.normal(100, 20, 40).round(3)]
GAPPY = [None if i in (7, 19) else v for i, v in enumerate(VALUES)]


def test_lags_and_rolling_match_pandas(spark):
    df = gridded(spark, a=GAPPY)
    s = pd.Series(GAPPY, dtype=float)
    wide = features.rolling_features(features.lag_features(df, 3), (3, 6))
    for k in (1, 2, 3):
        assert np.allclose(np.array(column(wide, f"P_lag_{k}"), float), s.shift(k), equal_nan=True)
    for n in (3, 6):
        past = s.shift(1).rolling(n)
        for stat in ("mean", "std", "min", "max"):
            got = np.array(column(wide, f"P_roll_{stat}_{n}"), float)
            assert np.allclose(got, getattr(past, stat)(), equal_nan=True), (stat, n)


def test_feature_matrix_equals_explicit_columns(spark):
    df = gridded(spark, a=GAPPY)
    lags, windows = 3, (2, 5)
    vector = features.feature_matrix(df, lags, windows)
    names = features.feature_names(["P", "Q"], lags, windows)
    wide = features.rolling_features(features.lag_features(df, lags), windows)
    wide = features.calendar_features(wide).dropna()
    assert column(vector, "k") == column(wide, "k")
    got = np.array(column(vector, "features"), float)
    want = np.array([[r[n] for n in names] for r in wide.orderBy("k").collect()], float)
    assert got.shape[1] == len(names) and np.allclose(got, want)
    kept = features.feature_rows(df, 5)
    assert column(kept, "k") == column(vector, "k")


def test_training_matrix_targets_follow_row_order(spark):
    df = gridded(spark, a=GAPPY)
    m = features.training_matrix(df, 2, (2,), (3,))
    rows = column(features.feature_rows(df, 2), "P")
    assert column(m, "P_h3") == rows[3:]
    assert column(m, "rn") == list(range(len(rows) - 3))


def test_sequence_windows_skip_incomplete_rows(spark):
    df = gridded(spark, a=GAPPY)
    clean = [v for v in GAPPY if v is not None]
    w = features.sequence_windows(df, 4, (2,)).orderBy("k").collect()
    assert len(w) == len(clean) - 4 - 2 + 1
    for i, row in enumerate(w):
        assert [x.P for x in row.x] == clean[i : i + 4] and row.P_h2 == clean[i + 5]
        assert (row["sample"], row["samples"]) == (i, len(w))


def test_multi_horizon_targets_are_aligned(spark):
    out = features.horizon_targets(gridded(spark, a=VALUES), (1, 5)).orderBy("k").collect()
    assert [r.P_h1 for r in out] == VALUES[1:36] and [r.P_h5 for r in out] == VALUES[5:]
    gappy = features.complete_rows(gridded(spark, a=GAPPY))
    strict = features.horizon_targets(gappy, (1,), contiguous=True)
    assert strict.count() == 38 - 1 - 2


def test_window_scaler_equals_built_windows(spark):
    rows = positions(gridded(spark, a=VALUES))
    length, train = 5, 20
    scaler = features.window_scaler(rows, length, F.lit(train), ("P",)).first()
    cells = np.array([VALUES[i : i + length] for i in range(train)])
    assert scaler.P_mean == pytest.approx(cells.mean())
    assert scaler.P_std == pytest.approx(cells.std() + 1e-8)


def test_rolling_origin_positions(spark):
    lengths = spark.createDataFrame([("a", 100)], "sid string, n long")
    got = folds.RollingOrigin(10, 3).folds(lengths).orderBy("fold").collect()
    assert [(r.train_end, r.test_start, r.test_end) for r in got] == [
        (70, 70, 80), (80, 80, 90), (90, 90, 100),
    ]
    gap = folds.RollingOrigin(10, 3, gap=5).folds(lengths).orderBy("fold").collect()
    assert [(r.train_end, r.test_start, r.test_end) for r in gap] == [
        (65, 70, 80), (75, 80, 90), (85, 90, 100),
    ]


def test_short_series_raise_or_are_skipped(spark):
    lengths = spark.createDataFrame([("a", 39), ("b", 40)], "sid string, n long")
    with pytest.raises(Exception, match="Not enough samples"):
        folds.RollingOrigin(10, 3).folds(lengths).collect()
    kept = folds.RollingOrigin(10, 3, short="skip").folds(lengths)
    assert {r.sid for r in kept.collect()} == {"b"}
    with pytest.raises(ValueError):
        folds.RollingOrigin(0, 3)


def test_split_pairs_match_assignment(spark):
    split = folds.RollingOrigin(6, 2, gap=1)
    rows = gridded(spark, a=VALUES, b=VALUES[:25])
    assigned = split.assign(rows)
    assert folds.leak_check(assigned).where("NOT in_order").count() == 0
    for i, (train, test) in enumerate(split.split(rows)):
        for role, part in (("train", train), ("test", test)):
            want = assigned.where((F.col("fold") == i) & (F.col("role") == role))
            key = lambda d: sorted((r.sid, r.k) for r in d.collect())
            assert key(part) == key(want)


def reference_scores(y, h, tw, k, m):
    """Plain restatement of the baseline evaluation for one series."""
    actual, base = y[h:], y[: len(y) - h]
    out = {}
    first = len(base) - tw * k
    for fold in range(k):
        end = first + fold * tw
        test = actual[end : end + tw]
        naive = np.full(tw, base[end - 1])
        seasonal = np.array([base[:end][(end - m + h - 1 + i) % end] for i in range(tw)])
        for name, pred in (("Naive", naive), ("SeasonalNaive", seasonal)):
            out[name, fold] = (np.sqrt(np.mean((test - pred) ** 2)), np.mean(np.abs(test - pred)))
    return out


@pytest.mark.parametrize("h,season", [(1, 4), (3, 4), (2, 30)])
def test_baselines_match_restatement(spark, h, season):
    split = folds.RollingOrigin(6, 3)
    rows = gridded(spark, a=VALUES)
    scored = baselines.baseline_predictions(rows, (h,), split, (season,))
    got = {
        (r.model, r.fold): (r.RMSE, r.MAE)
        for r in eval_metrics(scored, names=["rmse", "mae"]).collect()
    }
    want = reference_scores(np.array(VALUES), h, 6, 3, season)
    assert got.keys() == want.keys()
    for key in want:
        assert got[key] == pytest.approx(want[key])


def test_seasonal_naive_with_less_than_one_season(spark):
    # positions 3 - 5 + i = -2, -1, 0, 1; the negative ones become i modulo 3
    out = baselines.seasonal_naive_forecast(gridded(spark, a=[1, 2, 3]), 5, 4)
    assert column(out, "P_hat", order="step") == [1, 2, 1, 2]
    repeat = baselines.seasonal_naive_forecast(gridded(spark, a=[1, 2, 3, 4]), 2, 5)
    assert column(repeat, "P_hat", order="step") == [3, 4, 3, 4, 3]


def test_linear_lag_matches_polyfit(spark):
    split = folds.RollingOrigin(6, 2)
    scored = baselines.linear_lag_predictions(gridded(spark, a=VALUES), (2,), split)
    y = np.array(VALUES)
    x, target = y[:-2], y[2:]
    for fold in range(2):
        end = len(x) - 12 + fold * 6
        slope, icpt = np.polyfit(x[:end], target[:end], 1)
        got = column(scored.where(F.col("fold") == fold), "yhat")
        assert np.allclose(got, icpt + slope * x[end : end + 6])


def metrics_of(spark, y, yhat, names):
    df = spark.createDataFrame([("m", float(a), float(b)) for a, b in zip(y, yhat)], "model string, y double, yhat double")
    return eval_metrics(df, ["model"], names).first()


def test_metric_edges(spark):
    row = metrics_of(spark, [0, 0], [1, 2], ["ACC", "WAPE", "smape"])
    assert row.ACC == 0.0 and np.isfinite(row.WAPE) and row.SMAPE == pytest.approx(200)
    assert metrics_of(spark, [100, 100], [105, 106], ["ACC_5"]).ACC_5 == 50.0
    with pytest.raises(ValueError, match="Unknown metric"):
        metric("R2")


def results(spark, rows):
    return spark.createDataFrame(
        [(m, h, 0, "P", v, v, v, v, 100 - v, 100 - v) for m, h, v in rows],
        "model string, horizon int, fold int, target string, RMSE double, MAE double,"
        " SMAPE double, WAPE double, ACC_5 double, ACC_10 double",
    )


def test_ranking_ties_and_direction(spark):
    r = results(spark, [("B", 1, 2.0), ("A", 1, 2.0), ("C", 1, 3.0), ("C", 2, 0.5), ("A", 2, 4.0), ("B", 2, 4.0)])
    best = {x.horizon: x.model for x in ranking.best_model(r).collect()}
    assert best == {"all": "C", "1": "A", "2": "C"}
    assert {x.horizon: x.model for x in ranking.best_model(r, "ACC_10").collect()} == best
    cells = ranking.best_per_horizon(r).where("horizon = 1 AND metric = 'ACC_5'").collect()
    assert {c.model for c in cells} == {"A", "B"}
    vote = ranking.recommend_model(r).first()
    assert (vote.model, vote.votes) == ("C", 6)


def test_recursive_linear_equals_plain_loop(spark):
    history = forecast.recent_history(gridded(spark, a=VALUES), 3)
    out = forecast.recursive_linear(history, [0.2, 0.3, 0.4], 10, 1.5, {"Q": 0.01})
    window, want = VALUES[-3:], []
    for _ in range(10):
        value = 1.5 + 0.01 * 10 * VALUES[-1] + np.dot(window, [0.2, 0.3, 0.4])
        want.append(value)
        window = [*window[1:], value]
    assert np.allclose(column(out, "yhat", order="step"), want, atol=0.006)


def test_mean_reverting_noise_is_seeded(spark):
    history = forecast.recent_history(gridded(spark, a=VALUES), 5)
    path = lambda seed: column(forecast.mean_reverting(history, 8, 1.0, seed), "yhat", order="step")
    assert path(1) == path(1) != path(2)
    flat = column(forecast.mean_reverting(history, 2), "yhat", order="step")
    assert flat[0] == round(VALUES[-1], 2)
    assert flat[1] == pytest.approx(0.7 * flat[0] + 0.3 * np.mean(VALUES[-5:]), abs=0.006)


def test_date_spine_covers_whole_last_day(spark):
    df = spark.createDataFrame([("2025-10-20", "2025-10-22")], "a string, b string")
    spine = forecast.date_spine(df, F.col("a").cast("timestamp_ntz"), F.col("b").cast("timestamp_ntz"))
    assert spine.count() == 72


def test_islands_across_chunks(spark):
    rng = np.random.default_rng(4)
    for seed in range(4):
        values = [None if rng.random() < 0.15 else float(i) for i in range(60)]
        df = gridded(spark, a=values, b=[1.0] * 30, c=[None, 2.0, None, 3.0])
        got = {(r.sid, r.k): r.island for r in features.islands(df).collect()}
        first = min(k for s, k in got if s == "b")
        want, start = {}, None
        for i, v in enumerate(values):
            start = None if v is None else (i if start is None else start)
            if v is not None:
                want["a", first + i] = first + start
        want |= {("b", first + i): first for i in range(30)} | {("c", first + i): first + i for i in (1, 3)}
        assert got == want


def test_windows_and_baselines_stay_inside_an_island(spark):
    values = [float(i) if i % 11 else None for i in range(70)]
    rows = features.islands(gridded(spark, a=values))
    wide = features.sequence_windows(rows, 4, (2,), by=("sid", "island")).collect()
    for r in wide:
        p = [x.P for x in r.x]
        assert p == list(np.arange(p[0], p[0] + 4)) and r.P_h2 == p[-1] + 2
    assert len(wide) == 6 * 5 and {r.samples for r in wide} <= {5}
    split = folds.RollingOrigin(2, 1, short="skip")
    scored = baselines.baseline_predictions(rows, (1,), split, (3,), by=("sid", "island"))
    for r in scored.where("model = 'Naive'").collect():
        assert 0 < r.y - r.yhat <= 3 and r.y // 11 == r.yhat // 11
