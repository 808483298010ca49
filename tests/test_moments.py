"""Window models per series, the model table, flat forests and forecasts over ragged ends."""

import numpy as np
import pytest
from frames import noisy
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from tidepanel.operators import features, forecast, forests, learners, moments
from tidepanel.operators.folds import RollingOrigin
from tidepanel.sources import models as store
from tidepanel.sources import sinks

SPLIT = RollingOrigin(8, 2)
LENGTH = 3


@pytest.fixture
def panel(spark):
    return noisy(spark, {"a": (70, 5.0), "b": (55, 1e6), "c": (60, -3.0)})


def arrays(panel):
    """Series to its complete rows: steps and the values of P and Q."""
    out = {}
    for r in features.complete_rows(panel).orderBy("sid", "k").collect():
        out.setdefault(r.sid, []).append((r.k, r.P, r.Q))
    return {s: np.array(v) for s, v in out.items()}


def designs(values, length, horizon, ahead, cols=(1, 2)):
    """Windows (oldest row first) and their targets P, Q."""
    n = len(values) - (length - 1) - ahead
    x = np.stack([values[i : i + length][:, cols].ravel() for i in range(n)])
    y = np.stack([values[i + length - 1 + horizon][1:] for i in range(n)])
    return x, y


@pytest.mark.parametrize("strategy", ["direct", "multi_output"])
def test_models_equal_least_squares(panel, strategy):
    horizons = (1, 4)
    scored, models = moments.evaluate_windows(
        panel, LENGTH, horizons, strategy, targets=("P", "Q"), split=SPLIT, reg=0.0
    )
    found = {(r.sid, r.horizon, r.fold, r.target): r for r in models.collect()}
    shown = {(r.sid, r.horizon, r.fold, r.target, r.k): (r.y, r.yhat) for r in scored.collect()}
    assert len(found) == 3 * 2 * 3 * 2 and len(shown) == 3 * 2 * 2 * 2 * 8
    for sid, values in arrays(panel).items():
        for h in horizons:
            x, y = designs(values, LENGTH, h, h if strategy == "direct" else max(horizons))
            for fold in range(3):
                end = len(x) - 16 + 8 * fold
                mean = x[:end].mean(axis=0)
                for t, target in enumerate("PQ"):
                    w, *_ = np.linalg.lstsq(x[:end] - mean, y[:end, t] - y[:end, t].mean(), rcond=None)
                    bias = y[:end, t].mean() - mean @ w
                    r = found[sid, h, fold, target]
                    assert r.rows == end
                    assert np.allclose(r.weights, w, rtol=1e-6, atol=1e-8)
                    cells = x[:end].reshape(-1, 2)
                    assert np.allclose(r.mean, cells.mean(axis=0)) and np.allclose(r.std, cells.std(axis=0) + 1e-8)
                    for i in range(end, end + 8) if fold < 2 else ():
                        got = shown[sid, h, fold, target, values[i + LENGTH - 1][0]]
                        assert got == pytest.approx((y[i, t], x[i] @ w + bias), rel=1e-7)


def test_scalers_follow_the_fold(panel):
    models = moments.fit_windows(panel, LENGTH, (1,), split=SPLIT)
    rows = features.positions(features.complete_rows(panel))
    for fold in (0, 1):
        count = SPLIT.train_end(F.col("n") - (LENGTH - 1) - 1, F.lit(fold))
        want = {r.sid: r for r in features.window_scaler(rows, LENGTH, count).collect()}
        for r in moments.fold_scalers(models).where(F.col("fold") == fold).collect():
            for name in ("P_mean", "P_std", "Q_mean", "Q_std"):
                assert r[name] == pytest.approx(want[r.sid][name], rel=1e-5)


def test_constant_and_equal_columns_have_finite_models(spark):
    df = noisy(spark, {"a": (40, 5.0)}).withColumn("Q", F.lit(7.0))
    twin = noisy(spark, {"b": (40, 5.0)}).withColumn("Q", F.col("P") * 2)
    for frame, reg in ((df, 1e-6), (twin, 1e-6), (df, 0.0), (twin, 0.0)):
        scored, models = moments.evaluate_windows(frame, LENGTH, (1,), split=SPLIT, reg=reg)
        assert all(np.isfinite(r.weights).all() for r in models.collect())
        assert scored.where("abs(yhat - y) < 100").count() == scored.count() == 16


def test_ar_lags_share_one_gram(panel):
    split = RollingOrigin(10, 1)
    got = {(r.sid, r.lag): r.RMSE for r in moments.search_ar_lags(panel, 5, split=split).collect()}
    for sid, values in arrays(panel).items():
        x, y = designs(values, 5, 1, 1, cols=(1,))
        end = len(x) - 10
        for lag in range(1, 6):
            z = x[:, 5 - lag :] - x[:end, 5 - lag :].mean(axis=0)
            w, *_ = np.linalg.lstsq(z[:end], y[:end, 0] - y[:end, 0].mean(), rcond=None)
            error = y[end:, 0] - (z[end:] @ w + y[:end, 0].mean())
            assert got[sid, lag] == pytest.approx(np.sqrt((error**2).mean()), rel=1e-5)
    assert len(got) == 15


def test_strategy_is_checked(panel):
    with pytest.raises(ValueError, match="Unknown strategy"):
        moments.window_grams(panel, strategy="both")


# ---- model table -----------------------------------------------------------------------------


def test_model_versions(panel, tmp_path, session):
    path = str(tmp_path / "models")
    first = moments.fit_windows(panel, LENGTH, (1,), split=SPLIT, targets=("P", "Q"))
    store.save_models(first, path, 1)
    store.save_models(first.withColumn("intercept", F.lit(0.0)), path, 2)
    (tmp_path / "models" / "version=3").mkdir()  # a writer that never finished
    assert store.versions(session, path) == [1, 2]
    assert store.load_models(session, path).agg(F.max("intercept"), F.max("version")).first()[:] == (0.0, 2)
    again = store.load_models(session, path, 1)
    same = ["sid", "fold", "target", "horizon", "weights", "intercept", "mean", "std"]
    assert sorted(map(str, again.select(same).collect())) == sorted(map(str, first.select(same).collect()))
    with pytest.raises(Exception, match="no finished model version"):
        (tmp_path / "none").mkdir()
        store.load_models(session, str(tmp_path / "none"))


def test_saved_models_roll_every_series_forward(panel, tmp_path, session):
    store.save_models(moments.fit_windows(panel, LENGTH, (1,), split=SPLIT), str(tmp_path / "m"), 1)
    last = store.load_models(session, str(tmp_path / "m")).where(F.col("fold") == SPLIT.n_splits)
    history = forecast.recent_history(panel, LENGTH)
    out = forecast.recursive_models(history, last, LENGTH, 20)
    got = {(r.sid, r.step): r.yhat for r in out.collect()}
    assert len(got) == 60
    for model in last.collect():
        rows = arrays(panel)[model.sid][-LENGTH:, 1:].tolist()
        for step in range(1, 21):
            value = float(np.ravel(rows[-LENGTH:]) @ model.weights + model.intercept)
            assert got[model.sid, step] == pytest.approx(value, abs=0.0051)
            rows.append([value, rows[-1][1]])
    without = forecast.recursive_models(history, last.where("sid = 'a'"), LENGTH, 2)
    assert {r.yhat for r in without.where("sid = 'b'").collect()} == {None}


def test_an_explosive_model_rolls_past_what_a_decimal_holds(spark):
    rows = [("a", 0, [100.0], [1.0]), ("b", 0, [100.0], [1.0])]
    history = spark.createDataFrame(rows, "sid string, k long, P_hist array<double>, Q_hist array<double>")
    own = spark.createDataFrame(
        [("a", [1.7, 0.0], 0.0), ("b", [0.5, 0.0], 50.0)], "sid string, weights array<double>, intercept double"
    )
    out = forecast.recursive_models(history, own, 1, 72, freq="D").collect()
    got = {(r.sid, r.step): r.yhat for r in out}
    assert len(got) == 144 and got["a", 72] > 1e16
    for step in range(1, 73):
        assert got["a", step] == pytest.approx(100 * 1.7**step, rel=1e-12, abs=0.0051)
        assert got["b", step] == 100.0


# ---- flat forests ----------------------------------------------------------------------------


@pytest.fixture
def matrix(panel):
    return sinks.materialize(features.training_matrix(panel, 4, (3,)), "small-matrix")


@pytest.mark.parametrize("build", [
    lambda: learners.random_forest(7, 4), lambda: learners.boosted_trees(5, 2, 0.3), lambda: learners.random_forest(1, 1),
])
def test_flat_forest_predicts_as_the_model(matrix, build):
    rows = learners.labelled(matrix, "P", 1)
    model = learners.fit(build(), rows)
    flat = forests.flatten(model)
    both = model.transform(rows).withColumn("flat", flat.predict(F.col("features")))
    assert both.where("abs(flat - yhat) > 1e-9 * abs(yhat)").count() == 0 and both.count() > 100


def test_forest_rolls_as_the_model_step_by_step(panel, matrix):
    model = learners.fit(learners.random_forest(6, 3), learners.labelled(matrix, "P", 1))
    steps = 72
    got = {(r.sid, r.step): r.yhat for r in learners.recursive_tree(panel, model, steps, 4, (3,)).collect()}
    state = forecast.recent_history(panel, 5).withColumn("at", F.col("k"))
    for step in range(1, steps + 1):
        past = {c: F.slice(f"{c}_hist", 1, 4) for c in "PQ"}
        stamp = features.frequency("H").stamp(F.col("at"))
        x = array_to_vector(features.history_vector(past, stamp, 4, (3,)))
        rows = model.transform(state.withColumn("x", x)).collect()
        for r in rows:
            assert got[r.sid, step] == pytest.approx(r.yhat, abs=0.0051)
        state = panel.sparkSession.createDataFrame(
            [(r.sid, [*r.P_hist[1:], r.yhat], [*r.Q_hist[1:], r.Q_hist[-1]], r["at"] + 1) for r in rows],
            "sid string, P_hist array<double>, Q_hist array<double>, at long",
        )


def test_rolling_a_forest_is_one_stage(panel, matrix):
    model = learners.fit(learners.random_forest(3, 2), learners.labelled(matrix, "P", 1))
    short, long = (learners.recursive_tree(panel, model, n, 4, (3,)) for n in (1, 72))
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    assert plan(short).count("Exchange") == plan(long).count("Exchange")


# ---- ranges ----------------------------------------------------------------------------------


def test_range_costs_each_series_its_own_gap(spark):
    df = noisy(spark, {"late": (60, 5.0), "early": (30, 9.0)})
    old = df.where("sid = 'early'").withColumn("k", F.col("k") - 20_000)
    history = forecast.recent_history(df.where("sid = 'late'").unionByName(old), 5)
    rolls = (
        (forecast.mean_reverting, {"noise": 0.5}),
        (forecast.recursive_linear, {"weights": [0.1, 0.2, 0.6], "intercept": 3.0, "frozen": {"Q": 0.1}}),
        (forecast.recursive_window, {"weights": {"P": [0.2, 0.5], "Q": [0.1, 0.05]}}),
    )
    for roll, options in rolls:
        weights = options.pop("weights", None)
        run = (lambda h, steps, r=roll, w=weights, **o: r(h, w, steps, **o)) if weights else roll
        out = forecast.over_range(history, run, "2024-01-04", "2024-01-05", **options)
        rows = {(r.sid, r.step): (r.gap, r.ts, r.yhat) for r in out.collect()}
        assert {s: len([1 for x, _ in rows if x == s]) for s in ("late", "early")} == {"late": 48, "early": 48}
        assert {g for (s, _), (g, *_) in rows.items() if s == "early"} == {20_000 + 72 - 30}
        whole = run(history.where("sid = 'late'"), 60, **options)
        for r in whole.where(F.col("ts") >= F.lit("2024-01-04").cast("timestamp_ntz")).collect():
            assert rows[r.sid, r.step][1:] == (r.ts, r.yhat)


def test_a_series_beyond_the_range_has_no_rows(spark):
    history = forecast.recent_history(noisy(spark, {"a": (60, 5.0)}), 5)
    assert forecast.over_range(history, forecast.mean_reverting, "2024-01-01", "2024-01-02").count() == 0
    partly = forecast.over_range(history, forecast.mean_reverting, "2024-01-03", "2024-01-03").collect()
    assert [(r.gap, r.step) for r in partly] == [(-12, i) for i in range(1, 13)]


