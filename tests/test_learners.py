import pytest
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from tidepanel.functions.metrics import eval_metrics
from tidepanel.operators import forecast, grid, impute, learners, ranking, search
from tidepanel.operators.features import training_matrix
from tidepanel.operators.folds import RollingOrigin
from tidepanel.plans import pipeline
from tidepanel.sources import generator, sinks

SPLIT = RollingOrigin(48, 1)


@pytest.fixture(scope="module")
def load(session):
    """Two noisy daily load curves, gridded and filled."""
    series = session.createDataFrame([("a",), ("b",)], "sid string")
    raw = generator.generate_panel(series, n_days=20, seed=7)
    return sinks.materialize(impute.impute(grid.regular_grid(raw), "interpolate"), "load")


@pytest.fixture(scope="module")
def matrix(load):
    return sinks.materialize(training_matrix(load, 24, (6,)), "matrix")


def forest(**options):
    return learners.random_forest(**{"n_estimators": 10, "max_depth": 4} | options)


def test_whole_run_beats_naive(load, session, tmp_path):
    run = pipeline.Evaluation(
        horizons=(1,), split=SPLIT, windows=(6,), trees={"RandomForest": forest()}
    )
    failed = pipeline.run_strategies(load, ["forward", "spline"], run, str(tmp_path))
    assert list(failed) == ["spline"]
    every = sinks.read_results(session, f"{tmp_path}/results")
    results = every.where("strategy = 'forward'")
    assert every.count() == results.count()
    rmse = {r.model: (r.RMSE, r.lead) for r in results.collect()}
    assert set(rmse) == {"Naive", "SeasonalNaive", "RandomForest", "LinearWindow"}
    for learned in ("RandomForest", "LinearWindow"):
        assert rmse[learned][0] < 0.6 * rmse["Naive"][0]
    assert rmse["RandomForest"][1] == 2 and rmse["LinearWindow"][1] == 1
    skill = {r.model: r.skill for r in ranking.skill_vs_naive(results).collect()}
    assert skill["Naive"] == 0 and skill["LinearWindow"] > 0.4


def test_strategies_resume(load, session, tmp_path):
    path, calls = str(tmp_path), []

    def evaluate(filled):
        calls.append(filled)
        if len(calls) == 2:
            raise RuntimeError("executor lost")
        return filled.groupBy("sid").agg(F.count("P").alias("n"))

    assert list(pipeline.run_strategies(load, ["forward", "mean", "spline"], evaluate, path)) == ["mean", "spline"]
    assert pipeline.run_strategies(load, ["forward", "mean", "spline"], evaluate, path).keys() == {"spline"}
    assert len(calls) == 3  # forward was done, mean came again, spline never got so far
    rows = {r.strategy: r for r in pipeline.read_status(session, path).collect()}
    assert {s: (r.state, r.attempts, r.rows) for s, r in rows.items()} == {
        "forward": ("done", 1, 2), "mean": ("done", 2, 2), "spline": ("failed", 2, None),
    }
    assert "Unknown imputation method" in rows["spline"].error and rows["mean"].error is None
    assert sinks.read_results(session, f"{path}/results").groupBy("strategy").count().count() == 2


def test_trees_are_deterministic_and_roll_forward(load, matrix):
    def run():
        scored, models = learners.evaluate_trees(matrix, {"rf": forest()}, 1, ("P",), SPLIT)
        return eval_metrics(scored, names=["RMSE"]).first().RMSE, models["rf", "P"]

    (first, model), (second, _) = run(), run()
    assert first == second
    ahead = learners.recursive_tree(load, model, 10, 24, (6,))
    rows = ahead.where("sid = 'a'").orderBy("step").collect()
    assert [r.step for r in rows] == list(range(1, 11))
    assert all(50 < r.yhat < 150 for r in rows)
    one = learners.recursive_tree(load, model, 1, 24, (6,)).orderBy("sid").collect()
    assert one == ahead.where("step = 1").orderBy("sid").collect()
    names = learners.matrix_names(24, (6,))
    top = learners.feature_importance([model], names).collect()
    assert len(top) == len(names) and top[0].importance >= top[-1].importance
    assert sum(r.importance for r in top) == pytest.approx(1)


def test_direct_uses_more_windows_than_multi_output(load):
    frames = {}
    for strategy in ("direct", "multi_output"):
        scored, _ = learners.evaluate_sequences(load, 24, (1, 12), strategy, split=SPLIT)
        frames[strategy] = {r.horizon: r.k for r in scored.groupBy("horizon").agg(F.max("k").alias("k")).collect()}
    assert frames["direct"][1] == frames["direct"][12] + 11
    assert frames["multi_output"][1] == frames["multi_output"][12]
    with pytest.raises(ValueError, match="Unknown strategy"):
        learners.evaluate_sequences(load, strategy="both")


def test_fitted_window_model_rolls_forward(load, session):
    _, models = learners.evaluate_sequences(load, 6, (1,), split=SPLIT)
    weights, intercept = learners.window_weights(models["P", 1])
    history = forecast.recent_history(load, 6)
    rolled = forecast.recursive_window(history, weights, 9, intercept)
    got = {(r.sid, r.step): r.yhat for r in rolled.collect()}
    for row in history.collect():
        p, q = list(row.P_hist), list(row.Q_hist)
        for step in range(1, 10):
            flat = [v for pair in zip(p[-6:], q[-6:]) for v in pair]
            x = session.createDataFrame([(Vectors.dense(flat),)], ["x"])
            value = models["P", 1].transform(x).first().yhat
            assert got[row.sid, step] == pytest.approx(value, abs=0.0051)
            p.append(value)
            q.append(q[-1])


def test_one_matrix_serves_all_horizons(load):
    whole = training_matrix(load, 24, (6,), (1, 12), partial=True)
    for h in (1, 12):
        own = training_matrix(load, 24, (6,), (h,)).select("sid", "k", "rn", "n", f"P_h{h}")
        same = whole.where(F.col(f"P_h{h}").isNotNull()).select(*own.columns)
        assert own.exceptAll(same).count() == 0 and same.exceptAll(own).count() == 0


def test_best_model_is_rolled_forward(load):
    run = pipeline.Evaluation(split=SPLIT, windows=(6,))
    rows = pipeline.best_model_forecast(load, run, 5).orderBy("sid", "step").collect()
    assert [(r.model, r.sid, r.step) for r in rows] == [
        ("LinearWindow", s, i) for s in "ab" for i in range(1, 6)
    ]
    assert all(50 < r.yhat < 150 for r in rows)


def test_failed_trial_scores_worst(matrix):
    trials = [{"n_estimators": 3}, {"n_estimators": -1}]
    out = search.search_trees(matrix, trials, learners.random_forest, split=SPLIT)
    rows = {r.trial: r for r in out.collect()}
    assert rows[1].RMSE is None and rows[1].failed and rows[1].ACC_10 == 0.0
    assert rows[0].RMSE > 0 and not rows[0].failed


def test_sequence_space_repeats_and_fills_the_range(session):
    base = session.createDataFrame([("a",), ("b",)], "sid string")
    space = search.sequence_space(
        base, 64, {"w": [64, 96, 128], "n": [4, 16], "rate": search.Range(1e-5, 1e-1, log=True), "drop": search.Range(0, 0.5)},
        F.col("w") % (F.col("n") * 4) == 0,
    )
    rows = space.orderBy("sid", "trial").collect()
    assert [r.trial for r in rows] == [*range(64)] * 2 and rows[:64][5][2:] == rows[64:][5][2:]
    assert all(r.w % (r.n * 4) == 0 for r in rows)
    drops = sorted(r["drop"] for r in rows[:64])
    assert max(b - a for a, b in zip(drops, drops[1:])) < 0.03 and drops[-1] < 0.5
    assert sum(r.rate < 1e-3 for r in rows[:64]) in range(28, 37)
    for least, proposals in ((2, 20), (1, 10)):
        with pytest.raises(Exception, match="trials within"):
            search.sequence_space(base, 9, {"w": [1, 2]}, F.col("w") > least, proposals).collect()


def test_radical_inverse(session):
    got = session.range(1, 10).select(*[search.radical_inverse(F.col("id"), b) for b in (2, 3)]).collect()
    assert [r[0] for r in got][:4] == [0.5, 0.25, 0.75, 0.125]
    assert [r[1] for r in got][:3] == pytest.approx([1 / 3, 2 / 3, 1 / 9])


def test_random_space_stays_in_range(session):
    base = session.range(1)
    space = search.random_space(
        base, 200, {"width": [64, 128]}, {"rate": search.log_uniform(1e-5, 1e-3, 1)}
    )
    rows = space.collect()
    assert {r.width for r in rows} == {64, 128}
    assert all(1e-5 <= r.rate <= 1e-3 for r in rows)
    assert len({r.rate for r in rows}) == 200
