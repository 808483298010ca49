"""Nothing is lost or ranked without a score: short, constant, all-NULL and keyless series."""

import datetime as dt

import numpy as np
import pytest
from frames import at, column, gridded, panel
from pyspark.sql import functions as F

from tidepanel.functions.metrics import eval_metrics
from tidepanel.functions.numbers import normal, rounded, uniform
from tidepanel.operators import baselines, features, folds, forecast, grid, impute, ranking, search
from tidepanel.operators.chunks import positions
from tidepanel.sources import generator

VALUES = [float(v) for v in np.random.default_rng(3).normal(100, 20, 40).round(3)]


def test_short_series_raises_or_is_reported(spark):
    df = gridded(spark, a=VALUES, b=VALUES[:5])
    with pytest.raises(Exception, match="too short"):
        forecast.recent_history(df, 24).collect()
    for roll in (
        lambda h: forecast.recursive_linear(h, [0.5, 0.4], 3),
        lambda h: forecast.mean_reverting(h, 3),
    ):
        out = roll(forecast.recent_history(df, 24, short="null"))
        assert column(out, "yhat", "b", "step") == [None] * 3
        assert None not in column(out, "yhat", "a", "step")
    assert {r.sid for r in forecast.recent_history(df, 24, short="skip").collect()} == {"a"}


def test_grid_raises_without_key_or_time(spark):
    schema = "sid string, ts timestamp_ntz, P double, Q double"
    for row in ((None, at(0), 1.0, 1.0), ("a", None, 1.0, 1.0)):
        rows = spark.createDataFrame([row, ("a", at(1), 2.0, 2.0)], schema)
        with pytest.raises(Exception, match="NULL series key"):
            grid.regular_grid(rows, "H").collect()


def test_latest_row_of_a_step(spark):
    rows = [("a", at(0), 1.0, 2), ("a", at(0), 5.0, 1), ("a", at(2), 7.0, 9), ("a", at(2.5), 8.0, 10)]
    df = spark.createDataFrame(rows, "sid string, ts timestamp_ntz, P double, v int")
    assert column(grid.regular_grid(df, "H", ("P",), latest_by="v")) == [1.0, None, 7.0]
    with pytest.raises(Exception, match="duplicate"):
        grid.regular_grid(df, "H", ("P",)).collect()


def test_constant_and_high_series_predict(spark):
    rng = np.random.default_rng(1)
    high = [1e9 + float(x) for x in rng.uniform(0, 1, 60)]
    df = positions(gridded(spark, flat=[7.0] * 60, high=high))
    split = folds.RollingOrigin(10, 2)
    out = baselines.linear_lag_predictions(df, (1,), split)
    assert set(column(out, "yhat", "flat")) == {7.0}
    for fold in (0, 1):
        got = column(out.where(F.col("fold") == fold), "yhat", "high")
        train = 59 - 20 + 10 * fold
        x, y = np.array(high[:train]) - 1e9, np.array(high[1 : train + 1]) - 1e9
        slope = ((x - x.mean()) * (y - y.mean())).sum() / ((x - x.mean()) ** 2).sum()
        want = y.mean() + slope * (np.array(high[train : train + 10]) - 1e9 - x.mean())
        assert np.allclose(np.array(got) - 1e9, want, atol=1e-6)


def test_a_model_without_a_score_is_never_best(spark):
    names = ["RMSE", "MAE", "SMAPE", "WAPE", "ACC_5", "ACC_10"]
    rows = [("Good", 1, 0, "P", *[1.0] * 6), ("Null", 1, 0, "P", *[None] * 6), ("NaN", 1, 0, "P", *[float("nan")] * 6)]
    results = spark.createDataFrame(
        rows, "model string, horizon int, fold int, target string, " + ", ".join(f"{n} double" for n in names)
    )
    assert {r.model for r in ranking.best_model(results).collect()} == {"Good"}
    assert {r.model for r in ranking.best_per_horizon(results).collect()} == {"Good"}
    assert ranking.recommend_model(results).first().model == "Good"


def test_wape_counts_scored_rows_only(spark):
    rows = spark.createDataFrame([(10.0, 9.0), (90.0, None)], "y double, yhat double")
    assert eval_metrics(rows, [], ["WAPE"]).first()[0] == pytest.approx(10.0)


def test_all_null_series_stays_null(spark):
    df = gridded(spark, a=VALUES, n=[None] * 40)
    for method in impute.METHODS:
        options = {"freq": "H"} if method == "day_copy" else {}
        out = impute.impute(df, method, **options)
        assert column(out, "P", "n") == [None] * 40, method


def test_day_copy_asks_for_the_frequency(spark):
    with pytest.raises(TypeError, match="freq"):
        impute.impute(gridded(spark, a=VALUES), "day_copy")


def test_short_series_are_counted_by_the_comparison(spark):
    from tidepanel.plans import queries

    df = impute.impute_each(gridded(spark, a=VALUES, b=VALUES[:5]), ("forward",))
    out = queries.compared(df, folds.RollingOrigin(5, 3, short="skip"), 4).collect()
    assert {r.skipped for r in out} == {1} and {r.model for r in out} == {"Naive", "SeasonalNaive"}
    none = impute.impute_each(gridded(spark, b=VALUES[:5]), ("forward",))
    (row,) = queries.compared(none, folds.RollingOrigin(5, 3, short="skip"), 4).collect()
    assert (row.skipped, row.model) == (1, None)


@pytest.mark.parametrize("parts", [1, 7])
def test_draws_do_not_depend_on_partitions(spark, parts):
    series = spark.range(20).select(F.col("id").cast("string").alias("sid"))
    total = lambda df: df.agg(F.round(F.sum("P"), 6), F.count("P"), F.count("Q")).first()
    assert total(generator.generate_panel(series.repartition(parts), 3)) == total(
        generator.generate_panel(series.coalesce(1), 3)
    )
    space = lambda n: sorted(
        search.random_space(series.repartition(n), 3, {"a": [1, 2, 3]}, {"b": search.uniform(0, 1, 5, ("sid", "trial"))}).collect()
    )
    assert space(parts) == space(3)


def test_draws_have_the_right_shape(spark):
    df = spark.range(20_000).select(uniform(1, "id").alias("u"), normal(2, "id").alias("n"))
    r = df.agg(F.avg("u"), F.min("u"), F.max("u"), F.avg("n"), F.stddev("n")).first()
    assert abs(r[0] - 0.5) < 0.01 and 0 <= r[1] and r[2] < 1 and abs(r[3]) < 0.03 and abs(r[4] - 1) < 0.03


def test_rounding_is_half_up_of_the_decimal(spark):
    df = spark.createDataFrame([(1.005,), (2.675,), (-0.125,), (None,)], "x double")
    assert [r[0] for r in df.select(rounded("x", 2)).collect()] == [1.01, 2.68, -0.13, None]


def test_forecast_over_dates_reports_the_gap(spark):
    history = forecast.recent_history(gridded(spark, a=VALUES, b=VALUES[:30]), 5)
    out = forecast.over_range(history, forecast.mean_reverting, "2024-01-03", "2024-01-03")
    assert {(r.sid, r.gap) for r in out.collect()} == {("a", 8), ("b", 18)}
    assert out.groupBy("sid").count().where("count <> 24").count() == 0


def test_rounding_equals_decimals_and_leaves_large_values_alone(spark):
    tie = (F.floor(F.rand(3) * 2e6 - 1e6) + 0.5) / F.pow(F.lit(10.0), F.floor(F.rand(4) * 9))
    wide = F.randn(5) * F.pow(F.lit(10.0), F.floor(F.rand(6) * 30) - 15)
    df = spark.range(20_000).select(F.explode(F.array(tie, wide)).alias("x")).where("abs(x) < 9e15")
    for digits in (0, 2, 6, 8, 9):
        exact = F.round(F.col("x").cast("decimal(28,12)"), digits).cast("double")
        assert df.where(~rounded("x", digits).eqNullSafe(exact)).count() == 0
    large = [2.0**53, 1e16, -3.5e250, float("nan"), float("inf"), -0.001]
    df = spark.createDataFrame([(x,) for x in large], "x double")
    assert [r[0] for r in df.select(rounded("x", 2)).collect()] == [2.0**53, 1e16, -3.5e250, None, None, 0.0]


def test_panel_of_one_file_is_generated_by_many_tasks(spark):
    sids = spark.range(0, 60, 1, 1).select((F.col("id") % 50).cast("string").alias("sid"))
    sids = sids.unionByName(spark.createDataFrame([(None,)], "sid string")).coalesce(1)
    out = generator.generate_panel(sids, 8, noise=False)
    assert out.columns == ["sid", "ts", "P", "Q"]
    tasks = out.groupBy(F.spark_partition_id()).count().collect()
    assert len(tasks) == 8 and max(r["count"] for r in tasks) <= 2 * 61 * 192 / 8
    # repeated and NULL keys keep their rows
    assert out.where("sid = '3'").count() == 2 * 192 and out.where("sid IS NULL").count() == 192
    first = dt.datetime(2023, 1, 1)
    rows = {r.ts: r for r in out.where("sid = '11'").collect()}
    assert sorted(rows) == [first + dt.timedelta(hours=h) for h in range(192)]
    for ts, r in rows.items():
        load = 100 + 30 * np.sin(2 * np.pi * ts.hour / 24) - 10 * (ts.weekday() >= 5)
        assert (r.P, r.Q) == pytest.approx((load, 50 + 0.4 * (load - 100)))
