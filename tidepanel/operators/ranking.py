"""Summaries of a results table ``(model, horizon, fold, target, RMSE, ...)``."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidepanel.functions.metrics import DEFAULT_METRICS, HIGHER_IS_BETTER


def _cost(metric: Column, value: Column) -> Column:
    """Value with its sign turned so that smaller is better."""
    return F.when(metric.isin(*HIGHER_IS_BETTER), -value).otherwise(value)


def _scored(df: DataFrame) -> DataFrame:
    """Rows that have a score: a model without one is never the best."""
    return df.where(F.col("value").isNotNull() & ~F.isnan("value"))


def metrics_agg(
    results: DataFrame,
    names: Sequence[str] = DEFAULT_METRICS,
    by: Sequence[str] = ("model", "horizon", "target"),
) -> DataFrame:
    """Mean of each metric over folds."""
    return results.groupBy(*by).agg(*[F.avg(m).alias(m) for m in names])


def metrics_long(
    results: DataFrame,
    names: Sequence[str] = DEFAULT_METRICS,
    by: Sequence[str] = ("model", "horizon", "target"),
) -> DataFrame:
    """Fold means with one row per metric: ``by..., metric, value``."""
    return metrics_agg(results, names, by).unpivot(list(by), list(names), "metric", "value")


def error_by_horizon(results: DataFrame, metric: str = "RMSE") -> DataFrame:
    return metrics_agg(results, [metric]).select("target", "model", "horizon", metric)


def metrics_pivot(
    results: DataFrame, horizons: Sequence[int], metric: str = "RMSE", target: str = "P"
) -> DataFrame:
    """Model by horizon table of one metric; columns ``h{horizon}``."""
    mean = metrics_agg(results.where(F.col("target") == target), [metric])
    wide = mean.groupBy("model").pivot("horizon", list(horizons)).agg(F.first(metric))
    return wide.select("model", *[F.col(str(h)).alias(f"h{h}") for h in horizons])


def best_per_horizon(results: DataFrame, names: Sequence[str] = DEFAULT_METRICS) -> DataFrame:
    """Every best cell (ties included) per target, metric and horizon, shown with 4 decimals."""
    long = _scored(metrics_long(results, names))
    w = Window.partitionBy("target", "metric", "horizon").orderBy(
        _cost(F.col("metric"), F.col("value"))
    )
    return (
        long.withColumn("_rank", F.rank().over(w))
        .where(F.col("_rank") == 1)
        .select(
            "target", "metric", "horizon", "model", F.format_string("%.4f", "value").alias("shown")
        )
    )


def best_model(results: DataFrame, metric: str = "RMSE") -> DataFrame:
    """Best model per horizon and overall (mean of the horizon means); names break ties.

    Result: ``target, horizon, model, value``; ``horizon`` is text, ``"all"`` overall.
    """
    mean = _scored(
        metrics_agg(results, [metric]).select(
            "target",
            "model",
            F.col("horizon").cast("string").alias("horizon"),
            F.col(metric).alias("value"),
        )
    )
    # one pass over the horizon means yields both levels
    levels = mean.groupBy("target", "model").agg(
        F.collect_list(F.struct("horizon", "value")).alias("cells"), F.avg("value").alias("value")
    )
    overall = F.array(F.struct(F.lit("all").alias("horizon"), F.col("value")))
    cells = levels.select("target", "model", F.inline(F.concat("cells", overall)))
    cost = _cost(F.lit(metric.upper()), F.col("value"))
    best = F.min(F.struct(cost.alias("cost"), "model", "value")).alias("b")
    return cells.groupBy("target", "horizon").agg(best).select(
        "target", "horizon", "b.model", "b.value"
    )


def recommend_model(results: DataFrame, names: Sequence[str] = DEFAULT_METRICS) -> DataFrame:
    """Majority vote over the best model of each metric; the earlier metric breaks ties.

    Result: ``target, model, votes``.
    """
    means = _scored(metrics_long(results, names)).groupBy("target", "metric", "model")
    means = means.agg(F.avg("value").alias("value"))
    cost = _cost(F.col("metric"), F.col("value"))
    winners = means.groupBy("target", "metric").agg(
        F.min(F.struct(cost.alias("cost"), "model")).alias("b")
    )
    place = F.array_position(F.array(*[F.lit(m) for m in names]), F.col("metric"))
    votes = winners.groupBy("target", F.col("b.model").alias("model")).agg(
        F.count(F.lit(1)).alias("votes"), F.min(place).alias("_first")
    )
    return votes.groupBy("target").agg(
        F.max_by(F.struct("model", "votes"), F.struct("votes", -F.col("_first"))).alias("b")
    ).select("target", "b.model", "b.votes")


def skill_vs_naive(results: DataFrame, metric: str = "RMSE", base: str = "Naive") -> DataFrame:
    """``1 - metric / metric of the base model`` per target and horizon."""
    mean = metrics_agg(results, [metric]).withColumnRenamed(metric, "value")
    reference = F.max(F.when(F.col("model") == base, F.col("value"))).over(
        Window.partitionBy("target", "horizon")
    )
    return mean.withColumn("base_value", reference).select(
        "target",
        "horizon",
        "model",
        "value",
        (1 - F.try_divide(F.col("value"), F.col("base_value"))).alias("skill"),
    )


def model_metadata(results: DataFrame) -> DataFrame:
    return results.groupBy("model").agg(
        F.avg("RMSE").alias("avg_rmse"), F.avg("MAE").alias("avg_mae")
    )


def distinct_models(results: DataFrame) -> DataFrame:
    return results.select("target", "model").distinct().orderBy("target", "model")


def pred_vs_actual(predictions: DataFrame) -> DataFrame:
    """Predictions beside actuals with signed and relative error."""
    err = F.col("yhat") - F.col("y")
    return predictions.withColumns(
        {"error": err, "rel_error": F.when(F.abs("y") > 1e-8, F.abs(err) / F.abs("y"))}
    )
