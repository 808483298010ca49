"""Forecast error metrics as aggregate expressions over ``y`` and ``yhat``."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EPS = 1e-8

# metrics for which a larger value is better
HIGHER_IS_BETTER = ("ACC", "ACC_5", "ACC_10")


def _gap(y: Column, yhat: Column) -> Column:
    return F.abs(y - yhat)


def rmse(y: Column, yhat: Column) -> Column:
    return F.sqrt(F.avg((y - yhat) * (y - yhat)))


def mae(y: Column, yhat: Column) -> Column:
    return F.avg(_gap(y, yhat))


def smape(y: Column, yhat: Column) -> Column:
    return 100 * F.avg(_gap(y, yhat) / ((F.abs(y) + F.abs(yhat)) / 2 + EPS))


def wape(y: Column, yhat: Column) -> Column:
    scored = F.when(yhat.isNotNull(), F.abs(y))  # rows without a prediction count on neither side
    return 100 * F.sum(_gap(y, yhat)) / (F.sum(scored) + EPS)


def acc(threshold: float) -> Callable[[Column, Column], Column]:
    """Share of rows within a relative error; rows with a zero actual do not count."""

    def share(y: Column, yhat: Column) -> Column:
        near = (_gap(y, yhat) / F.abs(y) <= threshold).cast("double")
        return F.coalesce(100 * F.avg(F.when(F.abs(y) > EPS, near)), F.lit(0.0))

    return share


METRICS: dict[str, Callable[[Column, Column], Column]] = {
    "RMSE": rmse,
    "MAE": mae,
    "SMAPE": smape,
    "WAPE": wape,
    "ACC": acc(0.05),
    "ACC_5": acc(0.05),
    "ACC_10": acc(0.10),
}
DEFAULT_METRICS = ("RMSE", "MAE", "SMAPE", "WAPE", "ACC_5", "ACC_10")


def metric(name: str) -> Callable[[Column, Column], Column]:
    try:
        return METRICS[name.upper()]
    except KeyError:
        raise ValueError(f"Unknown metric {name!r}; choose from {sorted(METRICS)}") from None


def eval_metrics(
    predictions: DataFrame,
    by: Sequence[str] = ("model", "horizon", "fold", "target"),
    names: Sequence[str] = DEFAULT_METRICS,
) -> DataFrame:
    """All metrics per group in one hash aggregate."""
    y, yhat = F.col("y"), F.col("yhat")
    return predictions.groupBy(*by).agg(*[metric(n)(y, yhat).alias(n.upper()) for n in names])
