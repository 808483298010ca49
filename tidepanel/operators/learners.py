"""Learned forecasters on Spark ML: trees on the feature matrix, linear window models.

Models are fitted on all series pooled.  Loops on the driver run over horizons,
folds and targets, whose number is set by the caller; every fit is distributed.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import StandardScaler
from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidepanel.functions.timeaxis import Frequency
from tidepanel.operators.chunks import SERIES
from tidepanel.operators.features import feature_names, sequence_windows
from tidepanel.operators.folds import RollingOrigin
from tidepanel.operators.forests import flatten, recursive_forest
from tidepanel.sources.sinks import materialize

RANDOM_FOREST, BOOSTED = "RandomForest", "GradientBoosting"


def random_forest(n_estimators: int = 100, max_depth: int = 5, seed: int = 42, **options):
    """Options go to the estimator, e.g. minInstancesPerNode or featureSubsetStrategy."""
    return RandomForestRegressor(
        featuresCol="x", labelCol="y", predictionCol="yhat",
        numTrees=n_estimators, maxDepth=max_depth, seed=seed, **options,
    )


def boosted_trees(
    n_estimators: int = 100, max_depth: int = 6, learning_rate: float = 0.1, seed: int = 42, **options
):
    return GBTRegressor(
        featuresCol="x", labelCol="y", predictionCol="yhat",
        maxIter=n_estimators, maxDepth=max_depth, stepSize=learning_rate, seed=seed, **options,
    )


def linear_window(reg: float = 1e-6):
    """Standardised least squares; the scaler is fitted and stored with the model."""
    scale = StandardScaler(inputCol="x", outputCol="z", withMean=True, withStd=True)
    solve = LinearRegression(
        featuresCol="z", labelCol="y", predictionCol="yhat", regParam=reg, solver="normal"
    )
    return Pipeline(stages=[scale, solve])


def window_weights(model: PipelineModel, cols: Sequence[str] = ("P", "Q")) -> tuple[dict, float]:
    """Weights per column, oldest window row first, and intercept of a fitted ``linear_window``.

    The scaler is folded in; a position that never varied in training has weight 0.
    """
    scale, solve = model.stages
    std, mean = scale.std.toArray(), scale.mean.toArray()
    coef = solve.coefficients.toArray()
    flat = [c / s if s > 0 else 0.0 for c, s in zip(coef, std)]
    intercept = solve.intercept - sum(w * m for w, m in zip(flat, mean))
    return {c: flat[i :: len(cols)] for i, c in enumerate(cols)}, float(intercept)


def labelled(samples: DataFrame, target: str, horizon: int, vector: str = "features") -> DataFrame:
    """Add the input vector ``x`` and the label ``y`` of one target and horizon."""
    return samples.withColumns(
        {"x": array_to_vector(F.col(vector)), "y": F.col(f"{target}_h{horizon}")}
    )


def fit(estimator, train: DataFrame) -> PipelineModel:
    stages = estimator if isinstance(estimator, Pipeline) else Pipeline(stages=[estimator])
    return stages.fit(train.select("x", "y"))


def predict(model, rows: DataFrame, name: str, target: str, horizon: int, fold: int, by=SERIES):
    """Predictions in long form: ``model, by..., horizon, fold, target, k, y, yhat``.

    ``k`` is the step of the sample, ``horizon`` rows before the predicted one.
    """
    return model.transform(rows).select(
        F.lit(name).alias("model"),
        *by,
        F.lit(horizon).alias("horizon"),
        F.lit(fold).alias("fold"),
        F.lit(target).alias("target"),
        "k",
        "y",
        F.col("yhat").cast("double").alias("yhat"),
    )


def _cut(samples: DataFrame, position: str, count: Column, split: RollingOrigin, fold: int):
    end = split.train_end(count, F.lit(fold))
    start = end + split.gap
    at = F.col(position)
    usable = samples.where(split.usable(count))
    return usable.where(at < end), usable.where((at >= start) & (at < start + split.test_window))


def evaluate_trees(
    matrix: DataFrame,
    estimators: Mapping[str, object],
    horizon: int = 1,
    targets: Sequence[str] = ("P",),
    split: RollingOrigin = RollingOrigin(100, 3),
    by: Sequence[str] = SERIES,
) -> tuple[DataFrame, dict[tuple[str, str], PipelineModel]]:
    """Fit, predict and collect predictions per fold, target and tree model.

    ``matrix`` comes from ``training_matrix`` with this horizon.  Also returns the
    models of the last fold by ``(name, target)``.
    """
    out, models = None, {}
    for fold in range(split.n_splits):
        train, test = _cut(matrix, "rn", F.col("n") - horizon, split, fold)
        for target in targets:
            for name, estimator in estimators.items():
                models[name, target] = fit(estimator, labelled(train, target, horizon))
                scored = predict(
                    models[name, target], labelled(test, target, horizon),
                    name, target, horizon, fold, by,
                )
                out = scored if out is None else out.unionByName(scored)
    return out, models


def feature_importance(
    models: Sequence[PipelineModel], names: Sequence[str], top: int | None = None
) -> DataFrame:
    """``feature, importance`` averaged over the models (one per target), largest first."""
    from pyspark.sql import SparkSession

    spark = SparkSession.getActiveSession()
    scores = [
        (name, float(score))
        for model in models
        for name, score in zip(names, model.stages[-1].featureImportances.toArray())
    ]
    table = spark.createDataFrame(scores, "feature string, importance double")
    ordered = table.groupBy("feature").agg(F.avg("importance").alias("importance")).orderBy(
        F.desc("importance"), "feature"
    )
    return ordered if top is None else ordered.limit(top)


def window_vectors(samples: DataFrame, cols: Sequence[str] = ("P", "Q")) -> DataFrame:
    """Flatten the window of structs into one array, oldest row first."""
    flat = F.flatten(F.transform("x", lambda row: F.array(*[row[c] for c in cols])))
    return samples.withColumn("features", flat).drop("x")


def evaluate_sequences(
    df: DataFrame,
    length: int = 24,
    horizons: Sequence[int] = (1,),
    strategy: str = "multi_output",
    cols: Sequence[str] = ("P", "Q"),
    targets: Sequence[str] = ("P",),
    split: RollingOrigin = RollingOrigin(100, 3),
    by: Sequence[str] = SERIES,
) -> tuple[DataFrame, dict[tuple[str, int], PipelineModel]]:
    """Linear window models, scored out of fold.

    ``direct`` gives every horizon all the windows it can use; ``multi_output`` uses
    one window set, that of the largest horizon, for all of them.
    """
    if strategy not in ("direct", "multi_output"):
        raise ValueError(f"Unknown strategy {strategy!r}; choose direct or multi_output")
    groups = [tuple(horizons)] if strategy == "multi_output" else [(h,) for h in horizons]
    out, models = None, {}
    for group in groups:
        windows = sequence_windows(df, length, group, cols, targets, by)
        windows = materialize(window_vectors(windows, cols), "windows")
        for fold in range(split.n_splits):
            train, test = _cut(windows, "sample", F.col("samples"), split, fold)
            for h in group:
                for target in targets:
                    model = fit(linear_window(), labelled(train, target, h))
                    models[target, h] = model
                    scored = predict(
                        model, labelled(test, target, h), "LinearWindow", target, h, fold, by
                    )
                    out = scored if out is None else out.unionByName(scored)
    return out, models


def recursive_tree(
    df: DataFrame,
    model: PipelineModel,
    steps: int,
    max_lag: int = 24,
    windows: Sequence[int] = (6, 12, 24),
    use_time: bool = True,
    exog: Sequence[str] = (),
    freq: str | Frequency = "H",
    by: Sequence[str] = SERIES,
) -> DataFrame:
    """Roll a fitted tree, forest or boosted model forward; see ``forests.recursive_forest``."""
    return recursive_forest(df, flatten(model), steps, max_lag, windows, use_time, exog, freq, by)


def matrix_names(max_lag, windows, use_time=True, exog=()) -> list[str]:
    return feature_names(["P", "Q", *exog], max_lag, windows, use_time)
