"""Whole runs: evaluation of all model families, per imputation strategy."""

from __future__ import annotations

import logging
import time
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field, replace
from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepanel.functions.metrics import DEFAULT_METRICS, eval_metrics
from tidepanel.functions.numbers import rounded
from tidepanel.functions.timeaxis import frequency
from tidepanel.operators import learners, moments
from tidepanel.operators.baselines import (
    baseline_predictions,
    naive_forecast,
    seasonal_naive_forecast,
)
from tidepanel.operators.chunks import SERIES, positions
from tidepanel.operators.features import feature_rows, history_depth, training_matrix
from tidepanel.operators.folds import RollingOrigin
from tidepanel.operators.forecast import last_step, recent_history, recursive_models
from tidepanel.operators.impute import impute
from tidepanel.sources.sinks import exists, materialize, read_results, write_results

log = logging.getLogger(__name__)


@dataclass(frozen=True)
class Evaluation:
    """Settings of one evaluation run."""

    horizons: Sequence[int] = (1, 12, 24)
    targets: Sequence[str] = ("P",)
    split: RollingOrigin = RollingOrigin(100, 3)
    season: int = 24
    max_lag: int = 24
    windows: Sequence[int] = (6, 12, 24)
    use_time: bool = True
    exog: Sequence[str] = ()
    sequence_length: int = 24
    sequence_strategy: str = "multi_output"
    trees: Mapping[str, object] = field(default_factory=dict)
    metrics: Sequence[str] = DEFAULT_METRICS
    freq: str = "H"

    def __post_init__(self):
        if not self.targets:
            raise ValueError("at least one of P and Q must be predicted")


def all_predictions(df: DataFrame, run: Evaluation, by: Sequence[str] = SERIES) -> DataFrame:
    """Out-of-fold predictions of every family for a gridded, imputed panel."""
    return fitted_predictions(df, run, by)[0]


def fitted_predictions(
    df: DataFrame, run: Evaluation, by: Sequence[str] = SERIES
) -> tuple[DataFrame, dict[object, object]]:
    """Predictions, tree models of the last fold by ``(name, target, horizon)``, and window models.

    The window models are a table of one row per series, horizon, fold and target under the
    key ``LinearWindow``.  ``lead`` is the number of rows between the newest model input and the predicted
    row: tree features stop one row earlier than sequence windows.
    """
    models = {}
    df = materialize(df, "panel")
    keep = ["model", *by, "horizon", "fold", "target", "y", "yhat"]
    cols = ["P", "Q", *run.exog]
    depth = history_depth(run.max_lag, run.windows)
    rows = materialize(positions(feature_rows(df, depth, cols, by), by), "samples")
    parts = [
        baseline_predictions(
            rows, run.horizons, run.split, (run.season,), targets=run.targets, by=by
        ).select(*keep, (F.col("horizon") + 1).alias("lead"))
    ]
    if run.trees:
        # features are built once; a horizon's folds end before its targets do
        matrix = training_matrix(
            df, run.max_lag, run.windows, run.horizons, run.targets,
            run.use_time, run.exog, by, run.freq, partial=True,
        )
        matrix = materialize(matrix, "matrix")
        for h in run.horizons:
            scored, trees = learners.evaluate_trees(
                matrix, run.trees, h, run.targets, run.split, by
            )
            models |= {(*key, h): model for key, model in trees.items()}
            parts.append(scored.select(*keep, (F.col("horizon") + 1).alias("lead")))
    scored, models[moments.MODEL] = moments.evaluate_windows(
        df, run.sequence_length, run.horizons, run.sequence_strategy, cols, run.targets, run.split, by=by
    )
    parts.append(scored.select(*keep, F.col("horizon").alias("lead")))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out, models


def best_model_forecast(
    df: DataFrame, run: Evaluation, steps: int = 72, by: Sequence[str] = SERIES
) -> DataFrame:
    """Evaluate all families one row ahead, roll the one with the least RMSE for P forward.

    What is rolled has learned from the whole history: a window model of each series' own,
    or the tree ensemble fitted again on all rows.  Result: ``model, by..., step, ts, yhat``.
    """
    run = replace(run, horizons=(1,), targets=("P",))
    scored, models = fitted_predictions(df, run, by)
    errors = eval_metrics(scored, ("model",), ("RMSE",)).where(
        F.col("RMSE").isNotNull() & ~F.isnan("RMSE")
    )
    found = errors.orderBy("RMSE", "model").first()
    if found is None:
        raise ValueError("no model could be scored")
    best, freq, cols = found["model"], frequency(run.freq), ["P", "Q", *run.exog]
    if best == moments.MODEL:
        history = recent_history(df.dropna(subset=cols), run.sequence_length, cols, by)
        whole = models[best].where(F.col("fold") == run.split.n_splits)
        out = recursive_models(history, whole, run.sequence_length, steps, cols, freq, by)
    elif best in run.trees:
        matrix = training_matrix(
            df, run.max_lag, run.windows, (1,), ("P",), run.use_time, run.exog, by, run.freq
        )
        model = learners.fit(run.trees[best], learners.labelled(materialize(matrix, "history"), "P", 1))
        out = learners.recursive_tree(
            df, model, steps, run.max_lag, run.windows, run.use_time, run.exog, freq, by
        )
    else:
        rows = df.dropna(subset=cols)
        if best == "Naive":
            copied = naive_forecast(rows, steps, by=by)
        else:
            copied = seasonal_naive_forecast(rows, run.season, steps, rule="wrapped", by=by)
        at = freq.stamp(F.col("k") + F.col("step"))
        out = copied.join(last_step(rows, by), list(by)).select(
            *by, "step", at.alias("ts"), rounded("P_hat", 2).alias("yhat")
        )
    return out.select(F.lit(best).alias("model"), *by, "step", "ts", "yhat")


def run_evaluation(df: DataFrame, run: Evaluation, by: Sequence[str] = SERIES) -> DataFrame:
    """Results table of all families, scored by a single aggregate."""
    scored = all_predictions(df, run, by)
    return eval_metrics(scored, ("model", "horizon", "lead", "fold", "target"), run.metrics)


STATUS = "strategy string, state string, attempts int, started timestamp, seconds double, rows long, error string"


def read_status(spark, path: str) -> DataFrame:
    """One row per strategy tried under ``path``: the newest attempt."""
    return spark.read.schema(STATUS).json(f"{path}/status/*")


def run_strategies(
    grid: DataFrame,
    strategies: Sequence[str],
    run: Evaluation | Callable[[DataFrame], DataFrame],
    path: str,
    options: Mapping[str, dict] | None = None,
) -> dict[str, str]:
    """Evaluate every imputation strategy and write its results under ``path``.

    ``run`` is an evaluation, or a function of the filled panel.  Each strategy commits its
    own partition and a status row; a failing one does not stop the others and its error is
    returned by name.  A second run under the same path skips what is done and tries again
    what failed.  ``read_results(f"{path}/results")`` reads all results with the column
    ``strategy``, ``read_status`` the status rows.
    """
    spark, failed = grid.sparkSession, {}
    evaluate = (lambda filled: run_evaluation(filled, run)) if isinstance(run, Evaluation) else run
    freq = getattr(run, "freq", "H")
    cols = ("P", "Q", *getattr(run, "exog", ()))
    known = {}
    if exists(spark, f"{path}/status"):
        known = {r["strategy"]: r for r in read_status(spark, path).collect()}  # a row per strategy
    for name in strategies:
        before = known.get(name)
        if before is not None and before["state"] == "done":
            continue
        started, clock, error, rows = datetime.now(), time.perf_counter(), None, None
        try:
            own = {"freq": freq} if name == "day_copy" else {}
            own |= (options or {}).get(name, {})
            filled = impute(grid, name, cols, **own)
            target = f"{path}/results/strategy={name}"
            write_results(evaluate(filled), target, partition_by=())
            rows = read_results(spark, target).count()
        except Exception as caught:  # noqa: BLE001  strategies are independent of each other
            log.warning("strategy %s failed: %s", name, caught)
            error = failed[name] = str(caught)
        row = (
            name, "failed" if error else "done", (before["attempts"] if before else 0) + 1, started,
            time.perf_counter() - clock, rows, error,
        )
        status = spark.createDataFrame([row], STATUS).coalesce(1)
        status.write.mode("overwrite").json(f"{path}/status/{name}")
    return failed
