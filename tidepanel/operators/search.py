"""Parameter search: trial tables, closed-form trials and the best trial."""

from __future__ import annotations

import logging
import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidepanel.functions.metrics import eval_metrics
from tidepanel.functions.numbers import uniform as draw
from tidepanel.operators.baselines import baseline_predictions
from tidepanel.operators.chunks import SERIES
from tidepanel.operators.folds import RollingOrigin
from tidepanel.sources.sinks import materialize

log = logging.getLogger(__name__)


def grid_space(
    base: DataFrame, values: Mapping[str, Sequence], constraint: Column | None = None
) -> DataFrame:
    """Every combination of the value lists for each row of ``base``."""
    out = base
    for name, options in values.items():
        out = out.withColumn(name, F.explode(F.array(*[F.lit(v) for v in options])))
    return out if constraint is None else out.where(constraint)


def uniform(low: float, high: float, seed: int, keys: Sequence[str] = ("trial",)) -> Column:
    """Draw per row of ``keys``, whatever the partitions."""
    return F.lit(low) + draw(seed, *keys) * (high - low)


def log_uniform(low: float, high: float, seed: int, keys: Sequence[str] = ("trial",)) -> Column:
    span = F.log(F.lit(high)) - F.log(F.lit(low))
    return F.exp(uniform(0.0, 1.0, seed, keys) * span + F.log(F.lit(low)))


def random_space(
    base: DataFrame,
    trials: int,
    choices: Mapping[str, Sequence] | None = None,
    ranges: Mapping[str, Column] | None = None,
    seed: int = 42,
) -> DataFrame:
    """``trials`` random draws per row of ``base``: list choices and continuous ranges."""
    out = base.withColumn("trial", F.explode(F.sequence(F.lit(0), F.lit(trials - 1))))
    for i, (name, options) in enumerate((choices or {}).items()):
        at = F.floor(draw(seed + i, *base.columns, "trial") * len(options)).cast("int") + 1
        out = out.withColumn(name, F.element_at(F.array(*[F.lit(v) for v in options]), at))
    return out.withColumns(dict(ranges or {}))


def radical_inverse(index: Column, base: int) -> Column:
    """The index mirrored at the point in ``base``: a low-discrepancy number in [0, 1).

    Digits are added up as integers and divided once, so every engine gets the same bits.
    Exact for indices below 2**31.
    """
    digits = 1
    while base**digits < 1 << 31:
        digits += 1
    index = index.cast("bigint")
    mirrored = [
        F.pmod(F.floor(index / F.lit(base**k)), F.lit(base)) * F.lit(base ** (digits - 1 - k))
        for k in range(digits)
    ]
    total = mirrored[0]
    for term in mirrored[1:]:
        total = total + term
    return total / F.lit(float(base**digits))


@dataclass(frozen=True)
class Range:
    """A continuous parameter; ``log`` spreads it evenly over orders of magnitude."""

    low: float
    high: float
    log: bool = False

    def at(self, u: Column) -> Column:
        if not self.log:
            return F.lit(self.low) + u * (self.high - self.low)
        return F.exp(F.lit(math.log(self.low)) + u * (math.log(self.high) - math.log(self.low)))


#: Bases of the sequence, one per parameter.
PRIMES = (2, 3, 5, 7, 11, 13, 17, 19, 23, 29)


def sequence_space(
    base: DataFrame,
    trials: int,
    values: Mapping[str, Sequence | Range],
    constraint: Column | None = None,
    proposals: int | None = None,
    start: int = 1,
) -> DataFrame:
    """``trials`` points of a Halton sequence for each row of ``base``: ``trial, parameters...``.

    Points that break the ``constraint`` are passed over, so trials are numbered among the
    accepted ones.  ``proposals`` bounds how far the sequence is searched (8 times the
    trials); too few accepted ones raise.  Nothing is drawn: the same call gives the same
    trials on every cluster.
    """
    if len(values) > len(PRIMES):
        raise ValueError(f"at most {len(PRIMES)} parameters")
    proposals = proposals or 8 * trials
    out = base.withColumn("_i", F.explode(F.sequence(F.lit(start), F.lit(start + proposals - 1))))
    for (name, options), prime in zip(values.items(), PRIMES):
        u = radical_inverse(F.col("_i"), prime)
        if isinstance(options, Range):
            value = options.at(u)
        else:
            listed = F.array(*[F.lit(v) for v in options])
            value = F.element_at(listed, F.floor(u * len(options)).cast("int") + 1)
        out = out.withColumn(name, value)
    out = out.withColumn("_ok", F.lit(True) if constraint is None else F.coalesce(constraint, F.lit(False)))
    mine = Window.partitionBy(*base.columns)  # at most ``proposals`` rows
    upto = mine.orderBy("_i").rowsBetween(Window.unboundedPreceding, 0)
    out = out.withColumns(
        {"trial": (F.count_if("_ok").over(upto) - 1).cast("int"), "_n": F.count_if("_ok").over(mine)}
    )
    message = F.format_string(f"only %s of {trials} trials within {proposals} proposals", F.col("_n"))
    enough = F.when(F.col("_n") >= trials, F.lit(True)).otherwise(F.raise_error(message).cast("boolean"))
    return out.where(enough).where(F.col("_ok") & (F.col("trial") < trials)).select(*base.columns, "trial", *values)


def search_seasonal_length(
    rows: DataFrame,
    seasons: Sequence[int],
    horizons: Sequence[int] = (1,),
    split: RollingOrigin = RollingOrigin(100, 1),
    rule: str = "textbook",
    by: Sequence[str] = SERIES,
) -> DataFrame:
    """Score every season length on the same folds, all trials in one plan."""
    scored = baseline_predictions(rows, horizons, split, seasons, rule, by=by, naive=False)
    return eval_metrics(scored, by=[*by, "season"])


def best_trial(
    trials: DataFrame,
    param: str,
    goal: str = "ACC_10",
    pass_mark: float = 80.0,
    by: Sequence[str] = SERIES,
) -> DataFrame:
    """Trial with the highest goal, the smaller parameter on ties; failed trials score 0."""
    score = F.coalesce(F.col(goal), F.lit(0.0))
    best = F.max_by(F.struct(param, score.alias("score")), F.struct(score, -F.col(param)))
    return trials.groupBy(*by).agg(best.alias("b"), F.count(F.lit(1)).alias("trials")).select(
        *by,
        "trials",
        F.col(f"b.{param}").alias(param),
        F.col("b.score").alias("score"),
        (F.col("b.score") >= pass_mark).alias("passed"),
    )


def search_trees(
    matrix: DataFrame,
    trials: Sequence[Mapping[str, object]],
    build,
    horizon: int = 1,
    target: str = "P",
    split: RollingOrigin = RollingOrigin(100, 1),
    by: Sequence[str] = SERIES,
) -> DataFrame:
    """Fit and score one model per parameter set on the given folds.

    ``build(**params)`` makes the estimator.  A failed trial has NULL errors, accuracies
    of 0 and ``failed``.  Result: ``trial, params, RMSE, MAE, ACC_5, ACC_10, failed``.
    """
    from tidepanel.operators.learners import evaluate_trees

    scored = None
    for i, params in enumerate(trials):
        try:
            part, _ = evaluate_trees(matrix, {str(i): build(**params)}, horizon, [target], split, by)
            part = materialize(part, "trial")  # what fails while scoring is caught as well
        except Exception as error:  # noqa: BLE001  a failed trial is a bad trial
            log.warning("trial %s failed: %s", i, error)
            continue
        scored = part if scored is None else scored.unionByName(part)
    spark = matrix.sparkSession
    listed = spark.createDataFrame(
        [(i, {k: float(v) for k, v in p.items()}) for i, p in enumerate(trials)],
        "trial int, params map<string,double>",
    )
    names = ["RMSE", "MAE", "ACC_5", "ACC_10"]
    if scored is None:
        nothing = {m: F.lit(None if m in ("RMSE", "MAE") else 0.0).cast("double") for m in names}
        return listed.withColumns(nothing | {"failed": F.lit(True)})
    scores = eval_metrics(
        scored.withColumn("trial", F.col("model").cast("int")), ["trial"], names
    ).withColumn("failed", F.lit(False))
    return listed.join(scores, "trial", "left").fillna({"ACC_5": 0.0, "ACC_10": 0.0, "failed": True})
