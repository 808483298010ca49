"""Naive and seasonal-naive forecasts, and the one-lag linear forecaster.

A baseline forecast is a copy of one earlier row.  Its position is arithmetic on
the fold settings, so only the test rows are expanded and one equi-join on
``(series, position)`` fetches the values.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidepanel.operators.chunks import SERIES, halo, owned, positions, within_chunk
from tidepanel.operators.folds import RollingOrigin

PREDICTION = ("model", "horizon", "fold", "target")


def seasonal_source(
    train_end: Column, season: Column | int, horizon: Column | int, i: Column, rule: str
) -> Column:
    """Training position copied for the ``i``-th forecast.

    ``rule="wrapped"`` counts on from one season before the end and wraps at the end
    of the training part to its oldest row.  ``rule="textbook"`` repeats the last
    season; with less history than one season it falls back to ``i`` modulo length.
    """
    season = season if isinstance(season, Column) else F.lit(season)
    start = train_end - season + horizon - 1 + i
    if rule == "wrapped":
        return F.pmod(start, train_end)
    if rule != "textbook":
        raise ValueError(f"Unknown rule {rule!r}; choose wrapped or textbook")
    over = F.greatest(F.lit(0), start - train_end)
    back = F.when(
        start >= train_end, start - season * (F.floor(over / season) + 1)
    ).otherwise(start)
    return F.when(back < 0, F.pmod(i, train_end)).otherwise(back)


def _fetch(asked: DataFrame, rows: DataFrame, cols: Sequence[str], by: Sequence[str]) -> DataFrame:
    """Join ``{c}_hat`` at position ``src`` of the same series."""
    source = rows.select(*by, F.col("rn").alias("src"), *[F.col(c).alias(f"{c}_hat") for c in cols])
    return asked.join(source, [*by, "src"])


def _melt(df: DataFrame, keep: Sequence[str], targets: Sequence[str]) -> DataFrame:
    cells = [
        F.struct(
            F.lit(t).alias("target"), F.col(f"{t}_true").alias("y"), F.col(f"{t}_hat").alias("yhat")
        )
        for t in targets
    ]
    return df.select(*keep, F.inline(F.array(*cells)))


def naive_forecast(
    rows: DataFrame, steps: int, targets: Sequence[str] = ("P",), by: Sequence[str] = SERIES
) -> DataFrame:
    """``by..., step, {target}_hat``: the last row of each series repeated ``steps`` times."""
    # one value column each: a struct would make the aggregate sort its rows
    last = rows.groupBy(*by).agg(*[F.max_by(t, "k").alias(f"{t}_hat") for t in targets])
    step = F.explode(F.sequence(F.lit(1), F.lit(steps)))
    return last.select(*by, step.alias("step"), *[f"{t}_hat" for t in targets])


def seasonal_naive_forecast(
    rows: DataFrame,
    season: int,
    steps: int,
    horizon: int = 1,
    rule: str = "textbook",
    targets: Sequence[str] = ("P",),
    by: Sequence[str] = SERIES,
) -> DataFrame:
    """``by..., step, {target}_hat`` by repeating the last season of each series."""
    ranked = positions(rows, by)
    last = ranked.where(F.col("rn") == F.col("n") - 1).select(*by, "n")
    asked = last.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(steps))))
    i = F.col("step") - 1
    asked = asked.withColumn("src", seasonal_source(F.col("n"), season, horizon, i, rule))
    # only the last season or, after wrapping, the first `steps` rows can be asked for
    near = (F.col("rn") >= F.col("n") - season) | (F.col("rn") < steps + horizon)
    out = _fetch(asked, ranked.where(near), targets, by)
    return out.select(*by, "step", *[f"{t}_hat" for t in targets])


def baseline_predictions(
    rows: DataFrame,
    horizons: Sequence[int] = (1,),
    split: RollingOrigin = RollingOrigin(100, 3),
    seasons: Sequence[int] = (24,),
    rule: str = "wrapped",
    targets: Sequence[str] = ("P",),
    by: Sequence[str] = SERIES,
    naive: bool = True,
) -> DataFrame:
    """Out-of-fold forecasts of all baselines and horizons in one plan.

    ``rows`` are the complete rows of each series.  A sample at position j has the
    value h rows later as its actual, so a series of n rows has n - h samples.
    Result: ``by..., model, season, horizon, fold, target, k, y, yhat``.
    """
    ranked = rows if {"rn", "n"} <= set(rows.columns) else positions(rows, by)
    n, rn, fold = F.col("n"), F.col("rn"), F.col("fold")
    longest = max(horizons)
    tested = split.test_window * split.n_splits
    # the actuals of every horizon are the last `tested` rows of the series
    actual = (
        ranked.where(split.usable(n - longest))
        .where(rn >= n - tested)
        .withColumn("fold", F.floor((rn - (n - tested)) / split.test_window).cast("int"))
        .withColumn("horizon", F.explode(F.array(*[F.lit(h) for h in horizons])))
    )
    end = split.train_end(n - F.col("horizon"), fold)
    i = F.pmod(rn - (n - tested), F.lit(split.test_window))
    choices = []
    if naive:
        choices.append(
            F.struct(
                F.lit("Naive").alias("model"),
                F.lit(None).cast("int").alias("season"),
                (end - 1).alias("src"),
            )
        )
    for m in seasons:
        choices.append(
            F.struct(
                F.lit("SeasonalNaive").alias("model"),
                F.lit(m).alias("season"),
                seasonal_source(end, m, F.col("horizon"), i, rule).cast("bigint").alias("src"),
            )
        )
    asked = actual.select(
        *by,
        "k",
        "horizon",
        "fold",
        *[F.col(t).alias(f"{t}_true") for t in targets],
        F.inline(F.array(*choices)),
    )
    # sources lie in the last seasons before the tests or, after wrapping, at the very start
    reach = tested + split.gap + longest + max([1, *seasons])
    near = (rn >= n - reach) | (rn < split.test_window + longest)
    found = _fetch(asked, ranked.where(near), targets, by)
    return _melt(found, [*by, "model", "season", "horizon", "fold", "k"], targets)


def linear_lag_predictions(
    rows: DataFrame,
    horizons: Sequence[int] = (1,),
    split: RollingOrigin = RollingOrigin(100, 3),
    target: str = "P",
    by: Sequence[str] = SERIES,
) -> DataFrame:
    """Least squares of ``y(t+h)`` on ``y(t)`` per series, horizon and fold.

    A series that is constant in training predicts its mean.  The training parts are nested, so every sample is counted once in the first
    fold that trains on it and the folds are running sums over at most
    ``n_splits`` rows per series.  Result as ``baseline_predictions``.
    """
    ranked = rows if {"rn", "n"} <= set(rows.columns) else positions(rows, by)
    ranked = ranked.where(split.usable(F.col("n") - max(horizons)))
    order = within_chunk(by).orderBy("rn")
    ahead = {f"_y{h}": F.lead(target, h).over(order) for h in horizons}
    times = {f"_k{h}": F.lead("k", h).over(order) for h in horizons}
    wide = owned(
        halo(ranked, after=max(horizons), position="rn", by=by).withColumns(ahead | times), "rn"
    )
    cells = [
        F.struct(F.lit(h).alias("horizon"), F.col(f"_y{h}").alias("y"), F.col(f"_k{h}").alias("k"))
        for h in horizons
    ]
    samples = wide.select(
        *by, "rn", "n", F.col(target).alias("x"), F.inline(F.array(*cells))
    ).where(F.col("rn") + F.col("horizon") < F.col("n"))
    count = F.col("n") - F.col("horizon")
    first = split.first_train(count)
    # fold in which the sample is first part of the training rows
    enters = F.greatest(F.lit(0), F.floor((F.col("rn") - first) / split.test_window) + 1)
    train = samples.withColumn("fold", enters.cast("int")).where(
        F.col("fold") < split.n_splits
    )
    x, y = F.col("x"), F.col("y")
    moments = train.groupBy(*by, "horizon", "fold").agg(
        F.count(F.lit(1)).cast("double").alias("m"),
        F.avg(x).alias("mx"),
        F.avg(y).alias("my"),
        F.var_pop(x).alias("vx"),
        F.covar_pop(x, y).alias("vxy"),
    )
    upto = (
        Window.partitionBy(*by, "horizon")
        .orderBy("fold")
        .rowsBetween(Window.unboundedPreceding, 0)
    )
    # sums about the first fold's means: a high level of the series does not cancel digits
    m, dx, dy = F.col("m"), F.col("mx") - F.col("cx"), F.col("my") - F.col("cy")
    parts = {
        "m": m,
        "sx": m * dx,
        "sy": m * dy,
        "sxx": m * (F.col("vx") + dx * dx),
        "sxy": m * (F.col("vxy") + dx * dy),
    }
    sums = moments.withColumns(
        {"cx": F.first("mx").over(upto), "cy": F.first("my").over(upto)}
    ).withColumns(parts)
    sums = sums.withColumns({p: F.sum(p).over(upto) for p in parts})
    spread = F.col("m") * F.col("sxx") - F.col("sx") * F.col("sx")
    flat = spread <= F.pow(F.col("m") * F.abs("cx") * 1e-13, 2)  # constant but for rounding
    slope = F.when(flat, F.lit(0.0)).otherwise(
        F.try_divide(F.col("m") * F.col("sxy") - F.col("sx") * F.col("sy"), spread)
    )
    fitted = sums.withColumn("slope", slope).withColumn(
        "level", F.col("cy") + (F.col("sy") - F.col("slope") * F.col("sx")) / F.col("m")
    )
    test = samples.withColumn("fold", split.test_fold(F.col("rn"), count)).where(
        F.col("fold").isNotNull()
    )
    scored = test.join(
        fitted.select(*by, "horizon", "fold", "slope", "level", "cx"), [*by, "horizon", "fold"]
    )
    return scored.select(
        *by,
        F.lit("LinearLag").alias("model"),
        F.lit(None).cast("int").alias("season"),
        "horizon",
        "fold",
        "k",
        F.lit(target).alias("target"),
        "y",
        (F.col("level") + F.col("slope") * (x - F.col("cx"))).alias("yhat"),
    )
