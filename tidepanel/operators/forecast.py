"""Forecasts beyond the end of the data.

A recursion is sequential in time and independent between series.  Each series is
one row with a short history array, and the steps are a fold over that row.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidepanel.functions.numbers import normal, rounded
from tidepanel.functions.timeaxis import Frequency, frequency
from tidepanel.operators.chunks import SERIES, positions


def forecast_spine(
    last: DataFrame, freq: str | Frequency = "H", days: int = 3, by: Sequence[str] = SERIES
) -> DataFrame:
    """Forecast dates ``by..., step, ts``: ``days`` whole days after the last ``k``."""
    freq = frequency(freq)
    steps = freq.steps_per_days(days)
    step = F.explode(F.sequence(F.lit(1), F.lit(steps)))
    return last.select(*by, "k", step.alias("step")).select(
        *by, "step", freq.stamp(F.col("k") + F.col("step")).alias("ts")
    )


def date_spine(
    df: DataFrame, start: Column, end: Column, freq: str | Frequency = "H"
) -> DataFrame:
    """Explicit range: every step from ``start`` to the end of the day ``end``."""
    freq = frequency(freq)
    day_after = F.date_add(end.cast("date"), 1).cast("timestamp_ntz")
    first, stop = freq.index(start), freq.index(day_after)
    return df.withColumn("k", F.explode(F.sequence(first, stop - 1))).withColumn(
        "ts", freq.stamp(F.col("k"))
    )


def last_step(grid: DataFrame, by: Sequence[str] = SERIES) -> DataFrame:
    return grid.groupBy(*by).agg(F.max("k").alias("k"))


def recent_history(
    rows: DataFrame,
    length: int,
    cols: Sequence[str] = ("P", "Q"),
    by: Sequence[str] = SERIES,
    short: str = "error",
) -> DataFrame:
    """One row per series with its last ``length`` rows: ``by..., k, {c}_hist`` oldest first.

    ``short`` says what happens to a series with fewer rows: ``"error"`` raises,
    ``"null"`` keeps it with NULL histories (its forecast is NULL at every step),
    ``"skip"`` leaves it out.
    """
    if short not in ("error", "null", "skip"):
        raise ValueError("short must be 'error', 'null' or 'skip'")
    ranked = positions(rows, by).where(F.col("rn") >= F.col("n") - length)
    packed = ranked.groupBy(*by).agg(
        F.array_sort(F.collect_list(F.struct("k", *cols))).alias("_h"), F.max("k").alias("k")
    )
    enough = F.size("_h") == length
    if short == "error":
        message = F.format_string(
            f"Series too short: need {length} rows, got %s", F.size("_h").cast("string")
        )
        packed = packed.where(
            F.when(enough, F.lit(True)).otherwise(F.raise_error(message).cast("boolean"))
        )
    elif short == "skip":
        packed = packed.where(enough)
    return packed.select(
        *by, "k", *[F.when(enough, F.col(f"_h.{c}")).alias(f"{c}_hist") for c in cols]
    )


Steps = int | Column


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once, however often ``use`` names it."""
    return F.transform(F.array(value), use)[0]


def _rolled(
    history: DataFrame,
    start: Column,
    advance: Callable[[Column, Column], Column],
    steps: Steps,
    skip: Steps,
    freq: str | Frequency,
    by: Sequence[str],
) -> DataFrame:
    """Fold ``advance(window, step)`` over each series: ``by..., step, ts, yhat``.

    The state is a window of fixed length, whose oldest value leaves at every step, and
    the values to show, those after ``skip``.  Both counts may differ by series.
    """
    steps, skip = (x if isinstance(x, Column) else F.lit(x) for x in (steps, skip))
    skip = F.greatest(skip, F.lit(0)).cast("int")
    shown = F.greatest(steps.cast("int") - skip, F.lit(0))
    count = F.when(shown > 0, steps.cast("int")).otherwise(F.lit(0))
    nothing = F.array().cast("array<double>")

    def push(state: Column, step: Column) -> Column:
        return bound(
            advance(state.window, step),
            lambda value: F.struct(
                F.concat(F.slice(state.window, 2, F.size(state.window) - 1), F.array(value)).alias("window"),
                F.when(step > skip, F.concat(state.path, F.array(value))).otherwise(state.path).alias("path"),
            ),
        )

    seed = F.struct(start.cast("array<double>").alias("window"), nothing.alias("path"))
    each = F.when(count > 0, F.sequence(F.lit(1), F.greatest(count, F.lit(1)))).otherwise(
        F.array().cast("array<int>")
    )
    path = F.aggregate(each, seed, push, lambda state: state.path)
    path = F.when(start.isNull(), F.array_repeat(F.lit(None).cast("double"), shown)).otherwise(path)
    out = history.select(*by, "k", skip.alias("_skip"), F.posexplode(path).alias("_i", "yhat"))
    step = F.col("_skip") + F.col("_i") + 1
    return out.select(
        *by, step.alias("step"), frequency(freq).stamp(F.col("k") + step).alias("ts"), "yhat"
    )


def recursive_linear(
    history: DataFrame,
    weights: Sequence[float],
    steps: Steps,
    intercept: float = 0.0,
    frozen: dict[str, float] | None = None,
    freq: str | Frequency = "H",
    by: Sequence[str] = SERIES,
    skip: Steps = 0,
) -> DataFrame:
    """Roll a linear window model forward; its own output is the newest input.

    ``weights`` apply to the last ``len(weights)`` values of P, oldest first.
    ``frozen`` maps other columns to a weight on their last value, which stays
    constant.  Result: ``by..., step, ts, yhat`` with ``yhat`` rounded to 2 decimals;
    the recursion itself is not rounded.
    """
    coef = F.array(*[F.lit(float(w)) for w in weights])
    length = len(weights)
    constant = F.lit(float(intercept))
    for c, w in (frozen or {}).items():
        constant = constant + F.element_at(f"{c}_hist", -1) * w

    def advance(values: Column, _: Column) -> Column:
        terms = F.zip_with(values, coef, lambda x, w: x * w)
        return F.aggregate(terms, constant, lambda acc, x: acc + x)

    out = _rolled(history, F.slice("P_hist", -length, length), advance, steps, skip, freq, by)
    return out.withColumn("yhat", rounded("yhat", 2))


def recursive_window(
    history: DataFrame,
    weights: Mapping[str, Sequence[float] | Column],
    steps: Steps,
    intercept: float | Column = 0.0,
    freq: str | Frequency = "H",
    by: Sequence[str] = SERIES,
    skip: Steps = 0,
    length: int | None = None,
) -> DataFrame:
    """Roll a linear model over whole windows forward: ``by..., step, ts, yhat``.

    ``weights`` has, for P and every other column, one weight per window row, oldest
    first: numbers for all series, or array columns of each series' own (then ``length``
    says how many).  Each step shifts the window by one row: P enters as forecast, the
    other columns keep their last value.  A series with NULL histories has NULL forecasts.
    """
    given = [w for w in weights.values() if not isinstance(w, Column)]
    length = length or len(given[0])
    if any(len(w) != length for w in given):
        raise ValueError("every column needs one weight per window row")
    coef = {
        c: w if isinstance(w, Column) else F.array(*[F.lit(float(x)) for x in w]) for c, w in weights.items()
    }
    start = intercept if isinstance(intercept, Column) else F.lit(float(intercept))

    def dot(values: Column, column: str, total: Column) -> Column:
        terms = F.zip_with(values, coef[column], lambda x, w: x * w)
        return F.aggregate(terms, total, lambda acc, x: acc + x)

    def recent(c: str) -> Column:
        return F.slice(f"{c}_hist", -length, length)

    # after ``length`` steps only the last value is left in the other windows
    others = {
        c: F.concat(recent(c), F.array_repeat(F.element_at(f"{c}_hist", -1), length))
        for c in weights
        if c != "P"
    }

    def advance(values: Column, step: Column) -> Column:
        total = start
        for c, whole in others.items():
            total = dot(F.slice(whole, F.least(step, F.lit(length + 1)), F.lit(length)), c, total)
        return dot(values, "P", total)

    out = _rolled(history, recent("P"), advance, steps, skip, freq, by)
    return out.withColumn("yhat", rounded("yhat", 2))


def recursive_models(
    history: DataFrame,
    models: DataFrame,
    length: int,
    steps: Steps,
    cols: Sequence[str] = ("P", "Q"),
    freq: str | Frequency = "H",
    by: Sequence[str] = SERIES,
    skip: Steps = 0,
) -> DataFrame:
    """Roll every series forward with its own window model, one row of ``models`` each.

    ``models`` has ``weights`` (oldest row first, columns side by side) and ``intercept``.
    A series without a model has NULL forecasts.
    """

    def every(i: int) -> Column:
        return F.filter("weights", lambda _, at: at % len(cols) == i)

    named = models.select(
        *by, F.col("intercept").alias("_bias"), *[every(i).alias(f"_{c}_weights") for i, c in enumerate(cols)]
    )
    joined = history.join(named, list(by), "left")
    own = {c: F.col(f"_{c}_weights") for c in cols}
    return recursive_window(joined, own, steps, F.col("_bias"), freq, by, skip, length)


def mean_reverting(
    history: DataFrame,
    steps: Steps,
    noise: float = 0.0,
    seed: int = 42,
    freq: str | Frequency = "H",
    by: Sequence[str] = SERIES,
    skip: Steps = 0,
) -> DataFrame:
    """Walk from the last value towards the window mean.

    x1 is the last value, then x = 0.7 x + 0.3 mean + noise * 0.1 * std * N(0, 1).
    Every value is rounded to 2 decimals before it is used again.
    """
    n = F.size("P_hist")
    zero = F.lit(0.0)
    mean = F.aggregate("P_hist", zero, lambda acc, x: acc + x) / n
    df = history.withColumn("_mean", mean)
    square = lambda acc, x: acc + (x - F.col("_mean")) * (x - F.col("_mean"))
    scale = F.sqrt(F.aggregate("P_hist", zero, square) / n) * (0.1 * noise)
    df = df.withColumn("_scale", scale)
    first = rounded(F.element_at("P_hist", -1), 2)

    def advance(values: Column, step: Column) -> Column:
        value = F.element_at(values, -1) * 0.7 + F.col("_mean") * 0.3
        if noise:
            value = value + normal(F.lit(seed) + step - 2, *by, "k") * F.col("_scale")
        value = bound(value, lambda x: rounded(x, 2))
        return F.when(step == 1, F.element_at(values, -1)).otherwise(value)

    start = F.when(F.col("P_hist").isNotNull(), F.array(first))
    return _rolled(df, start, advance, steps, skip, freq, by)


def over_range(
    history: DataFrame,
    roll,
    start: str,
    end: str,
    freq: str | Frequency = "H",
    by: Sequence[str] = SERIES,
    **options,
) -> DataFrame:
    """A forecaster's steps from the date ``start`` to the end of the date ``end``.

    ``roll(history, steps, freq=..., by=..., skip=...)`` rolls each series over its own
    gap; only a window of fixed length is carried across it, and what lies before
    ``start`` is neither kept nor shown.  ``gap`` is the number of steps between the
    series' last row and ``start``; a series that ends after the range has no rows.
    Result: ``by..., gap, step, ts, yhat``.
    """
    freq = frequency(freq)
    day = lambda text: F.lit(text).cast("date").cast("timestamp_ntz")
    first = freq.index(day(start))
    stop = freq.index(F.date_add(F.lit(end).cast("date"), 1).cast("timestamp_ntz"))
    gap, steps = first - F.col("k") - 1, stop - F.col("k") - 1
    rolled = roll(history, steps, freq=freq, by=by, skip=gap, **options)
    at = freq.index(F.col("ts"))
    # step, time and gap follow from each other, so no join brings the gap back
    return rolled.select(*by, (first - at + F.col("step") - 1).alias("gap"), "step", "ts", "yhat")


def forecast_summary(forecast: DataFrame, by: Sequence[str] = SERIES) -> DataFrame:
    """Range, count and distribution of each series' forecast (a bounded number of steps)."""
    return forecast.groupBy(*by).agg(
        F.min("ts").alias("first_ts"),
        F.max("ts").alias("last_ts"),
        F.count("yhat").alias("n"),
        F.avg("yhat").alias("mean"),
        F.median("yhat").alias("median"),
        F.stddev_samp("yhat").alias("std"),
        F.min("yhat").alias("min"),
        F.max("yhat").alias("max"),
    )


def head_tail(
    rows: DataFrame,
    value: str,
    limit: int = 100,
    edge: int = 50,
    freq: str | Frequency = "H",
    by: Sequence[str] = SERIES,
) -> DataFrame:
    """Whole series up to ``limit`` rows, else its first and last ``edge`` rows, formatted."""
    ranked = positions(rows, by) if "rn" not in rows.columns else rows
    rn, n = F.col("rn"), F.col("n")
    shown = ranked.where((n <= limit) | (rn < edge) | (rn >= n - edge))
    return shown.select(
        *by,
        F.date_format(frequency(freq).stamp(F.col("k")), "yyyy-MM-dd HH:mm").alias("time"),
        rounded(value, 2).alias("value"),
    )
