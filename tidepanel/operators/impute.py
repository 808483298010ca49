"""Missing-value imputation on gridded panels.

Every method takes a frame from ``regular_grid`` and fills the measure columns
independently (``nearest_p`` uses whole donor rows).  Values that are present
never change.  Per-series statistics reach the rows through chunk summaries.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidepanel.functions.timeaxis import frequency
from tidepanel.operators.chunks import (
    SERIES,
    attach,
    halo,
    neighbours,
    owned,
    series_totals,
    spread,
    within_chunk,
)
from tidepanel.operators.grid import lagged_cells
from tidepanel.operators.median import exact_median


def _replace(df: DataFrame, filled: dict[str, Column], spent: Sequence[str]) -> DataFrame:
    return df.withColumns(filled).drop(*spent)


def _sides(cols: Sequence[str]) -> list[str]:
    return [f"{c}__{side}_{part}" for c in cols for side in ("prev", "next") for part in "kv"]


def impute_forward(df, cols=("P", "Q"), by=SERIES, limit: int | None = None) -> DataFrame:
    """Last valid value; leading NULLs stay."""
    wide = neighbours(df, cols, by, following=False)
    filled = {}
    for c in cols:
        value = F.col(f"{c}__prev_v")
        if limit is not None:
            value = F.when(F.col("k") - F.col(f"{c}__prev_k") <= limit, value)
        filled[c] = F.coalesce(c, value)
    return _replace(wide, filled, _sides(cols))


def impute_backward(df, cols=("P", "Q"), by=SERIES, limit: int | None = None) -> DataFrame:
    """Next valid value; trailing NULLs stay."""
    wide = neighbours(df, cols, by, previous=False)
    filled = {}
    for c in cols:
        value = F.col(f"{c}__next_v")
        if limit is not None:
            value = F.when(F.col(f"{c}__next_k") - F.col("k") <= limit, value)
        filled[c] = F.coalesce(c, value)
    return _replace(wide, filled, _sides(cols))


def _between(c: str, both: bool) -> Column:
    low, high = F.col(f"{c}__prev_k"), F.col(f"{c}__next_k")
    left, right = F.col(f"{c}__prev_v"), F.col(f"{c}__next_v")
    line = F.when(high > low, left + (right - left) * ((F.col("k") - low) / (high - low)))
    return F.coalesce(F.col(c), line, left, *([right] if both else []))


def impute_interpolate(
    df, cols=("P", "Q"), by=SERIES, both: bool = False, limit: int | None = None
) -> DataFrame:
    """Straight line between valid neighbours; trailing NULLs take the last value.

    Leading NULLs stay unless ``both`` is set.
    """
    wide = neighbours(df, cols, by)
    filled = {}
    for c in cols:
        value = _between(c, both)
        if limit is not None:
            near = F.col("k") - F.col(f"{c}__prev_k") <= limit
            if both:
                near = near | (F.col(f"{c}__next_k") - F.col("k") <= limit)
            value = F.coalesce(F.col(c), F.when(near, value))
        filled[c] = value
    return _replace(wide, filled, _sides(cols))


def impute_mean(df, cols=("P", "Q"), by=SERIES) -> DataFrame:
    """Mean of the present values; an all-NULL series stays NULL."""
    partial, total, filled = {}, {}, {}
    for c in cols:
        partial |= {f"{c}__s": F.sum(c), f"{c}__n": F.count(c)}
        total |= {f"{c}__s": F.sum(f"{c}__s"), f"{c}__n": F.sum(f"{c}__n")}
        filled[c] = F.coalesce(F.col(c), F.try_divide(f"{c}__s", f"{c}__n"))
    wide = attach(df, series_totals(df, partial, total, by), by)
    return _replace(wide, filled, list(partial))


def impute_median(df, cols=("P", "Q"), by=SERIES) -> DataFrame:
    """Exact median, the mid-point for an even count."""
    wide = spread(df, exact_median(df, cols, by), by)
    filled = {c: F.coalesce(c, f"{c}__median") for c in cols}
    return _replace(wide, filled, [f"{c}__median" for c in cols])


def impute_day_copy(df, cols=("P", "Q"), by=SERIES, days_back: int = 7, *, freq) -> DataFrame:
    """Value of the same clock time ``days_back`` days earlier, taken from the input only.

    ``freq`` is that of the grid: a number of days is so many steps of it.
    """
    wide = lagged_cells(df, cols, frequency(freq).steps_per_days(days_back), by)
    filled = {c: F.coalesce(c, f"{c}__lag") for c in cols}
    return _replace(wide, filled, [f"{c}__lag" for c in cols])


def impute_nearest_p(df, cols=("P", "Q"), by=SERIES, target_p: float = 280.0) -> DataFrame:
    """Fill from the complete row whose P is nearest ``target_p``, the earliest on ties."""
    complete = F.lit(True)
    for c in cols:
        complete = complete & F.col(c).isNotNull()
    offer = F.struct(F.abs(F.col("P") - target_p).alias("d"), "k", *cols)
    edge = series_totals(
        df, {"_best": F.min(F.when(complete, offer))}, {"_donor": F.min("_best")}, by
    )
    filled = {c: F.coalesce(c, F.col(f"_donor.{c}")) for c in cols}
    return _replace(attach(df, edge, by), filled, ["_donor"])


def seasonal_decompose(
    df, cols=("P", "Q"), by=SERIES, period: int = 24
) -> DataFrame:
    """Additive decomposition of the series after filling gaps from both sides.

    Adds ``{c}__fill``, ``{c}__trend`` (centred moving average over one period),
    ``{c}__seasonal`` (mean detrended value per phase, centred), and ``steps``.
    Series shorter than two periods get no trend and no seasonal part.
    """
    wide = neighbours(df, cols, by, extent=True)
    wide = _replace(wide, {f"{c}__fill": _between(c, both=True) for c in cols}, _sides(cols))

    half = period // 2
    order = within_chunk(by).orderBy("k")
    frame = order.rowsBetween(-half, half)
    trend = {}
    for c in cols:
        x = f"{c}__fill"
        total = F.sum(x).over(frame)
        if period % 2 == 0:
            total = total - (F.lag(x, half).over(order) + F.lead(x, half).over(order)) / 2
        full = (F.count(x).over(frame) == 2 * half + 1) & (F.col("steps") >= 2 * period)
        trend[f"{c}__trend"] = F.when(full, total / period)
    rows = owned(halo(wide, half, half, by=by).withColumns(trend))

    phase = F.pmod(F.col("k") - F.col("k0"), F.lit(period)).cast("int")
    # the observed cells are counted too: a shape needs some, and with the measure
    # itself in use this branch reads the same shuffle as the rows do
    per_phase = rows.groupBy(*by, phase.alias("phase")).agg(
        *[F.avg(F.col(f"{c}__fill") - F.col(f"{c}__trend")).alias(c) for c in cols],
        *[F.count(c).alias(f"{c}__seen") for c in cols],
    )
    # one row per series holding `period` phase means per column
    shapes = per_phase.groupBy(*by).agg(
        *[F.sort_array(F.collect_list(F.struct("phase", F.col(c).alias("m")))).alias(f"{c}__shape") for c in cols],
        *[F.when(F.sum(f"{c}__seen") > 0, F.avg(c)).alias(f"{c}__level") for c in cols],
    )
    shapes = shapes.withColumns({f"{c}__shape": F.col(f"{c}__shape.m") for c in cols})
    per_chunk = df.select(*by, "chunk").distinct().join(shapes, list(by))
    seasonal = {
        f"{c}__seasonal": F.get(f"{c}__shape", phase) - F.col(f"{c}__level") for c in cols
    }
    spent = [f"{c}__{x}" for c in cols for x in ("shape", "level")]
    return _replace(attach(rows, per_chunk, by), seasonal, [*spent, "k0"])


def impute_seasonal(
    df, cols=("P", "Q"), by=SERIES, period: int = 24, mode: str = "component"
) -> DataFrame:
    """Fill from the seasonal part; short series get the interpolated value.

    ``mode="component"`` writes the zero-centred seasonal part alone;
    ``mode="level"`` adds the trend back (the interpolated value where the trend
    is undefined).
    """
    if mode not in ("component", "level"):
        raise ValueError(f"Unknown mode {mode!r}; choose component or level")
    wide = seasonal_decompose(df, cols, by, period)
    filled = {}
    for c in cols:
        part = F.col(f"{c}__seasonal")
        if mode == "level":
            part = F.coalesce(F.col(f"{c}__trend") + part, F.col(f"{c}__fill"))
        value = F.when(F.col("steps") >= 2 * period, part).otherwise(F.col(f"{c}__fill"))
        filled[c] = F.coalesce(F.col(c), value)
    spent = [f"{c}__{x}" for c in cols for x in ("fill", "trend", "seasonal")]
    return _replace(wide, filled, [*spent, "steps"])


METHODS: dict[str, Callable[..., DataFrame]] = {
    "forward": impute_forward,
    "backward": impute_backward,
    "interpolate": impute_interpolate,
    "mean": impute_mean,
    "median": impute_median,
    "day_copy": impute_day_copy,
    "seasonal": impute_seasonal,
    "nearest_p": impute_nearest_p,
}


def impute(
    df: DataFrame,
    method: str = "forward",
    cols: Sequence[str] = ("P", "Q"),
    by: Sequence[str] = SERIES,
    keep_raw: bool = False,
    **options,
) -> DataFrame:
    """Fill ``cols`` by the named method; ``keep_raw`` also keeps the input as ``{c}_raw``."""
    if method not in METHODS:
        raise ValueError(f"Unknown imputation method {method!r}; choose from {sorted(METHODS)}")
    if keep_raw:
        df = df.withColumns({f"{c}_raw": F.col(c) for c in cols})
    return METHODS[method](df, cols=cols, by=by, **options)


def impute_diff(filled: DataFrame, cols=("P", "Q"), by=SERIES) -> DataFrame:
    """Before/after summary per series and column, from a frame with ``keep_raw``."""
    pairs = [
        F.struct(F.lit(c).alias("column"), F.col(f"{c}_raw").alias("raw"), F.col(c).alias("val"))
        for c in cols
    ]
    cells = filled.select(*by, F.inline(F.array(*pairs)))
    stats = [
        fn(side).alias(f"{when}_{name}")
        for when, side in (("before", "raw"), ("after", "val"))
        for name, fn in (("min", F.min), ("mean", F.avg), ("max", F.max))
    ]
    was_null = F.col("raw").isNull()
    return cells.groupBy(*by, "column").agg(F.count_if(was_null).alias("was_null"), *stats)


def impute_count(filled: DataFrame, cols=("P", "Q"), by=SERIES) -> DataFrame:
    """Cells filled per column and rows touched, from a frame with ``keep_raw``."""
    hit = {c: F.col(f"{c}_raw").isNull() & F.col(c).isNotNull() for c in cols}
    touched = F.lit(False)
    for c in cols:
        touched = touched | hit[c]
    return filled.groupBy(*by).agg(
        *[F.count_if(h).alias(f"{c}_filled") for c, h in hit.items()],
        F.count_if(touched).alias("rows_filled"),
    )


def impute_each(
    grid: DataFrame,
    methods: Sequence[str],
    cols: Sequence[str] = ("P", "Q"),
    by: Sequence[str] = SERIES,
    options: dict[str, dict] | None = None,
    keep_raw: bool = False,
) -> DataFrame:
    """All strategies side by side, tagged by ``strategy``; one plan for what follows."""
    out = None
    for method in methods:
        filled = impute(grid, method, cols, by, keep_raw, **(options or {}).get(method, {}))
        raw = [f"{c}_raw" for c in cols] if keep_raw else []
        tagged = filled.select(F.lit(method).alias("strategy"), *by, "chunk", "k", *cols, *raw)
        out = tagged if out is None else out.unionByName(tagged)
    return out
