"""Leak-free features: lags, rolling statistics, calendar, windows and targets.

Lag and rolling features look at earlier rows only.  A few of them are explicit
columns; the wide feature matrix keeps one history array per column and slices
it, because the planning cost of hundreds of window expressions dominates.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidepanel.functions.timeaxis import Frequency, calendar_columns, frequency
from tidepanel.operators.chunks import (
    SERIES,
    attach,
    chunk_of,
    halo,
    owned,
    positions,
    within_chunk,
)

_ROLLING_CALLS = {"mean": F.avg, "std": F.stddev_samp, "min": F.min, "max": F.max}
ROLLING = tuple(_ROLLING_CALLS)


def lag_features(
    df: DataFrame,
    max_lag: int = 24,
    cols: Sequence[str] = ("P", "Q"),
    by: Sequence[str] = SERIES,
    lags: Sequence[int] | None = None,
) -> DataFrame:
    """``{c}_lag_{k}`` for k = 1..max_lag (or the given ``lags``) on grid order."""
    lags = list(lags or range(1, max_lag + 1))
    w = within_chunk(by).orderBy("k")
    cells = {f"{c}_lag_{k}": F.lag(c, k).over(w) for c in cols if c in df.columns for k in lags}
    return owned(halo(df, before=max(lags), by=by).withColumns(cells))


def rolling_features(
    df: DataFrame,
    windows: Sequence[int] = (6, 12, 24),
    cols: Sequence[str] = ("P", "Q"),
    by: Sequence[str] = SERIES,
    stats: Sequence[str] = ROLLING,
) -> DataFrame:
    """``{c}_roll_{stat}_{n}`` over the previous ``n`` rows; NULL unless all ``n`` are present."""
    order = within_chunk(by).orderBy("k")
    cells = {}
    for c in (c for c in cols if c in df.columns):
        for n in windows:
            frame = order.rowsBetween(-n, -1)
            full = F.count(c).over(frame) == n
            for stat in stats:
                cells[f"{c}_roll_{stat}_{n}"] = F.when(full, _ROLLING_CALLS[stat](c).over(frame))
    return owned(halo(df, before=max(windows), by=by).withColumns(cells))


def calendar_features(df: DataFrame, freq: str | Frequency = "H") -> DataFrame:
    return df.withColumns(calendar_columns(frequency(freq).stamp(F.col("k"))))


def _mean_std(values: Column, n: int) -> Column:
    """``array(mean, sample deviation)`` in one pass; the lambda closes over no array."""

    def update(acc: Column, x: Column) -> Column:
        mean = acc.mean + (x - acc.mean) / (acc.n + 1)
        return F.struct(
            (acc.n + 1).alias("n"),
            mean.alias("mean"),
            (acc.m2 + (x - acc.mean) * (x - mean)).alias("m2"),
        )

    zero = F.struct(*[F.lit(0.0).alias(name) for name in ("n", "mean", "m2")])
    std = lambda acc: F.sqrt(acc.m2 / (n - 1)) if n > 1 else F.lit(None).cast("double")
    return F.aggregate(values, zero, update, lambda acc: F.array(acc.mean, std(acc)))


def feature_names(
    cols: Sequence[str], max_lag: int, windows: Sequence[int], use_time: bool = True
) -> list[str]:
    """Names in the order ``history_vector`` lays the features out."""
    names = [f"{c}_lag_{k}" for c in cols for k in range(1, max_lag + 1)]
    names += [f"{c}_roll_{s}_{n}" for c in cols for n in windows for s in ROLLING]
    return names + (list(calendar_columns(F.lit(None))) if use_time else [])


def history_depth(max_lag: int, windows: Sequence[int]) -> int:
    return max([max_lag, *windows])


def history_vector(
    history: dict[str, Column],
    ts: Column,
    max_lag: int,
    windows: Sequence[int],
    use_time: bool = True,
    rolling: dict[tuple[str, int], Column] | None = None,
) -> Column:
    """Feature array from one ascending array of the previous values per column.

    Each array holds exactly ``history_depth`` values, the newest last.  ``rolling``
    supplies ready-made rolling statistics; without it they are computed from the
    arrays.
    """
    depth = history_depth(max_lag, windows)
    blocks = [F.reverse(F.slice(h, depth - max_lag + 1, max_lag)) for h in history.values()]
    for c, h in history.items():
        for n in windows:
            if rolling is not None:
                blocks.append(rolling[c, n])
                continue
            tail = F.slice(h, depth - n + 1, n)
            blocks += [_mean_std(tail, n), F.array(F.array_min(tail), F.array_max(tail))]
    if use_time:
        blocks.append(F.array(*calendar_columns(ts).values()))
    return F.concat(*blocks)


def feature_matrix(
    df: DataFrame,
    max_lag: int = 24,
    windows: Sequence[int] = (6, 12, 24),
    use_time: bool = True,
    exog: Sequence[str] = (),
    by: Sequence[str] = SERIES,
    freq: str | Frequency = "H",
    keep: Sequence[str] = (),
) -> DataFrame:
    """Feature array plus targets: ``by..., chunk, k, P, Q, keep..., features``.

    Same-time values never enter the features.  Rows with a NULL in any feature
    or target are dropped: the history is complete exactly when the collected
    array, which skips NULLs, has full length.
    """
    cols = ["P", "Q", *[c for c in exog if c in df.columns]]
    depth = history_depth(max_lag, windows)
    order = within_chunk(by).orderBy("k")
    frame = order.rowsBetween(-depth, -1)
    cells = {f"{c}__hist": F.collect_list(c).over(frame) for c in cols}
    # incremental window aggregates are several times faster than folding the arrays
    for n in windows:
        past = order.rowsBetween(-n, -1)
        for stat, fn in _ROLLING_CALLS.items():
            cells |= {f"{c}__{stat}_{n}": fn(c).over(past) for c in cols}
    wide = halo(df.select(*by, "chunk", "k", *cols, *keep), before=depth, by=by)
    wide = owned(wide.withColumns(cells))
    complete = F.col("P").isNotNull() & F.col("Q").isNotNull()
    for c in cols:
        complete = complete & (F.size(f"{c}__hist") == depth)
    ts = frequency(freq).stamp(F.col("k"))
    history = {c: F.col(f"{c}__hist") for c in cols}
    rolling = {
        (c, n): F.array(*[F.col(f"{c}__{stat}_{n}") for stat in ROLLING])
        for c in cols
        for n in windows
    }
    vector = history_vector(history, ts, max_lag, windows, use_time, rolling)
    outputs = [*by, "chunk", "k", "P", "Q", *keep]
    return wide.where(complete).select(*outputs, vector.alias("features"))


def feature_rows(
    df: DataFrame,
    depth: int = 24,
    cols: Sequence[str] = ("P", "Q"),
    by: Sequence[str] = SERIES,
) -> DataFrame:
    """The rows ``feature_matrix`` keeps, without building the features.

    A row stays when it and the ``depth`` rows before it are complete.
    """
    frame = within_chunk(by).orderBy("k").rowsBetween(-depth, 0)
    full = F.lit(True)
    for c in cols:
        full = full & (F.count(c).over(frame) == depth + 1)
    wide = owned(halo(df, before=depth, by=by).withColumn("_full", full))
    return wide.where("_full").drop("_full")


def islands(df: DataFrame, cols: Sequence[str] = ("P", "Q"), by: Sequence[str] = SERIES) -> DataFrame:
    """Complete rows with ``island``, the first step of the run of successive steps they are in.

    Operators called with ``by=(*by, "island")`` look at one island only: windows, targets and
    baselines then never reach across a gap in time.  A run that crosses chunks is found over
    chunk summaries: a chunk whose first step follows the last step before it goes on with
    that chunk's last run.
    """
    rows = complete_rows(df, cols)
    order = within_chunk(by).orderBy("k")
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    opens = F.lag("k").over(order).isNull() | (F.col("k") - F.lag("k").over(order) > 1)
    marked = rows.withColumn("_own", F.max(F.when(opens, F.col("k"))).over(upto))
    edge = marked.groupBy(*by, "chunk").agg(
        F.min("k").alias("_first"), F.max("k").alias("_last"), F.max("_own").alias("_tail")
    )
    chunks = Window.partitionBy(*by).orderBy("chunk")
    joins = F.col("_first") - F.lag("_last").over(chunks) == 1
    # a chunk that is one run and goes on has no run of its own to hand down
    edge = edge.withColumn("_joins", F.coalesce(joins, F.lit(False)))
    fresh = F.when(~(F.col("_joins") & (F.col("_tail") == F.col("_first"))), F.col("_tail"))
    edge = edge.withColumn("_fresh", fresh)
    before = F.last("_fresh", True).over(chunks.rowsBetween(Window.unboundedPreceding, -1))
    head = F.when(F.col("_joins"), before).otherwise(F.col("_first"))
    edge = edge.withColumn("_head", head).select(*by, "chunk", "_first", "_head")
    found = attach(marked, edge, by)
    island = F.when(F.col("_own") == F.col("_first"), F.col("_head")).otherwise(F.col("_own"))
    return found.withColumn("island", island).drop("_own", "_first", "_head")


def complete_rows(df: DataFrame, cols: Sequence[str] = ("P", "Q")) -> DataFrame:
    return df.dropna(subset=list(cols))


def horizon_targets(
    rows: DataFrame,
    horizons: Sequence[int] = (1,),
    targets: Sequence[str] = ("P",),
    by: Sequence[str] = SERIES,
    contiguous: bool = False,
    partial: bool = False,
) -> DataFrame:
    """``{target}_h{h}``: the value ``h`` rows later, by position among the given rows.

    Rows without a value at the largest horizon are dropped, so all horizons share
    one sample set.  ``contiguous`` also requires those rows to be ``h`` clock steps
    later.  ``partial`` keeps rows that have a value at the smallest horizon; larger
    horizons beyond the end are NULL.
    """
    if contiguous and partial:
        raise ValueError("contiguous looks at the largest horizon, which partial rows lack")
    ranked = rows if {"rn", "n"} <= set(rows.columns) else positions(rows, by)
    w = within_chunk(by).orderBy("rn")
    wide = halo(ranked, after=max(horizons), position="rn", by=by).withColumns(
        {f"{t}_h{h}": F.lead(t, h).over(w) for t in targets for h in horizons}
        | {"_ahead": F.lead("k", max(horizons)).over(w)}
    )
    needed = min(horizons) if partial else max(horizons)
    wide = owned(wide, "rn").where(F.col("rn") + needed < F.col("n"))
    if contiguous:
        wide = wide.where(F.col("_ahead") - F.col("k") == max(horizons))
    return wide.drop("_ahead")


def training_matrix(
    df: DataFrame,
    max_lag: int = 24,
    windows: Sequence[int] = (6, 12, 24),
    horizons: Sequence[int] = (1,),
    targets: Sequence[str] = ("P",),
    use_time: bool = True,
    exog: Sequence[str] = (),
    by: Sequence[str] = SERIES,
    freq: str | Frequency = "H",
    partial: bool = False,
) -> DataFrame:
    """``feature_matrix`` with positions ``rn``, ``n`` and targets ``{target}_h{h}``.

    ``partial`` as in ``horizon_targets``: one matrix then serves every horizon.
    The targets are found on the narrow rows and joined to the grid first; the wide
    feature arrays are built behind the last shuffle and never move.
    """
    cols = ["P", "Q", *[c for c in exog if c in df.columns]]
    rows = positions(feature_rows(df, history_depth(max_lag, windows), cols, by), by)
    goals = ["rn", "n", *[f"{t}_h{h}" for t in targets for h in horizons]]
    aimed = horizon_targets(rows, horizons, targets, by, partial=partial).select(*by, "k", *goals)
    aimed = aimed.withColumn("chunk", chunk_of(df, F.col("k")))
    base = df.join(aimed, [*by, "chunk", "k"], "left")
    wide = feature_matrix(base, max_lag, windows, use_time, exog, by, freq, keep=goals)
    return wide.where(F.col("rn").isNotNull())


def sequence_windows(
    df: DataFrame,
    length: int = 24,
    horizons: Sequence[int] = (1,),
    cols: Sequence[str] = ("P", "Q"),
    targets: Sequence[str] = ("P",),
    by: Sequence[str] = SERIES,
) -> DataFrame:
    """Input windows of ``length`` rows and their targets, by position.

    Result: ``by..., chunk, k, sample, samples, x, {target}_h{h}`` where ``x``
    is an array of structs, oldest first, ``sample`` the 0-based window number and
    ``samples`` their count per series.  Incomplete rows are dropped first.
    """
    needed = list(dict.fromkeys([*cols, *targets]))
    ranked = positions(complete_rows(df, needed), by)
    ahead = max(horizons)
    order = within_chunk(by).orderBy("rn")
    wide = halo(ranked, before=length - 1, after=ahead, position="rn", by=by).withColumns(
        {"x": F.collect_list(F.struct(*cols)).over(order.rowsBetween(1 - length, 0))}
        | {f"{t}_h{h}": F.lead(t, h).over(order) for t in targets for h in horizons}
    )
    wide = owned(wide, "rn").where(
        (F.col("rn") >= length - 1) & (F.col("rn") + ahead < F.col("n"))
    )
    outputs = [f"{t}_h{h}" for t in targets for h in horizons]
    return wide.select(
        *by,
        "chunk",
        "k",
        (F.col("rn") - (length - 1)).alias("sample"),
        (F.col("n") - (length - 1) - ahead).alias("samples"),
        "x",
        *outputs,
    )


def window_scaler(
    df: DataFrame,
    length: int,
    train_windows: Column,
    cols: Sequence[str] = ("P", "Q"),
    by: Sequence[str] = SERIES,
) -> DataFrame:
    """Mean and population deviation (+1e-8) over all cells of the training windows.

    ``df`` has ``rn``; windows 0..train_windows-1 are used for training.  A row
    counts once per training window that covers it, so the windows are never built:
    its weight is that number.  Chunk moments are merged over the chunk means.
    Result per ``(series, chunk)``: ``{c}_mean``, ``{c}_std``.
    """
    first = F.greatest(F.lit(0), F.col("rn") - (length - 1))
    last = F.least(F.col("rn"), train_windows - 1)
    cells = df.withColumn("_w", F.greatest(F.lit(0), last - first + 1).cast("double"))
    sums = [F.sum("_w").alias("_w")]
    for c in cols:
        sums += [
            F.sum(F.col("_w") * F.col(c)).alias(f"{c}_s"),
            F.sum(F.col("_w") * F.col(c) * F.col(c)).alias(f"{c}_ss"),
        ]
    edge = cells.groupBy(*by, "chunk").agg(*sums)
    across = Window.partitionBy(*by)
    mean = {
        f"{c}_mean": F.try_divide(F.sum(f"{c}_s").over(across), F.sum("_w").over(across))
        for c in cols
    }
    edge = edge.withColumns(mean)
    scale = {}
    for c in cols:
        local = F.try_divide(f"{c}_s", "_w")
        inner = F.greatest(F.lit(0.0), F.col(f"{c}_ss") - F.col(f"{c}_s") * local)
        shift = F.col("_w") * F.pow(local - F.col(f"{c}_mean"), 2)
        var = F.try_divide(F.sum(inner + shift).over(across), F.sum("_w").over(across))
        scale[f"{c}_std"] = F.sqrt(var) + 1e-8
    edge = edge.withColumns(scale)
    return edge.select(*by, "chunk", *[f"{c}_{s}" for c in cols for s in ("mean", "std")])


def standardize(
    df: DataFrame, scaler: DataFrame, cols: Sequence[str] = ("P", "Q"), by: Sequence[str] = SERIES
) -> DataFrame:
    """Replace ``cols`` by their z-scores under a ``window_scaler`` result."""
    wide = attach(df, scaler, by)
    z = {c: (F.col(c) - F.col(f"{c}_mean")) / F.col(f"{c}_std") for c in cols}
    return wide.withColumns(z).drop(*[f"{c}_{s}" for c in cols for s in ("mean", "std")])


