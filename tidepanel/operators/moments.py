"""Linear window models per series from mergeable sufficient statistics.

One pass over the panel makes, per series and chunk, the products that least squares
needs: the Gram matrix of (1, window, targets).  Grams of chunks add up, training parts of
folds are nested, so every fold, horizon and target of every series is solved from sums of
the same rows; windows are never written or shuffled.

A *segment* is the first fold that trains on a sample; fold f sums segments 0..f, and the
fold ``n_splits`` is the whole history.  Values enter as differences from their series'
mean, so a high level cancels no digits.  Fold scalers are read off the same sums, as a
Gram holds the first two moments of every window position.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidepanel.functions.metrics import eval_metrics
from tidepanel.operators.chunks import (
    SERIES,
    attach,
    chunk_rows,
    halo,
    owned,
    positions,
    series_totals,
    within_chunk,
)
from tidepanel.operators.features import complete_rows
from tidepanel.operators.folds import RollingOrigin
from tidepanel.sources.sinks import materialize

STRATEGIES = ("direct", "multi_output")
MODEL = "LinearWindow"
#: Spread below which a window column counts as constant.
FLAT = 1e-8


def _ranked(df: DataFrame, cols: Sequence[str], targets: Sequence[str], by: Sequence[str]) -> DataFrame:
    """Complete rows with exact positions, each column with its series mean ``{c}__at``."""
    needed = list(dict.fromkeys([*cols, *targets]))
    rows = complete_rows(df, needed)
    sums = {f"{c}__s": F.sum(c) for c in needed} | {"__n": F.count(F.lit(1))}
    means = {f"{c}__at": F.sum(f"{c}__s") for c in needed} | {"__all": F.sum("__n")}
    totals = series_totals(rows, sums, means, by)
    totals = totals.withColumns({f"{c}__at": F.col(f"{c}__at") / F.col("__all") for c in needed})
    return positions(attach(rows.select(*by, "chunk", "k", *needed), totals.drop("__all"), by), by)


def _ddl(df: DataFrame, cols: Sequence[str]) -> str:
    kinds = dict(df.dtypes)
    return ", ".join(f"`{c}` {kinds[c]}" for c in cols)


def _samples(n: Column | int, length: int, horizon: int, horizons: Sequence[int], strategy: str):
    """Windows of a series that have a target: by horizon, or those of the largest for all."""
    return n - (length - 1) - (max(horizons) if strategy == "multi_output" else horizon)


def window_grams(
    df: DataFrame,
    length: int = 24,
    horizons: Sequence[int] = (1,),
    strategy: str = "direct",
    cols: Sequence[str] = ("P", "Q"),
    targets: Sequence[str] = ("P",),
    split: RollingOrigin = RollingOrigin(100, 3),
    by: Sequence[str] = SERIES,
) -> DataFrame:
    """``by..., horizon, fold, shift, gram``: summed products of each fold's training windows.

    ``gram`` is the upper triangle of Z'Z for Z = (1, window oldest row first, targets),
    in differences from ``shift``, the series' means of ``cols`` and ``targets``.
    """
    if strategy not in STRATEGIES:
        raise ValueError(f"Unknown strategy {strategy!r}; choose direct or multi_output")
    needed = list(dict.fromkeys([*cols, *targets]))
    ranked = _ranked(df, cols, targets, by)
    ranked = ranked.where(split.usable(_samples(F.col("n"), length, max(horizons), horizons, strategy)))
    wide = halo(ranked, before=length - 1, after=max(horizons), position="rn", by=by)
    per_chunk, keys = chunk_rows(df.sparkSession), len(by)
    inputs, goals = [needed.index(c) for c in cols], [needed.index(t) for t in targets]

    def products(key, table):
        table = table.sort_by("rn")
        rn, n = table["rn"].to_numpy(), table["n"][0].as_py()
        shift = np.array([table[f"{c}__at"][0].as_py() for c in needed])
        values = np.stack([table[c].to_numpy() for c in needed], axis=1) - shift
        if len(rn) < length:
            return empty(table)
        windows = np.lib.stride_tricks.sliding_window_view(values[:, inputs], length, axis=0)
        windows = windows.transpose(0, 2, 1).reshape(len(windows), -1)
        end = rn[length - 1 :]
        mine = end // per_chunk == key[keys].as_py()
        upper = np.triu_indices(1 + windows.shape[1] + len(goals))
        rows = []
        for h in horizons:
            count = _samples(n, length, h, horizons, strategy)
            sample = end - (length - 1)
            usable = np.flatnonzero(mine & (sample < count) & (end + h < n))
            first = count - split.test_window * split.n_splits - split.gap
            segment = np.clip((sample[usable] - first) // split.test_window + 1, 0, split.n_splits)
            for s in np.unique(segment):
                at = usable[segment == s]
                z = np.concatenate(
                    [np.ones((len(at), 1)), windows[at], values[at + length - 1 + h][:, goals]], axis=1
                )
                rows.append((h, int(s), shift, (z.T @ z)[upper]))
        return built(key, rows)

    shape = [(c, pa.float64()) for c in ("shift", "gram")]
    plain = [("horizon", pa.int32()), ("segment", pa.int32())]

    def built(key, rows):
        columns = {c: pa.array([key[i].as_py()] * len(rows), key[i].type) for i, c in enumerate(by)}
        for i, (name, kind) in enumerate([*plain, *[(c, pa.list_(t)) for c, t in shape]]):
            columns[name] = pa.array([r[i] for r in rows], kind)
        return pa.table(columns)

    def empty(table):
        columns = {c: table[c].slice(0, 0) for c in by}
        columns |= {c: pa.array([], t) for c, t in plain} | {c: pa.array([], pa.list_(t)) for c, t in shape}
        return pa.table(columns)

    schema = f"{_ddl(wide, by)}, horizon int, segment int, shift array<double>, gram array<double>"
    narrow = wide.select(*by, "chunk", "rn", "n", *needed, *[f"{c}__at" for c in needed])
    partial = narrow.groupBy(*by, "chunk").applyInArrow(products, schema)
    # cell by cell, so that sums combine before the shuffle and a hot series stays spread
    cells = partial.select(*by, "horizon", "segment", "shift", F.posexplode("gram").alias("i", "v"))
    folds = range(split.n_splits + 1)
    upto = [F.sum(F.when(F.col("segment") <= f, F.col("v"))).alias(f"f{f}") for f in folds]
    summed = cells.groupBy(*by, "horizon", "i").agg(F.max("shift").alias("shift"), *upto)
    ordered = F.array_sort(F.collect_list(F.struct("i", *[f"f{f}" for f in folds])))
    packed = summed.groupBy(*by, "horizon").agg(F.max("shift").alias("shift"), ordered.alias("g"))
    each = [F.struct(F.lit(f).alias("fold"), F.col(f"g.f{f}").alias("gram")) for f in folds]
    return packed.select(*by, "horizon", "shift", F.inline(F.array(*each))).where(F.col("gram")[0] > 0)


def _solved(gram: np.ndarray, shift: np.ndarray, length: int, cols: int, goals: list[int], reg: float, orders):
    """Models of one Gram: rows (order, target, rows, weights, intercept, mean, std)."""
    d = length * cols
    q = d + 1 + len(goals)
    g = np.zeros((q, q))
    g[np.triu_indices(q)] = gram
    g = np.triu(g) + np.triu(g, 1).T
    m = g[0, 0]
    mean, second = g[0, 1:] / m, g[1:, 1:] / m
    cov = second - np.outer(mean, mean)
    # one mean and deviation per column, over all cells of the training windows
    centre = mean[:d].reshape(length, cols).mean(axis=0)
    spread = np.diag(second)[:d].reshape(length, cols).mean(axis=0) - centre**2
    std = np.sqrt(np.maximum(spread, 0)) + 1e-8
    level = shift[:cols]
    scale = np.tile(np.where(std > FLAT * (2 + np.abs(level)), std, 1.0), length)
    within = cov[:d, :d] / np.outer(scale, scale) + reg * np.eye(d)
    out = []
    for order in orders:
        low = d - order * cols  # the newest rows of the window
        z = cov[low:d, d:] / scale[low:, None]
        if reg:
            solved = np.linalg.solve(within[low:, low:], z)
        else:
            solved = np.linalg.lstsq(within[low:, low:], z, rcond=1e-13)[0]
        for t, goal in enumerate(goals):
            w = np.zeros(d)
            w[low:] = solved[:, t] / scale[low:]
            bias = shift[goal] + mean[d + t] - w @ (mean[:d] + np.tile(level, length))
            out.append((order, t, int(m), w, bias, centre + level, std))
    return out


def solve_grams(
    grams: DataFrame,
    length: int,
    cols: Sequence[str] = ("P", "Q"),
    targets: Sequence[str] = ("P",),
    reg: float = 1e-6,
    orders: Sequence[int] | None = None,
    by: Sequence[str] = SERIES,
) -> DataFrame:
    """One model per series, horizon, fold, target and order.

    Least squares on standardised windows with the ridge penalty ``reg`` (none: 0); the
    scaler is folded in.  An order p uses the newest p rows of the window: its normal
    equations are a corner of the same matrix.  Result: ``by..., horizon, fold, lag,
    target, rows, weights, intercept, mean, std``, weights oldest row first.
    """
    needed = list(dict.fromkeys([*cols, *targets]))
    goals = [needed.index(t) for t in targets]
    orders = list(orders or [length])
    keys = [*by, "horizon", "fold"]
    arrays = [("weights", pa.list_(pa.float64())), ("intercept", pa.float64()), ("mean", pa.list_(pa.float64())), ("std", pa.list_(pa.float64()))]

    def scan(batches):
        for batch in batches:
            at, found = [], []
            for i in range(len(batch)):
                gram, shift = (np.asarray(batch.column(c)[i].values) for c in ("gram", "shift"))
                rows = _solved(gram, shift, length, len(cols), goals, reg, orders)
                at += [i] * len(rows)
                found += rows
            columns = [batch.column(c).take(pa.array(at, pa.int32())) for c in keys]
            columns += [
                pa.array([r[0] for r in found], pa.int32()),
                pa.array([targets[r[1]] for r in found], pa.string()),
                pa.array([r[2] for r in found], pa.int64()),
            ]
            columns += [pa.array([r[j] for r in found], t) for j, (_, t) in enumerate(arrays, 3)]
            yield pa.record_batch(columns, names=[*keys, "lag", "target", "rows", *[c for c, _ in arrays]])

    schema = (
        f"{_ddl(grams, keys)}, lag int, target string, rows long, weights array<double>, intercept double, "
        "mean array<double>, std array<double>"
    )
    return grams.select(*keys, "shift", "gram").mapInArrow(scan, schema)


def fit_windows(
    df: DataFrame,
    length: int = 24,
    horizons: Sequence[int] = (1,),
    strategy: str = "direct",
    cols: Sequence[str] = ("P", "Q"),
    targets: Sequence[str] = ("P",),
    split: RollingOrigin = RollingOrigin(100, 3),
    reg: float = 1e-6,
    orders: Sequence[int] | None = None,
    by: Sequence[str] = SERIES,
) -> DataFrame:
    """Window models of all series, folds, horizons and targets; ``fold == n_splits`` has all history."""
    grams = window_grams(df, length, horizons, strategy, cols, targets, split, by)
    return solve_grams(grams, length, cols, targets, reg, orders, by)


def fold_scalers(models: DataFrame, cols: Sequence[str] = ("P", "Q"), by: Sequence[str] = SERIES) -> DataFrame:
    """``by..., horizon, fold, {c}_mean, {c}_std`` over all cells of a fold's training windows."""
    one = models.groupBy(*by, "horizon", "fold").agg(F.max("mean").alias("mean"), F.max("std").alias("std"))
    cells = [F.col(s)[i].alias(f"{c}_{s}") for i, c in enumerate(cols) for s in ("mean", "std")]
    return one.select(*by, "horizon", "fold", *cells)


def dot(values: Column, weights: Column, start: Column) -> Column:
    return F.aggregate(F.zip_with(values, weights, lambda x, w: x * w), start, lambda acc, x: acc + x)


def window_predictions(
    df: DataFrame,
    models: DataFrame,
    length: int,
    horizons: Sequence[int] = (1,),
    strategy: str = "direct",
    cols: Sequence[str] = ("P", "Q"),
    targets: Sequence[str] = ("P",),
    split: RollingOrigin = RollingOrigin(100, 3),
    by: Sequence[str] = SERIES,
) -> DataFrame:
    """Test windows of every fold scored by their series' models.

    Only rows that test windows reach are kept, a bounded number per series.  Result:
    ``model, by..., horizon, fold, target, lag, k, y, yhat``.
    """
    needed = list(dict.fromkeys([*cols, *targets]))
    ranked = positions(complete_rows(df, needed), by)
    tested = split.test_window * split.n_splits + max(horizons)
    tail = ranked.where(F.col("rn") >= F.col("n") - tested - length)
    order = within_chunk(by).orderBy("rn")
    past = order.rowsBetween(1 - length, 0)
    ahead = {f"{t}_h{h}": F.lead(t, h).over(order) for t in targets for h in horizons}
    wide = halo(tail, before=length - 1, after=max(horizons), position="rn", by=by).withColumns(
        {"x": F.flatten(F.collect_list(F.array(*cols)).over(past))} | ahead
    )
    sample = F.col("rn") - (length - 1)
    cells = []
    for h in horizons:
        count = _samples(F.col("n"), length, h, horizons, strategy)
        fold = F.when(sample < count, split.test_fold(sample, count))
        for t in targets:
            cells.append(
                F.struct(
                    F.lit(h).alias("horizon"), fold.alias("fold"), F.lit(t).alias("target"),
                    F.col(f"{t}_h{h}").alias("y"),
                )
            )
    full = F.size("x") == length * len(cols)
    test = owned(wide, "rn").where(full).select(*by, "k", "x", F.inline(F.array(*cells)))
    scored = test.where(F.col("fold").isNotNull()).join(
        models.select(*by, "horizon", "fold", "target", "lag", "weights", "intercept"),
        [*by, "horizon", "fold", "target"],
    )
    return scored.select(
        F.lit(MODEL).alias("model"), *by, "horizon", "fold", "target", "lag", "k", "y",
        dot(F.col("x"), F.col("weights"), F.col("intercept")).alias("yhat"),
    )


def evaluate_windows(
    df: DataFrame,
    length: int = 24,
    horizons: Sequence[int] = (1,),
    strategy: str = "direct",
    cols: Sequence[str] = ("P", "Q"),
    targets: Sequence[str] = ("P",),
    split: RollingOrigin = RollingOrigin(100, 3),
    reg: float = 1e-6,
    by: Sequence[str] = SERIES,
) -> tuple[DataFrame, DataFrame]:
    """Out-of-fold predictions and the models behind them (the whole-history ones included)."""
    models = materialize(
        fit_windows(df, length, horizons, strategy, cols, targets, split, reg, None, by), "window-models"
    )
    return window_predictions(df, models, length, horizons, strategy, cols, targets, split, by), models


def search_ar_lags(
    df: DataFrame,
    max_lag: int = 24,
    horizon: int = 1,
    target: str = "P",
    split: RollingOrigin = RollingOrigin(100, 1),
    reg: float = 0.0,
    by: Sequence[str] = SERIES,
) -> DataFrame:
    """Scores of autoregressions with 1 to ``max_lag`` lags: ``by..., lag, metrics...``.

    One Gram of ``max_lag`` lags holds the normal equations of every smaller order in its
    corner, so no trial reads the data again; all orders share their samples.
    """
    cols, orders = (target,), range(1, max_lag + 1)
    models = fit_windows(df, max_lag, (horizon,), "direct", cols, cols, split, reg, orders, by)
    models = materialize(models.where(F.col("fold") < split.n_splits), "lag-models")
    scored = window_predictions(df, models, max_lag, (horizon,), "direct", cols, cols, split, by)
    return eval_metrics(scored, by=[*by, "lag"])
