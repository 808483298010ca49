"""Fitted trees as flat arrays, evaluated and rolled forward inside one row per series.

A fitted ensemble becomes five arrays over all its nodes (feature, threshold, left, right,
value) with the root and weight of each tree.  Walking a tree is a fold over its depth, so
an ensemble is a plain column expression: a recursive forecast of any length is one
projection over the series' histories, without a plan step per forecast step.
"""

from __future__ import annotations

import json
import re
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidepanel.functions.timeaxis import Frequency, frequency
from tidepanel.operators.chunks import SERIES
from tidepanel.operators.features import history_depth, history_vector
from tidepanel.operators.forecast import Steps, _rolled, bound, recent_history

_LINE = re.compile(r"(If|Else) \(feature (\d+) (<=|>) (\S+)\)|Predict: (\S+)|Tree \d+ \(weight (\S+)\):")
_SCHEMA = (
    "struct<feature:array<int>,threshold:array<double>,left:array<int>,right:array<int>,"
    "value:array<double>,root:array<int>,weight:array<double>>"
)
#: Beyond every finite value: at a leaf the walk stays where it is.
STAY = 1.7976931348623157e308


@dataclass(frozen=True)
class Forest:
    """Nodes of all trees one after another; a leaf is its own left and right child."""

    feature: Sequence[int]
    threshold: Sequence[float]
    left: Sequence[int]
    right: Sequence[int]
    value: Sequence[float]
    root: Sequence[int]
    weight: Sequence[float]
    depth: int

    @classmethod
    def of(cls, trees: Sequence[Mapping | float], weights: Sequence[float] | None = None) -> Forest:
        """From nested trees: a leaf is a number, a node ``{feature, threshold, left, right}``."""
        cells: dict[str, list] = {c: [] for c in ("feature", "threshold", "left", "right", "value")}

        def add(node) -> tuple[int, int]:
            at = len(cells["feature"])
            for c, v in zip(cells, (0, STAY, at, at, 0.0)):
                cells[c].append(v)
            if not isinstance(node, Mapping):
                cells["value"][at] = float(node)
                return at, 0
            cells["feature"][at], cells["threshold"][at] = node["feature"], float(node["threshold"])
            cells["left"][at], low = add(node["left"])
            cells["right"][at], high = add(node["right"])
            return at, 1 + max(low, high)

        added = [add(t) for t in trees]
        weights = list(weights or [1.0 / len(trees)] * len(trees))
        return cls(**cells, root=[a for a, _ in added], weight=weights, depth=max(d for _, d in added))

    def predict(self, x: Column) -> Column:
        """The ensemble's value for an array of features."""
        known = {c: getattr(self, c) for c in ("feature", "threshold", "left", "right", "value", "root", "weight")}
        # parsed once, when the plan is optimised
        forest = F.from_json(F.lit(json.dumps({c: list(v) for c, v in known.items()})), _SCHEMA)
        cell = {c: forest[c] for c in known}
        steps = F.sequence(F.lit(1), F.lit(max(self.depth, 1)))

        def step(node: Column, _: Column) -> Column:
            goes_left = F.get(x, F.get(cell["feature"], node)) <= F.get(cell["threshold"], node)
            return F.when(goes_left, F.get(cell["left"], node)).otherwise(F.get(cell["right"], node))

        def leaf(root: Column) -> Column:
            return F.get(cell["value"], F.aggregate(steps, root, step))

        parts = F.zip_with(cell["root"], cell["weight"], lambda root, w: leaf(root) * w)
        return F.aggregate(parts, F.lit(0.0), lambda acc, v: acc + v)


def flatten(model) -> Forest:
    """The trees of a fitted Spark ML tree, forest or boosted model, or of a pipeline's last stage."""
    model = model.stages[-1] if hasattr(model, "stages") else model
    trees, weights, path = [], [], []

    def place(node) -> None:
        if not path:
            trees.append(node)
        elif "left" not in path[-1]:
            path[-1]["left"] = node
        else:
            path[-1]["right"] = node

    for line in model.toDebugString.splitlines():
        found = _LINE.search(line)
        if not found:
            continue
        kind, feature, _, threshold, value, weight = found.groups()
        if weight is not None:
            weights.append(float(weight))
        elif kind == "If":
            node = {"feature": int(feature), "threshold": float(threshold)}
            place(node)
            path.append(node)
        elif value is not None:
            place(float(value))
            while path and "right" in path[-1]:
                path.pop()
    if "RandomForest" in type(model).__name__:
        weights = None  # a forest averages its trees
    return Forest.of(trees, weights)


def recursive_forest(
    df: DataFrame,
    forest: Forest,
    steps: Steps,
    max_lag: int = 24,
    windows: Sequence[int] = (6, 12, 24),
    use_time: bool = True,
    exog: Sequence[str] = (),
    freq: str | Frequency = "H",
    by: Sequence[str] = SERIES,
    skip: Steps = 0,
) -> DataFrame:
    """Roll a one-step feature model forward: ``by..., step, ts, yhat``.

    One row per series holds just the values the features need.  Each step rebuilds the
    features of the newest row, predicts the next one and appends it; Q and the exogenous
    columns keep their last value.  Features look at rows before their own, so the first
    forecast does not see the last row of the history.
    """
    freq = frequency(freq)
    cols = ["P", "Q", *exog]
    depth = history_depth(max_lag, windows)
    history = recent_history(df.dropna(subset=cols), depth + 1, cols, by)
    others = {
        c: F.concat(F.col(f"{c}_hist"), F.array_repeat(F.element_at(f"{c}_hist", -1), depth + 1))
        for c in cols[1:]
    }

    def advance(values: Column, step: Column) -> Column:
        seen = {"P": F.slice(values, 1, depth)}
        seen |= {c: F.slice(whole, F.least(step, F.lit(depth + 2)), F.lit(depth)) for c, whole in others.items()}
        vector = history_vector(seen, freq.stamp(F.col("k") + step - 1), max_lag, windows, use_time)
        return bound(vector, forest.predict)

    out = _rolled(history, F.col("P_hist"), advance, steps, skip, freq, by)
    return out.select(*by, "step", "ts", F.round("yhat", 2).alias("yhat"))
