"""Time the headline operators at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from pyspark.sql import SparkSession  # noqa: E402

from tidepanel.functions.metrics import eval_metrics  # noqa: E402
from tidepanel.operators import baselines, features, folds, forecast, grid, impute  # noqa: E402
from tidepanel.plans import queries  # noqa: E402
from tidepanel.sources import panels, sinks  # noqa: E402

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
SPLIT = folds.RollingOrigin(50, 3)


def users(spark):
    """Many series: one hourly panel per user."""
    return grid.regular_grid(panels.events_by_user(spark, SF_DIR, "H"), "H")


def orders(spark):
    """One long daily series."""
    return grid.regular_grid(panels.orders_daily(spark, SF_DIR), "D")


def headline(spark, times):
    """Name to DataFrame factory; the tables they share are written once, timed as ``shared_*``."""

    def shared(df, name):
        start = time.perf_counter()
        written = sinks.materialize(df, f"bench-{name}")
        times[f"shared_{name}"] = round(time.perf_counter() - start, 3)
        return written

    many = shared(users(spark), "users")
    filled = shared(impute.impute(many, "mean"), "filled")
    rows = shared(features.positions(features.feature_rows(filled, 24)), "rows")
    long = shared(impute.impute(orders(spark), "interpolate"), "orders")
    daily = folds.RollingOrigin(50, 3)
    out = {
        "grid_users": lambda: users(spark),
        "grid_orders": lambda: orders(spark),
        "feature_matrix_users": lambda: features.feature_matrix(filled, 24, (6, 12, 24)),
        "feature_matrix_orders": lambda: features.feature_matrix(long, 168, (6, 24, 168), freq="D"),
        "fold_assignment_users": lambda: SPLIT.assign(rows),
        "baselines_users": lambda: eval_metrics(
            baselines.baseline_predictions(rows, (1, 12, 24), SPLIT, (24,))
        ),
        "baselines_orders": lambda: eval_metrics(
            baselines.baseline_predictions(long, (1, 7), daily, (7,))
        ),
        "linear_lag_users": lambda: eval_metrics(
            baselines.linear_lag_predictions(rows, (1, 12, 24), SPLIT)
        ),
        "recursive_linear_users": lambda: forecast.recursive_linear(
            forecast.recent_history(filled, 6, short="null"), queries.WEIGHTS, 72
        ),
    }
    for method in impute.METHODS:
        options = {"freq": "H"} if method == "day_copy" else {}
        out[f"impute_{method}_users"] = lambda m=method, o=options: impute.impute(many, m, **o)
    for name in ("best_model", "strategy_compare", "eval_trees"):
        out[name] = lambda q=name: queries.QUERIES[q](spark, SF_DIR)
    return out


def main():
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]")
        .appName("bench")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", CPUS)
        .config("spark.driver.memory", "16g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    times = {}
    for name, build in headline(spark, times).items():
        start = time.perf_counter()
        build().write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "total_query_seconds",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": SF_DIR.rsplit("sf", 1)[-1],
            }
        )
    )


if __name__ == "__main__":
    main()
