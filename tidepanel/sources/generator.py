"""Synthetic hourly load with daily and weekly patterns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidepanel.functions.numbers import normal, uniform
from tidepanel.functions.timeaxis import frequency
from tidepanel.operators.chunks import shuffle_partitions

# Fixed values of the load model.
P_BASE, DAILY, WEEKEND, P_NOISE = 100.0, 30.0, -10.0, 5.0
Q_BASE, Q_SHARE, Q_NOISE = 50.0, 0.4, 3.0
MISSING_SHARE = 0.01
START = "2023-01-01 00:00:00"


def load_curve(spark: SparkSession, n_days: int = 30, freq: str = "H") -> DataFrame:
    """``ts, load``: the load without noise, one row per step from ``START`` on."""
    freq = frequency(freq)
    first = freq.index(F.lit(START).cast("timestamp_ntz"))
    steps = spark.range(n_days * 86_400 // freq.seconds)
    curve = steps.select(freq.stamp(first + F.col("id")).alias("ts"))
    weekend = F.when(F.weekday("ts") >= 5, F.lit(WEEKEND)).otherwise(F.lit(0.0))
    return curve.select("ts", (P_BASE + DAILY * F.sin(2 * F.pi() * F.hour("ts") / 24) + weekend).alias("load"))


def generate_panel(
    series: DataFrame, n_days: int = 30, freq: str = "H", noise: bool = True, seed: int = 42
) -> DataFrame:
    """``sid, ts, P, Q`` for every ``sid`` in ``series``.

    Noise depends on seed, series and time alone.  With noise, 1 % of the rows lose P and half of those lose Q as well.
    The load depends on time alone, so it is computed once per step and joined to every
    series.  The number of partitions is given, because rows multiply behind the shuffle.
    """
    spark = series.sparkSession
    sids = series.select("sid").repartition(shuffle_partitions(spark))
    rows = sids.crossJoin(load_curve(spark, n_days, freq))
    load = F.col("load")
    reactive = Q_BASE + Q_SHARE * (F.col("P") - P_BASE)
    if not noise:
        rows = rows.select("sid", "ts", F.greatest(load, F.lit(0.0)).alias("P"))
        return rows.withColumn("Q", reactive)
    rows = rows.withColumn("P", F.greatest(load + P_NOISE * normal(seed, "sid", "ts"), F.lit(0.0)))
    rows = rows.withColumn("Q", reactive + Q_NOISE * normal(seed + 1, "sid", "ts"))
    rows = rows.withColumn("_u", uniform(seed + 2, "sid", "ts"))
    return rows.select(
        "sid",
        "ts",
        F.when(F.col("_u") >= MISSING_SHARE, F.col("P")).alias("P"),
        F.when(F.col("_u") >= MISSING_SHARE / 2, F.col("Q")).alias("Q"),
    )
