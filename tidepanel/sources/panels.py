"""Panels ``(sid, k, ts, P, Q, ...)`` built from the test tables.

Rows are bucketed by step number ``k``; ``ts`` is the label of that step.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidepanel.functions.timeaxis import Frequency, frequency


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def clean(value: Column) -> Column:
    """NaN is a missing value; let only NULL stand for that."""
    return F.when(~F.isnan(value), value)


def _bucketed(df: DataFrame, freq: Frequency, sid: Column, ts: Column, measures: list[Column]):
    bucketed = df.groupBy(sid.alias("sid"), freq.index(ts).alias("k")).agg(*measures)
    return bucketed.withColumn("ts", freq.stamp(F.col("k")))


def _measures() -> list[Column]:
    return [
        F.round(F.sum(clean(F.col("value"))), 2).alias("P"),
        F.count(F.lit(1)).cast("double").alias("Q"),
    ]


def events_hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One series per event type, hourly: P = summed value, Q = number of events."""
    df = table(spark, sf_dir, "events")
    return _bucketed(df, frequency("H"), F.col("event_type"), F.col("ts"), _measures())


def events_by_user(spark: SparkSession, sf_dir: str, freq: str = "D") -> DataFrame:
    """Many short, sparse series: one per user."""
    df = table(spark, sf_dir, "events")
    sid = F.col("user_id").cast("string")
    return _bucketed(df, frequency(freq), sid, F.col("ts"), _measures())


def orders_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One long daily series: P = summed order price, Q = number of orders."""
    df = table(spark, sf_dir, "orders")
    measures = [
        F.round(F.sum(clean(F.col("o_totalprice"))), 2).alias("P"),
        F.count(F.lit(1)).cast("double").alias("Q"),
    ]
    return _bucketed(df, frequency("D"), F.lit("orders"), F.col("o_orderdate"), measures)


def shipments_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily series per return flag with two exogenous columns."""
    df = table(spark, sf_dir, "lineitem")
    measures = [
        F.round(F.sum("l_quantity"), 0).alias("P"),
        F.count(F.lit(1)).cast("double").alias("Q"),
        F.round(F.sum("l_discount"), 2).alias("discount"),
        F.round(F.sum("l_tax"), 2).alias("tax"),
    ]
    return _bucketed(df, frequency("D"), F.col("l_returnflag"), F.col("l_shipdate"), measures)
