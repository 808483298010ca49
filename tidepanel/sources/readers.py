"""Reading raw tables into panels: scan, column roles, typing."""

from __future__ import annotations

import re
import warnings
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

# Words that give away a column's role, in order of preference.
TIME_WORDS = ("时间", "时间戳", "日期", "time", "timestamp", "date", "datetime", "時間")
P_WORDS = ("有功", "p", "active", "power", "有功功率", "active_power")
Q_WORDS = ("无功", "q", "reactive", "無功", "无功功率", "reactive_power")


def read_table(
    spark: SparkSession,
    path: str,
    schema: StructType | str | None = None,
    glob: str | None = None,
    fmt: str | None = None,
) -> DataFrame:
    """Scan a CSV or Parquet file, or every file of a folder that matches ``glob``."""
    kind = fmt or (glob or path).rsplit(".", 1)[-1].lower()
    if kind not in ("csv", "parquet"):
        raise ValueError(f"Unsupported file format {kind!r}; choose csv or parquet")
    reader = spark.read
    if schema is not None:
        reader = reader.schema(schema)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    if kind == "csv":
        # without a schema every column stays text and is coerced later
        reader = reader.option("header", True)
    return reader.format(kind).load(path)


def with_file_series(df: DataFrame) -> DataFrame:
    """Use the name of the file a row came from as its series key."""
    return df.withColumn("sid", F.col("_metadata.file_name"))


def _has(name: str, words: Sequence[str]) -> bool:
    """Whole-token match for one-letter words, substring match for the others."""
    tokens = re.split(r"[^0-9a-z]+", name)
    return any(w in tokens if len(w) == 1 else w in name for w in words)


def detect_time_column(columns: Sequence[str]) -> str | None:
    return next((c for c in columns if _has(c.lower().strip(), TIME_WORDS)), None)


def detect_pq_columns(columns: Sequence[str]) -> tuple[str | None, str | None]:
    """Active and reactive power columns.

    The time column takes no part, and reactive words win over the active ones
    they contain.
    """
    time_col = detect_time_column(columns)
    p = q = None
    for c in columns:
        name = c.lower().strip()
        if c == time_col:
            continue
        if _has(name, Q_WORDS):
            q = q or c
        elif _has(name, P_WORDS):
            p = p or c
    return p, q


def project_rename(
    df: DataFrame,
    time_col: str,
    p_col: str,
    q_col: str,
    exog: Sequence[str] = (),
    sid_col: str | None = None,
) -> DataFrame:
    """Keep the named columns as ``sid, ts, P, Q, exog...``; absent exogenous ones are skipped."""
    absent = [c for c in exog if c not in df.columns]
    if absent:
        warnings.warn(f"exogenous columns not found, skipped: {absent}", stacklevel=2)
    sid = F.col(sid_col).cast("string") if sid_col else F.lit("series")
    return df.select(
        sid.alias("sid"),
        F.col(time_col).alias("ts"),
        F.col(p_col).alias("P"),
        F.col(q_col).alias("Q"),
        *[F.col(f"`{c}`").alias(c) for c in exog if c not in absent],
    )


def parse_time(column: Column) -> Column:
    """Wall-clock timestamp, NULL for bad text."""
    return column.try_cast("timestamp_ntz")


def localize(ts: Column, tz: str) -> Column:
    """UTC time of a wall clock in ``tz``; clock times that do not exist or are ambiguous raise."""
    utc, zone = F.lit("UTC"), F.lit(tz)
    instant = F.convert_timezone(zone, utc, ts)
    hour = F.make_dt_interval(hours=F.lit(1))
    unique = (
        (F.convert_timezone(utc, zone, instant) == ts)
        & (F.convert_timezone(utc, zone, instant + hour) != ts)
        & (F.convert_timezone(utc, zone, instant - hour) != ts)
    )
    message = F.concat(F.lit(f"no unique time in {tz}: "), ts.cast("string"))
    return F.when(ts.isNull() | unique, instant).otherwise(
        F.raise_error(message).cast("timestamp_ntz")
    )


def coerce_numeric(column: Column) -> Column:
    """Double, NULL for text that is not a number and for NaN."""
    value = column.try_cast("double")
    return F.when(~F.isnan(value), value)


def count_rejects(raw: Column, parsed: Column) -> Column:
    """Aggregate: rows that had text but no value."""
    return F.count_if(raw.isNotNull() & parsed.isNull())


def load_panel(
    df: DataFrame,
    time_col: str | None = None,
    p_col: str | None = None,
    q_col: str | None = None,
    exog: Sequence[str] = (),
    sid_col: str | None = None,
    tz: str | None = None,
    on_bad_time: str = "error",
) -> DataFrame:
    """Raw table to panel ``sid, ts, P, Q, exog...`` with roles detected where not given.

    Bad timestamps raise, or are dropped with ``on_bad_time="drop"``.
    """
    candidates = [c for c in df.columns if c != sid_col]
    time_col = time_col or detect_time_column(candidates)
    if time_col is None:
        raise ValueError("Could not detect the time column; pass time_col")
    if p_col is None or q_col is None:
        found_p, found_q = detect_pq_columns(candidates)
        p_col, q_col = p_col or found_p, q_col or found_q
        if p_col is None or q_col is None:
            raise ValueError("Could not detect the P and Q columns; pass p_col and q_col")
    panel = project_rename(df, time_col, p_col, q_col, exog, sid_col)
    ts = parse_time(F.col("ts"))
    if on_bad_time == "error":
        bad = F.concat(F.lit("bad timestamp: "), F.coalesce(F.col("ts").cast("string"), F.lit("NULL")))
        ts = F.when(ts.isNotNull(), ts).otherwise(F.raise_error(bad).cast("timestamp_ntz"))
    panel = panel.withColumn("ts", ts).where(F.col("ts").isNotNull())
    if tz:
        panel = panel.withColumn("ts", localize(F.col("ts"), tz))
    measures = [c for c in panel.columns if c not in ("sid", "ts")]
    return panel.withColumns({c: coerce_numeric(F.col(c)) for c in measures})
