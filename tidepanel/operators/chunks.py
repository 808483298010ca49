"""Bounded work units for ordered operators.

One series may hold a third of all rows, so no window here is partitioned by the
series alone.  Every gridded frame carries ``chunk``: a block of consecutive
steps.  Ordered operators run per ``(series, chunk)`` and get what lies beyond
the chunk in one of three ways:

* ``halo``      copies of the few neighbouring rows a frame reaches into,
* ``neighbours`` the nearest valid value carried over chunk summaries,
* ``series_totals`` per-series values computed from chunk summaries.

A chunk summary has one row per chunk, and rows meet it again in an equi-join on
``(series, chunk)``, so a hot series is always spread over many tasks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidepanel.functions.timeaxis import floor_div

CHUNK_CONF = "tidepanel.chunkRows"
DEFAULT_CHUNK_ROWS = 8192
SERIES = ("sid",)


def chunk_rows(spark: SparkSession) -> int:
    """Steps per chunk: the session's ``tidepanel.chunkRows``, else the default."""
    return int(spark.conf.get(CHUNK_CONF, str(DEFAULT_CHUNK_ROWS)))


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def chunk_of(df: DataFrame, position: Column) -> Column:
    return floor_div(position, chunk_rows(df.sparkSession))


def within_chunk(by: Sequence[str] = SERIES):
    return Window.partitionBy(*by, "chunk")


def series_totals(
    df: DataFrame,
    partial: dict[str, Column],
    total: dict[str, Column],
    by: Sequence[str] = SERIES,
) -> DataFrame:
    """Per-series values at chunk grain.

    ``partial`` are aggregates over a chunk's rows, ``total`` aggregates over a
    series' chunks.  The result has one row per ``(series, chunk)``.
    """
    across = Window.partitionBy(*by)
    edge = df.groupBy(*by, "chunk").agg(*[c.alias(n) for n, c in partial.items()])
    return edge.select(*by, "chunk", *[c.over(across).alias(n) for n, c in total.items()])


def attach(df: DataFrame, summary: DataFrame, by: Sequence[str] = SERIES) -> DataFrame:
    """Join a chunk-grain summary back to its rows."""
    return df.join(summary, [*by, "chunk"])


def spread(df: DataFrame, per_series: DataFrame, by: Sequence[str] = SERIES) -> DataFrame:
    """Attach one row per series to all its rows, by way of the chunk list."""
    chunks = df.select(*by, "chunk").distinct()
    return attach(df, chunks.join(per_series, list(by), "left"), by)


def halo(
    df: DataFrame,
    before: int = 0,
    after: int = 0,
    position: str = "k",
    by: Sequence[str] = SERIES,
) -> DataFrame:
    """Copy rows into every chunk whose rows look at most ``before`` back or ``after`` ahead.

    The rows are then shuffled by ``(series, chunk)`` into the session's number of
    partitions: window frames cost far more time than bytes, so adaptive coalescing
    by size would leave cores idle.
    """
    here = F.col(position)
    first, last = chunk_of(df, here - after), chunk_of(df, here + before)
    copied = df.withColumn("chunk", F.explode(F.sequence(first, last)))
    return copied.repartition(shuffle_partitions(df.sparkSession), *by, "chunk")


def owned(df: DataFrame, position: str = "k") -> DataFrame:
    """Drop the copies made by ``halo``."""
    return df.where(F.col("chunk") == chunk_of(df, F.col(position)))


def positions(df: DataFrame, by: Sequence[str] = SERIES, order: str = "k") -> DataFrame:
    """Exact 0-based position ``rn`` and length ``n`` of each series, after any row filter."""
    across = Window.partitionBy(*by)
    upto = across.orderBy("chunk").rowsBetween(Window.unboundedPreceding, 0)
    counts = df.groupBy(*by, "chunk").agg(F.count(F.lit(1)).alias("_rows"))
    counts = counts.select(
        *by,
        "chunk",
        (F.sum("_rows").over(upto) - F.col("_rows")).alias("_offset"),
        F.sum("_rows").over(across).alias("n"),
    )
    local = F.row_number().over(within_chunk(by).orderBy(order))
    return (
        attach(df, counts, by)
        .withColumn("rn", (F.col("_offset") + local - 1).cast("bigint"))
        .drop("_offset")
    )


def neighbours(
    df: DataFrame,
    cols: Sequence[str],
    by: Sequence[str] = SERIES,
    previous: bool = True,
    following: bool = True,
    extent: bool = False,
) -> DataFrame:
    """Nearest valid value on each side and its step; the row itself counts.

    Adds ``{c}__prev_k``, ``{c}__prev_v``, ``{c}__next_k`` and ``{c}__next_v``, with
    ``extent`` also the series' first step ``k0`` and its length ``steps``.  The
    look-ahead uses a descending sort, because a frame that runs to the end of the
    partition is evaluated again for every row.  Steps and values are separate
    primitive columns, which aggregate much faster than structs.
    """
    start = Window.unboundedPreceding
    across = Window.partitionBy(*by)
    earlier = across.orderBy("chunk").rowsBetween(start, -1)
    later = across.orderBy(F.desc("chunk")).rowsBetween(start, -1)
    up = within_chunk(by).orderBy("k").rowsBetween(start, 0)
    down = within_chunk(by).orderBy(F.desc("k")).rowsBetween(start, 0)

    partial, carried, out = [], [], {}
    for c in cols:
        at = F.when(F.col(c).isNotNull(), F.col("k"))
        sides = []
        if previous:
            partial += [F.max(at).alias(f"{c}__tail_k"), F.max_by(c, at).alias(f"{c}__tail_v")]
            sides.append(("prev", "tail", earlier, up))
        if following:
            partial += [F.min(at).alias(f"{c}__head_k"), F.min_by(c, at).alias(f"{c}__head_v")]
            sides.append(("next", "head", later, down))
        for side, edge, beyond, local in sides:
            for part, value in (("k", at), ("v", F.col(c))):
                inner = F.last(value, True).over(local)
                carried.append(F.last(f"{c}__{edge}_{part}", True).over(beyond).alias(f"{c}__{edge}_{part}"))
                out[f"{c}__{side}_{part}"] = F.coalesce(inner, F.col(f"{c}__{edge}_{part}"))
    if extent:
        partial += [F.min("k").alias("_lo"), F.max("k").alias("_hi")]
        low, high = F.min("_lo").over(across), F.max("_hi").over(across)
        carried += [low.alias("k0"), (high - low + 1).alias("steps")]
    edges = df.groupBy(*by, "chunk").agg(*partial).select(*by, "chunk", *carried)
    spent = [f"{c}__{edge}_{part}" for c in cols for edge in ("tail", "head") for part in "kv"]
    return attach(df, edges, by).withColumns(out).drop(*spent)
