"""Regular time grid and data-quality audit."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidepanel.functions.timeaxis import Frequency, epoch_seconds, frequency
from tidepanel.operators.chunks import (
    SERIES,
    chunk_of,
    chunk_rows,
    halo,
    owned,
    shuffle_partitions,
    within_chunk,
)


def regular_grid(
    panel: DataFrame,
    freq: str | Frequency = "H",
    cols: Sequence[str] = ("P", "Q"),
    by: Sequence[str] = SERIES,
    latest_by: str | None = None,
) -> DataFrame:
    """One row per step from the first to the last step of each series.

    Steps without a row get NULLs and rows off the grid are dropped.  A row without
    series key or timestamp raises.  A repeated timestamp raises as well, unless
    ``latest_by`` names a column: then the row with its largest value counts.  Result: ``by..., chunk, k, cols...`` where ``k`` is the step
    number; ``with_time`` turns it into a timestamp.  A panel that already has ``k``
    is taken to be on the grid.

    Data rows and one row per chunk meet in a single shuffle on ``(series, chunk)``.
    The chunk rows are exploded into steps behind it, so a long series never sits
    in one array or one task, and all later per-chunk work needs no other shuffle.
    The number of partitions is given, because rows multiply behind the shuffle and
    adaptive coalescing would judge them by their size before it.
    """
    freq = frequency(freq)
    size = chunk_rows(panel.sparkSession)
    rows, on_grid = panel, F.lit(True)
    if "k" not in panel.columns:
        rows, on_grid = panel.withColumn("k", freq.index(F.col("ts"))), freq.on_grid(F.col("ts"))
    known = F.lit(True)
    for c in (*by, "k"):
        known = known & F.col(c).isNotNull()
    unknown = F.raise_error(F.lit("NULL series key or timestamp")).cast("boolean")
    rows = rows.where(F.when(known, F.lit(True)).otherwise(unknown))
    if latest_by is not None:
        kept = F.max_by(F.struct(*cols), F.col(latest_by)).alias("_kept")
        rows = rows.where(on_grid).groupBy(*by, "k").agg(kept).select(*by, "k", "_kept.*")
        on_grid = F.lit(True)
    span = rows.groupBy(*by).agg(F.min("k").alias("_a"), F.max("k").alias("_b"))
    first, last = chunk_of(panel, F.col("_a")), chunk_of(panel, F.col("_b"))
    spine = span.withColumn("chunk", F.explode(F.sequence(first, last))).select(
        *by,
        "chunk",
        F.greatest("_a", F.col("chunk") * size).alias("_from"),
        F.least("_b", F.col("chunk") * size + (size - 1)).alias("_to"),
        F.lit(0).alias("_found"),
        *[F.lit(None).cast(panel.schema[c].dataType).alias(c) for c in cols],
    )
    found = rows.where(on_grid).select(
        *by,
        chunk_of(panel, F.col("k")).alias("chunk"),
        F.col("k").alias("_from"),
        F.col("k").alias("_to"),
        F.lit(1).alias("_found"),
        *cols,
    )
    steps = (
        found.unionByName(spine)
        .repartition(shuffle_partitions(panel.sparkSession), *by, "chunk")
        .select(*by, "chunk", F.explode(F.sequence("_from", "_to")).alias("k"), "_found", *cols)
    )
    cells = steps.groupBy(*by, "chunk", "k").agg(
        F.sum("_found").alias("_found"), *[F.max(c).alias(c) for c in cols]
    )
    repeated = F.raise_error(F.lit("duplicate timestamps in a series")).cast("boolean")
    single = F.when(F.col("_found") > 1, repeated).otherwise(F.lit(True))
    return cells.where(single).drop("_found")


def with_time(df: DataFrame, freq: str | Frequency = "H") -> DataFrame:
    """Add ``ts``, the timestamp of step ``k``."""
    return df.withColumn("ts", frequency(freq).stamp(F.col("k")))


def coverage(panel: DataFrame, freq: str = "H", by: Sequence[str] = SERIES) -> DataFrame:
    """Steps expected between first and last timestamp, rows found, rows missing."""
    freq = frequency(freq)
    if freq.seconds:
        steps = F.floor((epoch_seconds(F.max("ts")) - epoch_seconds(F.min("ts"))) / freq.seconds)
    else:
        steps = freq.index(F.max("ts")) - freq.index(F.min("ts"))
    stats = panel.groupBy(*by).agg(
        F.min("ts").alias("first_ts"),
        F.max("ts").alias("last_ts"),
        (steps + 1).cast("bigint").alias("expected"),
        F.count(F.lit(1)).alias("found"),
    )
    return stats.withColumn("missing", F.col("expected") - F.col("found"))


def gaps(panel: DataFrame, freq: str = "H", by: Sequence[str] = SERIES) -> DataFrame:
    """Every pair of successive rows more than one step apart.

    Result: ``by..., gap_start, gap_end, gap_seconds``.  The row before a chunk's
    first one is found from the chunk summaries.
    """
    freq = frequency(freq)
    across = Window.partitionBy(*by)
    rows = panel.select(*by, "ts", freq.index(F.col("ts")).alias("k"))
    rows = rows.withColumn("chunk", chunk_of(panel, F.col("k"))).repartition(*by, "chunk")
    edge = rows.groupBy(*by, "chunk").agg(F.max("ts").alias("_last"))
    edge = edge.select(
        *by, "chunk", F.lag("_last").over(across.orderBy("chunk")).alias("_before")
    )
    prev = F.coalesce(F.lag("ts").over(within_chunk(by).orderBy("ts")), F.col("_before"))
    wide = rows.join(edge, [*by, "chunk"]).withColumn("gap_start", prev)
    seconds = epoch_seconds(F.col("ts")) - epoch_seconds(F.col("gap_start"))
    if freq.seconds:
        large = seconds > freq.seconds
    else:
        large = freq.index(F.col("ts")) - freq.index(F.col("gap_start")) > 1
    return wide.where(large).select(
        *by, "gap_start", F.col("ts").alias("gap_end"), seconds.alias("gap_seconds")
    )


def gap_report(
    panel: DataFrame, freq: str = "H", first: int = 5, by: Sequence[str] = SERIES
) -> DataFrame:
    """Number of gaps, the longest one and the first few, one row per listed gap.

    Only the bounded head list is kept while aggregating: the earliest gaps per
    chunk are ranked first, then those survivors per series.
    """
    found = gaps(panel, freq, by)
    found = found.withColumn("chunk", chunk_of(panel, frequency(freq).index(F.col("gap_end"))))
    ranked = found.withColumn(
        "_local", F.row_number().over(within_chunk(by).orderBy("gap_end"))
    )
    totals = found.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_gaps"), F.max("gap_seconds").alias("max_gap_seconds")
    )
    head = Window.partitionBy(*by).orderBy("gap_end")
    listed = (
        ranked.where(F.col("_local") <= first)
        .withColumn("gap_no", F.row_number().over(head).cast("bigint"))
        .where(F.col("gap_no") <= first)
    )
    return listed.join(totals, list(by)).select(
        *by, "n_gaps", "max_gap_seconds", "gap_no", "gap_start", "gap_end", "gap_seconds"
    )


def null_counts(
    grid: DataFrame, cols: Sequence[str] = ("P", "Q"), by: Sequence[str] = SERIES
) -> DataFrame:
    return grid.groupBy(*by).agg(
        F.count(F.lit(1)).alias("rows"),
        *[F.count_if(F.col(c).isNull()).alias(f"{c}_nulls") for c in cols],
    )


def missing_map(
    grid: DataFrame, cols: Sequence[str] = ("P", "Q"), by: Sequence[str] = SERIES
) -> DataFrame:
    """0/1 missingness in long form: one row per series, step and column."""
    flags = [
        F.struct(F.lit(c).alias("column"), F.col(c).isNull().cast("int").alias("is_missing"))
        for c in cols
    ]
    return grid.select(*by, "k", F.inline(F.array(*flags)))


def nonfinite_counts(
    df: DataFrame, cols: Sequence[str] = ("P", "Q"), by: Sequence[str] = SERIES
) -> DataFrame:
    """NaN and infinity counts; guards model inputs."""
    return df.groupBy(*by).agg(
        *[F.count_if(F.isnan(c)).alias(f"{c}_nan") for c in cols],
        *[F.count_if(F.abs(c) == F.lit(float("inf"))).alias(f"{c}_inf") for c in cols],
    )


def lagged_cells(df: DataFrame, cols: Sequence[str], steps: int, by: Sequence[str] = SERIES):
    """``{c}__lag``: the value ``steps`` grid steps earlier."""
    w = within_chunk(by).orderBy("k")
    wide = halo(df, before=steps, by=by).withColumns({f"{c}__lag": F.lag(c, steps).over(w) for c in cols})
    return owned(wide)
