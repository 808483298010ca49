"""Exact median per series by radix selection, without sorting or gathering values.

A double maps to a signed 64-bit key of the same order (its bits).  Four rounds of 16 bits
each count the keys per digit and keep the digit that holds the lower middle rank; after
the last round what is left is one value.  A round's table has at most 65 536 rows per
series and column, whatever the values, so a tie of a billion rows, a heavy tail or 1e300
beside ordinary numbers change nothing.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidepanel.operators.chunks import SERIES, attach

DIGIT = 16
#: Exponent bias and mantissa bits of a double; smallest normal double.
BIAS, MANTISSA, NORMAL = 1023, 52, 2.2250738585072014e-308


def order_key(value: Column) -> Column:
    """The bits of a double as a signed number of the same order; both zeros are 0.

    Found by exact arithmetic: dividing by a power of two loses nothing.
    """
    size = F.abs(value)
    exponent = F.least(F.floor(F.log2(size)), F.lit(BIAS))
    ratio = size / F.pow(F.lit(2.0), exponent)
    # the logarithm may round over a power of two: then the next exponent is meant
    part = F.when(ratio < 1, 2 * ratio - 2).when(ratio >= 2, ratio / 2).otherwise(ratio - 1)
    tiny = (size * 2.0**537 * 2.0**537).cast("bigint")
    whole = F.shiftleft((exponent + BIAS).cast("bigint"), MANTISSA) + (part * float(1 << MANTISSA)).cast("bigint")
    infinite = F.lit((2 * BIAS + 1) << MANTISSA)
    bits = F.when(size < NORMAL, tiny).when(size == float("inf"), infinite).otherwise(whole)
    return F.when(value < 0, -bits).otherwise(bits)


def exact_median(df: DataFrame, cols: Sequence[str], by: Sequence[str] = SERIES) -> DataFrame:
    """``by..., {c}__median`` for each column; NULL for an all-NULL column."""
    key = [*by, "column"]
    pairs = [F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("v")) for c in cols]
    cells = df.select(*by, "chunk", F.inline(F.array(*pairs))).where(F.col("v").isNotNull())
    cells = cells.withColumn("_key", order_key(F.col("v")))
    partial = cells.groupBy(*key, "chunk").agg(F.count("v").alias("_n"))
    across = Window.partitionBy(*key)
    # state: digits found so far, rows below them, the two middle ranks, the next value above
    state = partial.groupBy(*key).agg(F.sum("_n").alias("rows")).select(
        *key,
        F.lit(0).cast("bigint").alias("prefix"),
        F.lit(0).cast("bigint").alias("below"),
        F.floor((F.col("rows") - 1) / 2).alias("r1"),
        F.floor(F.col("rows") / 2).alias("r2"),
        F.lit(None).cast("double").alias("upper"),
        F.lit(None).cast("double").alias("lower"),
    )
    chunks = partial.select(*key, "chunk")
    carried = ["below", "r1", "r2", "upper"]
    for shift in range(64 - DIGIT, -1, -DIGIT):
        rows = attach(cells, chunks.join(state, key), key)
        if shift + DIGIT < 64:
            rows = rows.where(F.shiftright("_key", shift + DIGIT) == F.col("prefix"))
        digit = F.shiftright("_key", shift).alias("digit")
        hist = rows.groupBy(*key, *carried, digit).agg(F.count("v").alias("_n"), F.min("v").alias("_lo"))
        upto = across.orderBy("digit").rowsBetween(Window.unboundedPreceding, 0)
        hist = hist.withColumns(
            {
                "_end": F.col("below") + F.sum("_n").over(upto),
                "_above": F.lead("_lo").over(across.orderBy("digit")),
            }
        ).withColumn("_start", F.col("_end") - F.col("_n"))
        # keep the digit of the lower rank; the upper rank may open the next digit
        state = hist.where((F.col("r1") >= F.col("_start")) & (F.col("r1") < F.col("_end"))).select(
            *key,
            F.col("digit").alias("prefix"),
            F.col("_start").alias("below"),
            "r1",
            "r2",
            F.when(F.col("r2") >= F.col("_end"), F.coalesce("_above", "upper"))
            .otherwise(F.col("upper"))
            .alias("upper"),
            F.col("_lo").alias("lower"),
        )
    middle = F.col("lower") / 2 + F.coalesce("upper", "lower") / 2
    exact = (F.col("lower") + F.coalesce("upper", "lower")) / 2
    # halves first only where the sum would overflow
    state = state.withColumn("m", F.when(F.abs(exact) < float("inf"), exact).otherwise(middle))
    return state.groupBy(*by).agg(
        *[F.max(F.when(F.col("column") == c, F.col("m"))).alias(f"{c}__median") for c in cols]
    )
