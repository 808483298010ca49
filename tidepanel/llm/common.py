"""Small helpers shared by the corpus operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The six ASCII whitespace characters: space and tab to carriage return.
BLANKS = " \t\n\x0b\f\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()


def table(spark, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def text_of(c: str) -> Column:
    """The text, or the empty string where it is null."""
    return F.coalesce(F.col(c).cast("string"), F.lit(""))


def digest(c: Column, seed: int) -> Column:
    """64-bit digest of a column; digests of different seeds are independent."""
    return F.xxhash64(F.lit(seed), c)


def cell_count(rows: int, groups: int, least: int = 64, full: int = 4096) -> int:
    """Into how many cells each of ``groups`` is cut so that a cell holds about ``full`` rows."""
    return max(least, -(-rows // (max(groups, 1) * full)))


def restrict(docs: DataFrame, keep: DataFrame, key: str) -> DataFrame:
    """Rows of ``docs`` whose key is in ``keep``, all columns kept; a null key matches a null key."""
    wanted = keep.select(F.col(key).alias("_wanted")).distinct()
    return docs.join(wanted, docs[key].eqNullSafe(wanted["_wanted"]), "left_semi")
