"""Rolling-origin cross-validation: growing train part, fixed test windows."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidepanel.functions.timeaxis import floor_div, frequency
from tidepanel.operators.chunks import SERIES, positions


@dataclass(frozen=True)
class RollingOrigin:
    """Split settings; positions follow from the series length alone.

    Fold i trains on rows [0, first + i*test_window) and tests the next
    ``test_window`` rows after ``gap``.  ``short`` says what happens to a series
    without enough rows: ``"error"`` or ``"skip"``.
    """

    test_window: int
    n_splits: int
    gap: int = 0
    short: str = "error"

    def __post_init__(self):
        if self.test_window <= 0 or self.n_splits <= 0:
            raise ValueError("test_window and n_splits must be positive")
        if self.short not in ("error", "skip"):
            raise ValueError("short must be 'error' or 'skip'")

    @property
    def min_rows(self) -> int:
        return self.test_window * (self.n_splits + 1) + self.gap

    def first_train(self, n: Column) -> Column:
        return n - self.test_window * self.n_splits - self.gap

    def train_end(self, n: Column, fold: Column) -> Column:
        return self.first_train(n) + fold * self.test_window

    def usable(self, n: Column) -> Column:
        """True for long enough series; raises otherwise unless short series are skipped."""
        enough = n >= self.min_rows
        if self.short == "skip":
            return enough
        message = F.concat(
            F.lit(f"Not enough samples: need at least {self.min_rows}, got "), n.cast("string")
        )
        return F.when(enough, F.lit(True)).otherwise(F.raise_error(message).cast("boolean"))

    def test_fold(self, rn: Column, n: Column) -> Column:
        """Fold testing the row at ``rn``, NULL if none; test windows are disjoint."""
        offset = rn - self.first_train(n) - self.gap
        return F.when(offset >= 0, floor_div(offset, self.test_window)).cast("int")

    def folds(self, lengths: DataFrame, by: Sequence[str] = SERIES) -> DataFrame:
        """``by..., fold, train_end, test_start, test_end`` from ``by..., n``."""
        fold = F.explode(F.sequence(F.lit(0), F.lit(self.n_splits - 1)))
        cut = self.train_end(F.col("n"), F.col("fold"))
        return (
            lengths.where(self.usable(F.col("n")))
            .withColumn("fold", fold)
            .select(
                *by,
                "fold",
                cut.alias("train_end"),
                (cut + self.gap).alias("test_start"),
                (cut + self.gap + self.test_window).alias("test_end"),
            )
        )

    def assign(self, rows: DataFrame, by: Sequence[str] = SERIES) -> DataFrame:
        """Every row once per fold it takes part in, with ``fold`` and ``role``."""
        ranked = rows if {"rn", "n"} <= set(rows.columns) else positions(rows, by)
        fold = F.explode(F.sequence(F.lit(0), F.lit(self.n_splits - 1)))
        cut = self.train_end(F.col("n"), F.col("fold"))
        begin = cut + self.gap
        role = F.when(F.col("rn") < cut, F.lit("train")).when(
            (F.col("rn") >= begin) & (F.col("rn") < begin + self.test_window), F.lit("test")
        )
        out = ranked.where(self.usable(F.col("n"))).withColumn("fold", fold)
        return out.withColumn("role", role).where(F.col("role").isNotNull())

    def split(
        self, rows: DataFrame, by: Sequence[str] = SERIES
    ) -> Iterator[tuple[DataFrame, DataFrame]]:
        """One ``(train, test)`` pair of frames per fold."""
        ranked = rows if {"rn", "n"} <= set(rows.columns) else positions(rows, by)
        ranked = ranked.where(self.usable(F.col("n")))
        for i in range(self.n_splits):
            cut = self.train_end(F.col("n"), F.lit(i))
            begin = cut + self.gap
            yield (
                ranked.where(F.col("rn") < cut),
                ranked.where(
                    (F.col("rn") >= begin) & (F.col("rn") < begin + self.test_window)
                ),
            )

    def get_n_splits(self) -> int:
        return self.n_splits


def series_lengths(rows: DataFrame, by: Sequence[str] = SERIES) -> DataFrame:
    return rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))


def leak_check(
    assigned: DataFrame, freq: str = "H", by: Sequence[str] = SERIES
) -> DataFrame:
    """Last training and first test time of each fold, and whether they are in order."""
    train = F.max(F.when(F.col("role") == "train", F.col("k")))
    test = F.min(F.when(F.col("role") == "test", F.col("k")))
    edges = assigned.groupBy(*by, "fold").agg(train.alias("_train"), test.alias("_test"))
    stamp = frequency(freq).stamp
    return edges.select(
        *by,
        "fold",
        stamp(F.col("_train")).alias("train_last"),
        stamp(F.col("_test")).alias("test_first"),
        (F.col("_train") < F.col("_test")).alias("in_order"),
    )
