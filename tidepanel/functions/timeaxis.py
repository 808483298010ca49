"""Regular time axes as integer steps.

A frequency maps a wall-clock timestamp (``timestamp_ntz``) to a step number and
back.  Steps are plain bigint arithmetic counted from 1970, so lags, chunks and
gaps need no window and do not depend on the session time zone.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

_DAY = 86_400
_TO_1970 = 62_135_596_800  # seconds from year 1 to 1970

# Supported frequency names and their length in seconds.
_SECONDS = {"H": 3600, "D": 86_400, "T": 60, "15T": 900, "30T": 1800}
_CALENDAR = ("W", "M")


def floor_div(a: Column, b: int) -> Column:
    """Integer division rounding towards minus infinity, exact below 2**53.

    The operand appears once: step arithmetic nests, and Catalyst would otherwise
    work on exponentially large expressions.
    """
    return F.floor(a / F.lit(b))


def epoch_seconds(ts: Column) -> Column:
    """Whole wall-clock seconds since 1970-01-01 00:00, independent of the session zone.

    Counted from year 1 because interval casts truncate towards zero.
    """
    return (ts - F.lit("0001-01-01 00:00:00").cast("timestamp_ntz")).cast("bigint") - _TO_1970


def from_epoch_seconds(seconds: Column) -> Column:
    origin = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    return origin + F.make_dt_interval(secs=seconds)


@dataclass(frozen=True)
class Frequency:
    """One step of a time axis; weeks end on Sunday, months on their last day."""

    name: str

    @property
    def seconds(self) -> int | None:
        return _SECONDS.get(self.name)

    def index(self, ts: Column) -> Column:
        """Step number holding ``ts``."""
        if self.seconds:
            return floor_div(epoch_seconds(ts), self.seconds)
        day = F.unix_date(ts.cast("date")).cast("bigint")
        if self.name == "W":
            return floor_div(day + 3, 7)
        return (F.year(ts) * 12 + F.month(ts) - 1).cast("bigint")

    def stamp(self, step: Column) -> Column:
        """Timestamp labelling a step: its start, or the period end for W and M."""
        if self.seconds:
            return from_epoch_seconds(step * self.seconds)
        if self.name == "W":
            return from_epoch_seconds((step * 7 + 3) * _DAY)
        year, month = floor_div(step, 12).cast("int"), (F.pmod(step, F.lit(12)) + 1).cast("int")
        return F.last_day(F.make_date(year, month, F.lit(1))).cast("timestamp_ntz")

    def on_grid(self, ts: Column) -> Column:
        return self.stamp(self.index(ts)) == ts

    def steps_per_days(self, days: int) -> int:
        """How many steps lie in ``days`` days; raises if that is not a whole number."""
        width = self.seconds or (7 * _DAY if self.name == "W" else 0)
        if not width or (days * _DAY) % width:
            raise ValueError(f"{days} days are not a whole number of {self.name} steps")
        return days * _DAY // width


def frequency(freq: str | Frequency) -> Frequency:
    if isinstance(freq, Frequency):
        return freq
    name = freq.upper()
    if name not in _SECONDS and name not in _CALENDAR:
        raise ValueError(f"Unsupported frequency {freq!r}; choose from {[*_SECONDS, *_CALENDAR]}")
    return Frequency(name)


def calendar_columns(ts: Column) -> dict[str, Column]:
    """Sine and cosine of hour of day, weekday (Monday = 0) and month."""
    turn = 2 * F.pi()
    cycles = {
        "hour": turn * F.hour(ts) / 24,
        "dow": turn * F.weekday(ts) / 7,
        "month": turn * F.month(ts) / 12,
    }
    return {
        f"{name}_{fn.__name__}": fn(angle) for name, angle in cycles.items() for fn in (F.sin, F.cos)
    }
