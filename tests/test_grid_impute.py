import math
import re

import numpy as np
import pandas as pd
import pytest
from frames import at, column, gridded, panel
from pyspark.sql import functions as F

from tidepanel.functions.timeaxis import epoch_seconds, frequency
from tidepanel.operators import grid, impute
from tidepanel.operators.median import exact_median, order_key

HOLES = [None, None, 1, None, 4, None, None]


def filled(spark, method, values=HOLES, name="P", **options):
    return column(impute.impute(gridded(spark, a=values), method, **options), name)


def ragged(spark, n=60, seed=3):
    rng = np.random.default_rng(seed)
    values = rng.normal(50, 10, n).round(2)
    return [None if m else float(v) for v, m in zip(values, rng.random(n) < 0.4)]


def test_grid_drops_off_grid_rows_and_fills_steps(spark):
    rows = [("a", at(h), 1.0, 2.0) for h in (1 / 6, 1, 3, 3.5)]
    df = spark.createDataFrame(rows, "sid string, ts timestamp_ntz, P double, Q double")
    out = grid.with_time(grid.regular_grid(df, "H")).orderBy("k").collect()
    assert [r.ts.hour for r in out] == [0, 1, 2, 3]
    assert [r.P for r in out] == [None, 1.0, None, 1.0]


def test_grid_raises_on_duplicates(spark):
    df = spark.createDataFrame(
        [("a", at(0), 1.0, 2.0), ("a", at(0), 3.0, 4.0)],
        "sid string, ts timestamp_ntz, P double, Q double",
    )
    with pytest.raises(Exception, match="duplicate timestamps"):
        grid.regular_grid(df, "H").collect()


def test_grid_spans_empty_chunks(spark):
    df = spark.createDataFrame(
        [("a", at(0), 1.0, 1.0), ("a", at(37), 2.0, 2.0), ("b", at(5), 7.0, 7.0)],
        "sid string, ts timestamp_ntz, P double, Q double",
    )
    out = grid.regular_grid(df, "H")
    assert out.where("sid = 'a'").count() == 38
    assert out.where("sid = 'b'").count() == 1
    assert column(impute.impute(out, "forward")) == [1.0] * 37 + [2.0]


@pytest.mark.parametrize("name", ["H", "D", "T", "15T", "30T", "W", "M"])
def test_frequency_round_trip_before_and_after_1970(spark, name):
    freq = frequency(name)
    stamps = pd.to_datetime(["1969-12-30 23:59:59.5", "1970-01-01", "2024-02-29 12:34:56"], format="ISO8601")
    df = spark.createDataFrame([(t.to_pydatetime(),) for t in stamps], "ts timestamp_ntz")
    k = freq.index(F.col("ts"))
    rows = df.select("ts", k.alias("k"), freq.stamp(k).alias("label"), epoch_seconds(F.col("ts")).alias("s")).collect()
    for r in rows:
        t = pd.Timestamp(r.ts)
        assert r.s == math.floor(t.timestamp())
        if name == "W":
            want = t.normalize() + pd.Timedelta(days=6 - t.weekday())
        elif name == "M":
            want = t.normalize() + pd.offsets.MonthEnd(0)
        else:
            want = t.floor({"H": "h", "D": "D", "T": "min", "15T": "15min", "30T": "30min"}[name])
        assert pd.Timestamp(r.label) == want


def test_unknown_frequency():
    with pytest.raises(ValueError):
        frequency("2H")


def test_coverage_and_gaps(spark):
    df = panel(spark, a=[1, 2]).unionByName(
        spark.createDataFrame([("a", at(9), 1.0, 1.0)], "sid string, ts timestamp_ntz, P double, Q double")
    )
    row = grid.coverage(df).first()
    assert (row.expected, row.found, row.missing) == (10, 3, 7)
    gap = grid.gap_report(df).collect()
    assert len(gap) == 1 and gap[0].gap_seconds == 8 * 3600 and gap[0].gap_start == at(1)


def test_directional_fills(spark):
    assert filled(spark, "forward") == [None, None, 1, 1, 4, 4, 4]
    assert filled(spark, "backward") == [1, 1, 1, 4, 4, None, None]
    assert filled(spark, "interpolate") == [None, None, 1, 2.5, 4, 4, 4]
    assert filled(spark, "interpolate", both=True) == [1, 1, 1, 2.5, 4, 4, 4]
    assert filled(spark, "forward", limit=1) == [None, None, 1, 1, 4, 4, None]


def test_mean_and_median(spark):
    assert filled(spark, "mean") == [2.5, 2.5, 1, 2.5, 4, 2.5, 2.5]
    assert filled(spark, "median", [3, None, 1, 2]) == [3, 2, 1, 2]
    assert filled(spark, "median", [3, None, 1, 2, 10]) == [3, 2.5, 1, 2, 10]


@pytest.mark.parametrize("method", ["forward", "backward", "interpolate", "mean", "median", "nearest_p", "seasonal"])
def test_all_null_series_stays_null(spark, method):
    assert filled(spark, method, [None] * 6) == [None] * 6


def test_nearest_p_uses_earliest_nearest_complete_row(spark):
    assert filled(spark, "nearest_p", [270, None, 290], target_p=280.0) == [270, 270, 290]
    assert filled(spark, "nearest_p", [270, None, 290], "Q", target_p=280.0)[1] == 2700
    half = gridded(spark, a=[1, 2]).withColumn("Q", F.lit(None).cast("double"))
    assert column(impute.impute(half, "nearest_p"), "Q") == [None, None]


def test_day_copy_does_not_cascade(spark):
    values = [float(i) for i in range(24 * 3)]
    values[30] = None  # its donor is row 6
    values[54] = None  # its donor is row 30, missing itself
    got = filled(spark, "day_copy", values, days_back=1, freq="H")
    assert got[30] == 6 and got[54] is None


def test_seasonal_short_series_interpolates(spark):
    assert filled(spark, "seasonal", [1, None, 3, 4, 5], period=4) == [1, 2, 3, 4, 5]


@pytest.mark.parametrize("period", [4, 5])
@pytest.mark.parametrize("mode", ["component", "level"])
def test_seasonal_matches_plain_formula(spark, period, mode):
    values = ragged(spark)
    s = pd.Series(values, dtype=float)
    full = s.interpolate(limit_direction="both").to_numpy()
    half = period // 2
    kernel = np.ones(period) / period
    if period % 2 == 0:
        kernel = np.array([0.5, *[1.0] * (period - 1), 0.5]) / period
    trend = np.full(len(full), np.nan)
    trend[half : len(full) - half] = np.convolve(full, kernel, "valid")
    phase = np.arange(len(full)) % period
    means = np.array([np.nanmean((full - trend)[phase == p]) for p in range(period)])
    season = (means - means.mean())[phase]
    level = np.where(np.isnan(trend), full, trend + season)
    want = s.fillna(pd.Series(season if mode == "component" else level))
    got = filled(spark, "seasonal", values, period=period, mode=mode)
    assert np.allclose(got, want)


@pytest.mark.parametrize("method", ["forward", "backward", "interpolate", "mean", "median"])
def test_fills_match_pandas(spark, method):
    values = ragged(spark)
    s = pd.Series(values, dtype=float)
    want = {
        "forward": s.ffill,
        "backward": s.bfill,
        "interpolate": s.interpolate,
        "mean": lambda: s.fillna(s.mean()),
        "median": lambda: s.fillna(s.median()),
    }[method]()
    got = pd.Series(filled(spark, method, values), dtype=float)
    assert np.allclose(got, want, equal_nan=True)


def test_present_values_never_change_and_series_do_not_mix(spark):
    a, b = ragged(spark, seed=1), ragged(spark, n=23, seed=2)
    both = gridded(spark, a=a, b=b)
    for method in impute.METHODS:
        options = {"freq": "H"} if method == "day_copy" else {}
        out = impute.impute(both, method, **options)
        alone = impute.impute(gridded(spark, b=b), method, **options)
        assert column(out, sid="b") == column(alone, sid="b")
        for before, after in zip(a, column(out)):
            assert before is None or before == after


@pytest.mark.parametrize("method", list(impute.METHODS))
def test_chunk_size_does_not_matter(spark, method):
    df = panel(spark, a=ragged(spark, 90), b=ragged(spark, 31, 9))
    out = []
    for size in ("3", "7", "1000"):
        spark.conf.set("tidepanel.chunkRows", size)
        options = {"seasonal": {"period": 6}, "day_copy": {"freq": "H"}}.get(method, {})
        got = impute.impute(grid.regular_grid(df), method, **options)
        out.append(column(got) + column(got, "Q", "b"))
    assert np.allclose(np.array(out[0], float), np.array(out[1], float), equal_nan=True)
    assert np.allclose(np.array(out[0], float), np.array(out[2], float), equal_nan=True)


def test_exact_median_with_ties_and_heavy_tail(spark):
    rng = np.random.default_rng(0)
    heavy = np.exp(rng.normal(0, 6, 301))
    ties = np.array([5.0] * 180 + list(range(121)))
    for values in (heavy, heavy[:300], ties, -heavy):
        df = gridded(spark, a=[float(v) for v in values])
        got = exact_median(df, ["P"]).first()["P__median"]
        assert got == pytest.approx(float(np.median(values)), rel=1e-12)


def test_exact_median_of_any_doubles(spark):
    rng = np.random.default_rng(1)
    odd = [1e300, -1e300, 5e-324, -5e-324, 2.2250738585072014e-308, 0.0, -0.0, 1.0, float("inf"), -float("inf"), 1.7e308, 1.6e308]
    powers = [float(2.0**e) for e in range(-1074, 1024, 37)] + [float(np.nextafter(2.0**e, 0)) for e in range(-1000, 1024, 41)]
    wild = [float(x) for x in rng.integers(-(2**63), 2**63, 200).view(np.float64) if np.isfinite(x)]
    lists = (odd, odd[:-1], powers, [-x for x in powers], wild, wild[:-1], [1e300] * 3 + [1.0, 2.0], [7.0], [1.7e308, 1.6e308], [3.0, None])
    df = gridded(spark, **{f"s{i}": values for i, values in enumerate(lists)})
    got = {r.sid: r["P__median"] for r in exact_median(df, ["P"]).collect()}
    for i, values in enumerate(lists):
        values = sorted(v for v in values if v is not None)
        low, high = values[(len(values) - 1) // 2], values[len(values) // 2]
        assert got[f"s{i}"] in (low / 2 + high / 2, (low + high) / 2)


def test_order_key_keeps_the_order(spark):
    values = sorted([0.0, 5e-324, 1e-310, 2.2250738585072014e-308, 1e-5, 0.1, 1.0, 1.5, 2.0, 3.0, 1e300, 1.797e308, float("inf")])
    rows = spark.createDataFrame([(x,) for x in values] + [(-x,) for x in values[1:]], "x double")
    got = rows.select("x", order_key(F.col("x")).alias("k")).orderBy("x").collect()
    assert all(a.k < b.k for a, b in zip(got, got[1:]))
    bits = {r.x: r.k for r in got}
    assert all(bits[x] == int(np.float64(x).view(np.int64)) for x in values)


def test_no_sort_of_values_in_the_median(spark):
    plan = exact_median(gridded(spark, a=[1, 2, 3]), ["P"])._jdf.queryExecution().executedPlan().toString()
    assert "Window" in plan and not re.search(r"Sort \[[^\]]*\b(v|_lo)#", plan)


def test_unknown_method(spark):
    with pytest.raises(ValueError, match="Unknown imputation method"):
        impute.impute(gridded(spark, a=[1]), "spline")
