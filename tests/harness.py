"""Run registered queries against their SQL on DuckDB."""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb
import pandas as pd

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

ROOT = Path("/root/testdata")


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in sorted(Path(sf_dir).glob("*.parquet")):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM read_parquet('{path}')")
    return con


def _cell(v):
    if v is None or v is pd.NaT:
        return None
    if hasattr(v, "item"):
        v = v.item()
    if isinstance(v, float):
        if math.isnan(v):
            return None
        return v + 0.0
    if isinstance(v, pd.Timestamp):
        return v.to_pydatetime()
    return v


def rows_of(pdf: pd.DataFrame) -> list[tuple]:
    pdf = pdf[sorted(pdf.columns)]
    cells = [tuple(_cell(v) for v in row) for row in pdf.itertuples(index=False, name=None)]
    return sorted(cells, key=lambda r: tuple((v is None, str(type(v)), v) for v in r))


def compare(spark_pdf: pd.DataFrame, duck_pdf: pd.DataFrame) -> str:
    """Empty when equal, else what differs; values must match exactly."""
    if sorted(spark_pdf.columns) != sorted(duck_pdf.columns):
        return f"columns {sorted(spark_pdf.columns)} vs {sorted(duck_pdf.columns)}"
    if len(spark_pdf) != len(duck_pdf):
        return f"rows {len(spark_pdf)} vs {len(duck_pdf)}"
    a, b = rows_of(spark_pdf), rows_of(duck_pdf)
    bad = [(x, y) for x, y in zip(a, b) if x != y]
    return f"{len(bad)} rows differ, first {bad[0]}" if bad else ""


def check(spark, sf_dir: str, names=None) -> dict[str, str]:
    import __spark_entry__ as entry

    queries, oracle = entry.queries(), entry.oracle_sql()
    con = duck(sf_dir)
    out = {}
    for name in names or queries:
        start = time.time()
        try:
            got = queries[name](spark, sf_dir).toPandas()
            took = time.time() - start
            if name in oracle:
                out[name] = compare(got, con.execute(oracle[name]).df())
            else:
                out[name] = "" if len(got) else "no rows"
            note = f"rows={len(got)}" + ("" if name in oracle else " (rows only)")
        except Exception as e:  # report every query, then go on
            took, note = time.time() - start, ""
            out[name] = f"{type(e).__name__}: {str(e)[:1500]}"
        print(f"{'ok  ' if not out[name] else 'FAIL'} {name} {took:.1f}s {note} {out[name]}", flush=True)
    return out


if __name__ == "__main__":
    from pyspark.sql import SparkSession

    sf, *wanted = sys.argv[1:]
    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "12g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    import os

    if os.environ.get("CHUNK"):
        spark.conf.set("tidepanel.chunkRows", os.environ["CHUNK"])
    result = check(spark, str(ROOT / f"sf{sf}"), wanted or None)
    print({"ok": sum(not v for v in result.values()), "of": len(result)})
