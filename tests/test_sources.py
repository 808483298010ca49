from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from tidepanel.sources import generator, readers, sinks


def test_detection_avoids_substring_traps():
    assert readers.detect_time_column(["id", "Timestamp", "P"]) == "Timestamp"
    assert readers.detect_time_column(["id", "x"]) is None
    assert readers.detect_pq_columns(["timestamp", "temperature", "P", "Q"]) == ("P", "Q")
    assert readers.detect_pq_columns(["reactive_power", "active_power"]) == ("active_power", "reactive_power")
    assert readers.detect_pq_columns(["时间", "有功功率", "无功功率"]) == ("有功功率", "无功功率")
    assert readers.detect_pq_columns(["time", "frequency"]) == (None, None)


def csv(spark, tmp_path, text, name="a.csv"):
    (tmp_path / name).write_text(text, encoding="utf-8")
    return str(tmp_path)


def test_load_panel_from_csv(spark, tmp_path):
    folder = csv(spark, tmp_path, "时间,有功,无功,定子电流\n2024-01-01 00:00:00,1.5,x,7\n2024-01-01 01:00:00,nan,2,8\n")
    raw = readers.read_table(spark, folder, glob="*.csv")
    with pytest.warns(UserWarning, match="skipped"):
        out = readers.load_panel(raw, exog=["定子电流", "missing"]).orderBy("ts").collect()
    assert [(r.P, r.Q, r["定子电流"]) for r in out] == [(1.5, None, 7.0), (None, 2.0, 8.0)]


def test_bad_time_raises_or_drops(spark, tmp_path):
    folder = csv(spark, tmp_path, "time,p,q\n2024-13-01,1,1\n2024-01-02,2,2\n")
    raw = readers.read_table(spark, folder, glob="*.csv")
    with pytest.raises(Exception, match="bad timestamp"):
        readers.load_panel(raw).collect()
    assert readers.load_panel(raw, on_bad_time="drop").count() == 1
    rejects = raw.select(readers.count_rejects(F.col("time"), readers.parse_time(F.col("time"))))
    assert rejects.first()[0] == 1


def test_missing_roles_and_formats(spark, tmp_path):
    folder = csv(spark, tmp_path, "time,p\n2024-01-01,1\n")
    with pytest.raises(ValueError, match="P and Q"):
        readers.load_panel(readers.read_table(spark, folder, glob="*.csv"))
    with pytest.raises(ValueError, match="Unsupported"):
        readers.read_table(spark, "x.json")


def test_glob_reads_every_match(spark, tmp_path):
    csv(spark, tmp_path, "time,p,q\n2024-01-01,1,1\n", "one.csv")
    folder = csv(spark, tmp_path, "time,p,q\n2024-01-01,2,2\n", "two.csv")
    rows = readers.with_file_series(readers.read_table(spark, folder, glob="*.csv")).collect()
    assert {r.sid for r in rows} == {"one.csv", "two.csv"}


def test_localize_rejects_clock_times_without_one_instant(spark):
    def run(text):
        df = spark.createDataFrame([(text,)], "t string")
        return df.select(readers.localize(F.col("t").cast("timestamp_ntz"), "Europe/Berlin")).first()[0]

    assert run("2024-07-01 12:00:00").hour == 10
    for bad in ("2024-03-31 02:30:00", "2024-10-27 02:30:00"):
        with pytest.raises(Exception, match="no unique time"):
            run(bad)


def test_generator_noise_and_missing_share(spark):
    series = spark.range(20).select(F.col("id").cast("string").alias("sid"))
    df = generator.generate_panel(series, n_days=30)
    row = df.agg(
        F.count("*").alias("n"), F.count_if(F.col("P").isNull()).alias("p"),
        F.count_if(F.col("Q").isNull()).alias("q"), F.min("P").alias("low"),
        F.count_if(F.col("Q").isNull() & F.col("P").isNotNull()).alias("alone"),
    ).first()
    assert row.n == 20 * 720 and row.low >= 0 and row.alone == 0
    assert 0.005 < row.p / row.n < 0.015 and 0.002 < row.q / row.n < 0.008
    assert generator.generate_panel(series.limit(1), 1, "15T").count() == 96


def test_forecast_and_results_round_trip(spark, tmp_path):
    df = spark.sql("SELECT 'a' AS sid, 1 AS step, timestamp_ntz'2024-01-01 05:00:00' AS ts, 1.25D AS yhat")
    sinks.write_forecast(df, str(tmp_path / "f"))
    assert sinks.read_forecast(spark, str(tmp_path / "f")).collect() == df.collect()
    res = df.select(F.lit("s").alias("strategy"), "yhat")
    sinks.write_results(res, str(tmp_path / "r"))
    assert sinks.read_results(spark, str(tmp_path / "r")).first().strategy == "s"


@pytest.mark.parametrize("master", ["yarn", "k8s://https://host:443", "spark://host:7077", "local-cluster[2,1,512]"])
def test_clusters_must_name_a_shared_folder(master):
    session = lambda conf: SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master=master))
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        sinks.shared_dir(session({}))
    assert sinks.shared_dir(session({"spark.checkpoint.dir": "s3a://bucket/x"})) == "s3a://bucket/x"
