"""Writing forecasts, results and models; scratch space and lineage cuts."""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from tidepanel.functions import numbers


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir`` of the session.

    A local session without the setting gets a folder below its warehouse; on a
    cluster that folder might be one machine's own, so the setting is required.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        warehouse = spark.conf.get("spark.sql.warehouse.dir").rstrip("/")
        folder = f"{warehouse}/checkpoints"
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; what is written there goes when the session's JVM ends."""
    path = f"{shared_dir(spark).rstrip('/')}/tidepanel/{name}-{uuid.uuid4().hex}"
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = hadoop.getFileSystem(spark._jsc.hadoopConfiguration())
    files.mkdirs(hadoop)  # only paths that exist can be marked
    files.deleteOnExit(hadoop)
    return path


def exists(spark: SparkSession, path: str) -> bool:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop)


@contextmanager
def released_shuffles(spark: SparkSession):
    """Queries that start in here give up their shuffle files when they end."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, "false")
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def materialize(df: DataFrame, name: str = "stage", partition_by: Sequence[str] = ()) -> DataFrame:
    """Write to the shared folder and read back: a lineage cut that survives lost executors.

    Nothing reads the shuffles again once the table stands, so they leave the disks.
    """
    path = scratch_path(df.sparkSession, name)
    with released_shuffles(df.sparkSession):
        df.write.mode("overwrite").partitionBy(*partition_by).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def write_forecast(
    forecast: DataFrame, path: str, fmt: str = "csv", partition_by: Sequence[str] = ()
) -> None:
    """Forecast table with a header; ``fmt`` is csv or parquet."""
    writer = forecast.write.mode("overwrite").partitionBy(*partition_by)
    if fmt == "csv":
        writer.option("header", True).csv(path)
    else:
        writer.format(fmt).save(path)


def read_forecast(spark: SparkSession, path: str) -> DataFrame:
    return (
        spark.read.option("header", True)
        .schema("sid string, step int, ts timestamp_ntz, yhat double")
        .csv(path)
    )


def write_results(results: DataFrame, path: str, partition_by: Sequence[str] = ("strategy",)) -> None:
    results.write.mode("overwrite").partitionBy(*partition_by).parquet(path)


def read_results(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def save_model(model, path: str, metadata: DataFrame | None = None) -> None:
    """Fitted pipeline, scaler included, and one metadata row per model beside it."""
    model.write().overwrite().save(f"{path}/model")
    if metadata is not None:
        metadata.write.mode("overwrite").parquet(f"{path}/metadata")


def load_model(path: str):
    from pyspark.ml import PipelineModel

    return PipelineModel.load(f"{path}/model")


def load_metadata(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/metadata")


def rounded(df: DataFrame, digits: int) -> DataFrame:
    """Round every double column, for reports and comparisons."""
    doubles = [name for name, kind in df.dtypes if kind == "double"]
    return df.withColumns({c: numbers.rounded(c, digits) for c in doubles})
