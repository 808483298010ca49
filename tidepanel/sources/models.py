"""A versioned table of fitted models: one row per series, horizon, fold and target."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PARTITIONS = ("version", "target", "horizon")


def save_models(models: DataFrame, path: str, version: int) -> None:
    """Write one version beside earlier ones; writing it again replaces that version only.

    A version is a folder of its own, so a reader never sees half of it as another one.
    """
    rest = [c for c in PARTITIONS if c != "version"]
    models.drop("version").write.mode("overwrite").partitionBy(*rest).parquet(f"{path}/version={version}")


def versions(spark: SparkSession, path: str) -> list[int]:
    """Finished versions, oldest first."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    root = hadoop.Path(path)
    files = root.getFileSystem(spark._jsc.hadoopConfiguration())
    found = [x.getPath() for x in files.listStatus(root) if x.getPath().getName().startswith("version=")]
    done = [p for p in found if files.exists(hadoop.Path(p, "_SUCCESS"))]
    return sorted(int(p.getName().split("=")[1]) for p in done)


def load_models(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """Models of one version, the newest finished one by default, with its number."""
    if version is None:
        known = versions(spark, path)
        if not known:
            raise ValueError(f"no finished model version under {path}")
        version = known[-1]
    table = spark.read.parquet(f"{path}/version={version}")
    return table.withColumn("version", F.lit(version))
