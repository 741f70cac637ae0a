"""The shared folder in which jobs keep what they write on their way."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def work_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Only in local mode, where driver and executors are one process, a folder of our own stands in
    for it; on a cluster an unset one is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='standmill-')}"
        spark.sparkContext.setCheckpointDir(found)
    return found


def new_path(spark: SparkSession) -> str:
    return f"{work_dir(spark)}/{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """Writes df as Parquet in the shared folder and reads it again: cuts the lineage, and survives lost executors."""
    path = new_path(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
