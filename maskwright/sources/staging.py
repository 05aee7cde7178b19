"""Written intermediate tables in the cluster's shared folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``.

    Without that setting only a local session gets a folder of its own: on a
    cluster a machine-local folder would not be readable by other executors.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def stage(df: DataFrame) -> DataFrame:
    """Write a DataFrame that several branches read, and read it back.

    Detection costs far more than a write, and a columnar table lets each branch
    read only its columns. The table outlives lost executors.
    """
    path = f"{shared_folder(df.sparkSession)}/maskwright-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
