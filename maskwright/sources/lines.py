"""Line numbers of text files that are read in splits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .staging import stage


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines as ``(file, line_no, line)``, numbered from 0 within their file.

    Two passes: each task numbers the lines it reads, a sum over the lines of a file's earlier
    splits gives where each split begins. No file is sorted or read by one task. The first
    pass is written, so that both meet the same splits, also where executors come and go.
    """
    read = stage(
        spark.read.text(path).select(
            F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_split"),
            F.monotonically_increasing_id().alias("_nth"), F.col("value").alias("line"),
        )
    )
    splits = read.groupBy("file", "_split").agg(F.min("_nth").alias("_first"), F.count(F.lit(1)).alias("_lines"))
    earlier = Window.partitionBy("file").orderBy("_split").rowsBetween(Window.unboundedPreceding, -1)
    starts = splits.select("file", "_split", "_first", F.coalesce(F.sum("_lines").over(earlier), F.lit(0)).alias("_before"))
    return read.join(starts, ["file", "_split"]).select(
        "file", (F.col("_before") + F.col("_nth") - F.col("_first")).alias("line_no"), "line"
    )
