"""Helpers of the training-text operators: narrow reads, mapped batches, row numbers."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from maskwright.operators.ordered import ordered_rank


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_and_bytes(docs: DataFrame) -> DataFrame:
    """``doc_id`` and the text's UTF-8 bytes only, so other columns cannot clash; null stays null."""
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string").cast("binary").alias("text"))


def free_name(df: DataFrame, wanted: str) -> str:
    """``wanted``, with underscores in front until no column of ``df`` has it."""
    taken = {c.lower() for c in df.columns}
    while wanted.lower() in taken:
        wanted = f"_{wanted}"
    return wanted


def map_batches(df: DataFrame, work: Callable[[pa.RecordBatch], dict], schema: str, rows: int = 256) -> DataFrame:
    """Map Arrow batches to new columns. ``work`` sees at most ``rows`` rows, so memory
    follows the longest texts and not the batch size of the session."""
    arrow = _arrow_schema(df.sparkSession, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                yield pa.RecordBatch.from_pydict(work(batch.slice(at, rows)), schema=arrow)

    return df.mapInArrow(run, schema)


def text_scores(text: Column, work: Callable[[list[str]], list[float]], rows: int = 128) -> Column:
    """A double per text, ``rows`` texts at a time. Only the text goes to Python; a row's other
    columns stay where they are."""

    @F.arrow_udf("double")
    def score(column: pa.Array) -> pa.Array:
        found: list[float] = []
        for at in range(0, len(column), rows):
            found += work(texts(column.slice(at, rows)))
        return pa.array(found, pa.float64())

    return score(text.cast("string").cast("binary"))


def _arrow_schema(spark: SparkSession, schema: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    return to_arrow_schema(_parse_datatype_string(schema))


def texts(column: pa.Array) -> list[str]:
    """Decoded texts of a binary column; null is empty, bytes that are no UTF-8 become U+FFFD."""
    return ["" if b is None else b.decode("utf-8", "replace") for b in column.to_pylist()]


def dense_number(df: DataFrame, group: list[str], by: list[str], out: str) -> DataFrame:
    """Number the rows of each group gapless from 0.

    A group's rows are salted into as many blocks as the session has shuffle
    partitions; blocks are numbered apart and only their sizes meet, so a group with
    all rows is still many tasks. Equal ``by`` values may swap places.
    """
    blocks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    salt = F.pmod(F.xxhash64(*by), F.lit(blocks)).cast("long")
    ranked = ordered_rank(df, group, [F.col(c) for c in by], salt, out)
    return ranked.withColumn(out, F.col(out) - 1)


def hash_order(seed: int, *columns: str) -> Column:
    """An order that does not depend on the data's layout."""
    return F.xxhash64(F.lit(seed), *[F.col(c) for c in columns])
