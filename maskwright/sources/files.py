"""Document files, audit logs, event sinks and reports."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.audit import AUDIT_FIELDS, AUDIT_SCHEMA, siem_payload, to_syslog
from ..operators.compliance import compliance_markdown
from ..operators.documents import resolve_format
from .lines import read_lines


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """Whole files as rows: ``doc_id`` (the path), ``name``, ``content``, ``format``."""
    files = spark.read.text(path, wholetext=True)
    return files.select(
        F.col("_metadata.file_path").alias("doc_id"),
        F.col("_metadata.file_name").alias("name"),
        F.col("value").alias("content"),
        resolve_format(F.col("_metadata.file_name")).alias("format"),
    )


def read_audit(spark: SparkSession, path: str) -> DataFrame:
    """Audit records of a JSON-lines log; lines that are no records are dropped.

    ``read_audit_log`` keeps those, and the order of the lines.
    """
    return spark.read.schema(AUDIT_SCHEMA).option("mode", "DROPMALFORMED").json(path)


class AuditLog(NamedTuple):
    """``records`` with ``file`` and ``line_no``, and ``rejects`` ``(file, line_no, line)``."""

    records: DataFrame
    rejects: DataFrame


def read_audit_log(spark: SparkSession, path: str) -> AuditLog:
    """Audit records in the order of their lines, and the lines that are no records.

    A line that is no JSON object, or holds a value of another type than its field, is a reject.
    Blank lines are neither. ``verify_audit(records, ["file"], ["line_no"])`` follows.
    """
    lines = read_lines(spark, path).filter(F.trim("line") != "")
    schema = f"{AUDIT_SCHEMA}, _corrupt string"
    parsed = lines.withColumn("_r", F.from_json("line", schema, {"columnNameOfCorruptRecord": "_corrupt"}))
    good = F.ltrim("line").startswith("{") & F.col("_r._corrupt").isNull()
    records = parsed.filter(good).select("file", "line_no", *[F.col(f"_r.{c}") for c in AUDIT_FIELDS])
    return AuditLog(records, parsed.filter(~good).select("file", "line_no", "line"))


def write_audit(df: DataFrame, path: str) -> None:
    """Append records to a JSON-lines log."""
    df.write.mode("append").json(path)


def stream_audit(df: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append a stream of records to a JSON-lines log, once per record."""
    return df.writeStream.format("json").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").start()


def write_syslog(df: DataFrame, path: str, **syslog) -> None:
    df.select(to_syslog(**syslog).alias("value")).write.mode("append").text(path)


Sender = Callable[[str, dict], bool]


def write_siem(
    df: DataFrame, sender: Sender, api_key: str | None = None, headers: dict | None = None, **payload
) -> DataFrame:
    """Send each event through ``sender(body, headers)``; one row ``(sent, failed)`` per
    partition. A failing sender is counted and never stops the job."""
    head = {"Content-Type": "application/json", **(headers or {})}
    if api_key:
        head["Authorization"] = f"Bearer {api_key}"

    def send(batches: Iterator) -> Iterator:
        import pandas as pd

        sent = failed = 0
        for pdf in batches:
            for body in pdf["body"]:
                try:
                    ok = bool(sender(body, head))
                except Exception:
                    ok = False
                sent, failed = sent + ok, failed + (not ok)
        yield pd.DataFrame({"sent": [sent], "failed": [failed]})

    return df.select(siem_payload(**payload).alias("body")).mapInPandas(send, "sent long, failed long")


def stream_siem(df: DataFrame, sender: Sender, checkpoint: str, **options) -> StreamingQuery:
    """Send a stream of records, apart from the query that writes the log."""
    run = lambda batch, _: write_siem(batch, sender, **options).agg(F.sum("sent"), F.sum("failed")).collect()
    return df.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).start()


def write_markdown_report(df: DataFrame, order: list[str], path: str) -> None:
    """The report as one text file; its size depends on the number of categories only."""
    lines = compliance_markdown(df, order)
    lines.coalesce(1).sortWithinPartitions("line_no").select("line").write.mode("overwrite").text(path)
