"""Roll-ups of audit records for reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import fixed_values as fixed

DEFAULT_DESTINATION = "upstream-llm"


def _contributions(df: DataFrame, order: Sequence[str]) -> DataFrame:
    """Totals, category counts and destination counts of all records in one pass."""
    row = lambda kind, name, n: F.struct(
        F.lit(kind).alias("kind"), name.cast("string").alias("name"), n.cast("bigint").alias("n")
    )
    destination = F.coalesce(F.nullif("model", F.lit("")), F.lit(DEFAULT_DESTINATION))
    fixed_rows = F.array(
        row("total", F.lit(None), F.col("entities_detected")), row("destination", destination, F.lit(1))
    )
    categories = F.transform(
        F.map_entries(F.coalesce("entity_breakdown", F.create_map().cast("map<string,int>"))),
        lambda e: row("category", e["key"], e["value"]),
    )
    exploded = df.select(
        F.struct(*order).alias("_at"),
        "timestamp",
        F.coalesce("processing_latency_ms", F.lit(0.0)).alias("_process"),
        F.coalesce("upstream_latency_ms", F.lit(0.0)).alias("_upstream"),
        F.explode(F.concat(fixed_rows, categories)).alias("c"),
    )
    is_total = F.col("c.kind") == "total"
    return exploded.groupBy(F.col("c.kind").alias("kind"), F.col("c.name").alias("name")).agg(
        F.sum("c.n").alias("n"),
        F.count(F.lit(1)).alias("records"),
        F.min_by("timestamp", F.when(is_total, F.col("_at"))).alias("first"),
        F.max_by("timestamp", F.when(is_total, F.col("_at"))).alias("last"),
        F.sum(F.when(is_total, F.col("_process"))).alias("process"),
        F.sum(F.when(is_total, F.col("_upstream"))).alias("upstream"),
    )


def compliance_summary(df: DataFrame, order: Sequence[str]) -> DataFrame:
    """One row: period, totals, counts per category and destination, mean latencies."""
    parts = _contributions(df, order)
    total = F.col("kind") == "total"
    counts = lambda kind: F.map_from_entries(
        F.array_sort(F.collect_list(F.when(F.col("kind") == kind, F.struct("name", "n"))))
    )
    tenth = lambda col: F.coalesce(
        F.round(F.floor(F.sum(F.when(total, F.col(col))) / F.sum(F.when(total, F.col("records"))) * 10 + 0.5) / 10, 1),
        F.lit(0.0),
    )
    return parts.agg(
        F.max(F.when(total, F.col("first"))).alias("period_start"),
        F.max(F.when(total, F.col("last"))).alias("period_end"),
        F.coalesce(F.sum(F.when(total, F.col("records"))), F.lit(0)).alias("total_requests"),
        F.coalesce(F.sum(F.when(total, F.col("n"))), F.lit(0)).alias("total_entities"),
        F.lit(100).alias("risk_reduction_percentage"),
        counts("category").alias("category_breakdown"),
        counts("destination").alias("upstream_destinations"),
        tenth("process").alias("avg_sanitization_ms"),
        tenth("upstream").alias("avg_upstream_ms"),
        F.lit(fixed.COMPLIANCE_STATUS).alias("status"),
    )


def compliance_rollup(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Entities per category with subtotals; ``by`` adds leading levels."""
    exploded = df.select(*by, F.explode("entity_breakdown").alias("category", "n"))
    return exploded.rollup(*by, "category").agg(
        F.sum("n").cast("bigint").alias("entities"), F.count(F.lit(1)).alias("records")
    )


def compliance_markdown(df: DataFrame, order: Sequence[str], title: str = "Compliance and audit report") -> DataFrame:
    """The report as ``(line_no, line)`` rows."""
    lines_of = lambda col, fmt, empty: F.when(F.size(col) == 0, F.array(F.lit(empty))).otherwise(
        F.transform(F.map_entries(col), fmt)
    )
    s = compliance_summary(df, order)
    text = lambda c: F.col(c).cast("string")
    lines = F.concat(
        F.array(
            F.lit(f"# {title}"),
            F.lit(""),
            F.concat(F.lit("> Status: `"), F.col("status"), F.lit("`")),
            F.concat(
                F.lit("> Period: "), F.coalesce("period_start", F.lit("-")), F.lit(" to "), F.coalesce("period_end", F.lit("-"))
            ),
            F.lit(""),
            F.lit("## Summary"),
            F.lit(""),
            F.lit("| Metric | Value |"),
            F.lit("| :--- | :--- |"),
            F.concat(F.lit("| Requests audited | "), text("total_requests"), F.lit(" |")),
            F.concat(F.lit("| Entities masked | "), text("total_entities"), F.lit(" |")),
            F.concat(F.lit("| Leak prevention rate | "), text("risk_reduction_percentage"), F.lit("% |")),
            F.concat(F.lit("| Mean sanitisation time | "), text("avg_sanitization_ms"), F.lit(" ms |")),
            F.lit(""),
            F.lit("## Categories"),
            F.lit(""),
            F.lit("| Category | Count | Mitigated |"),
            F.lit("| :--- | :--- | :--- |"),
        ),
        lines_of(
            F.col("category_breakdown"),
            lambda e: F.concat(F.lit("| `"), e["key"], F.lit("` | "), e["value"].cast("string"), F.lit(" | **100%** |")),
            "| None detected | 0 | 100% |",
        ),
        F.array(
            F.lit(""), F.lit("## Destinations"), F.lit(""), F.lit("| Model | Volume |"), F.lit("| :--- | :--- |")
        ),
        lines_of(
            F.col("upstream_destinations"),
            lambda e: F.concat(F.lit("| `"), e["key"], F.lit("` | "), e["value"].cast("string"), F.lit(" requests |")),
            "| none | 0 requests |",
        ),
    )
    return s.select(F.posexplode(lines).alias("line_no", "line"))


def compliance_report(df: DataFrame, order: Sequence[str], recent: int = 50) -> DataFrame:
    """Summary and newest records as JSON rows ``(section, position, body)``."""
    from .audit import recent_audit

    summary = compliance_summary(df, order)
    head = summary.select(
        F.lit("summary").alias("section"), F.lit(0).alias("position"), F.to_json(F.struct("*")).alias("body")
    )
    newest = recent_audit(df, order, recent)
    # The list is bounded by ``recent``; its rows carry their rank.
    body = newest.agg(
        F.sort_array(F.collect_list(F.struct(*order, F.to_json(F.struct(*df.columns)).alias("_body"))), asc=False).alias("r")
    )
    records = body.select(F.posexplode("r").alias("position", "_r")).select(
        F.lit("recent").alias("section"), "position", F.col("_r._body").alias("body")
    )
    return head.unionByName(records)
