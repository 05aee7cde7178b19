"""Checks on model output: restore known placeholders, catch what is new."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import fixed_values as fixed
from ..sources.staging import stage
from .detectors import DetectorSet, find_entities
from .joins import join_null_safe, with_row_key
from .policy import PolicyRule, decide
from .spans import SPANS, explode_spans, redact
from .vault import fill_placeholders, placeholder_map

SPAN_FIELDS = ("type", "value", "start", "end", "confidence", "rank", "metadata")


def new_leaks(spans: DataFrame, vault: DataFrame, session_cols: Sequence[str]) -> DataFrame:
    """Exploded spans whose value, in any case, is no original of their session."""
    keys = list(session_cols)
    known = vault.select(*keys, F.lower("original_value").alias("_low")).distinct()
    return join_null_safe(spans.withColumn("_low", F.lower("value")), known, [*keys, "_low"], "left_anti").drop("_low")


def check_responses(
    responses: DataFrame,
    vault: DataFrame,
    text_col: str = "response",
    session_cols: Sequence[str] = ("session_id",),
    order_cols: Sequence[str] = (),
    rules: Sequence[PolicyRule] | None = None,
    detectors: DetectorSet | None = None,
) -> DataFrame:
    """Add ``checked``, ``restored_count``, ``leaks``, ``blocked`` and ``block_reason``.

    Leaks meet the vault by session and value, never as a list per session; null sessions are one
    session. Each row is checked by itself, also where rows repeat their session and order or have none.
    """
    session_cols, row = list(session_cols), ["_text_row"]
    asked = stage(with_row_key(responses))
    keys = [*row, *session_cols]
    originals = placeholder_map(asked, vault, text_col, session_cols, keys).drop(*session_cols)
    exact = vault.select(*session_cols, F.col("placeholder").alias("_ph"))
    used = asked.filter(F.col(text_col).contains("[")).select(
        *keys, F.explode(F.array_distinct(F.regexp_extract_all(text_col, F.lit(r"\[[^\[\]]+\]"), F.lit(0)))).alias("_ph")
    )
    counted = join_null_safe(used, exact, [*session_cols, "_ph"], "left_semi").groupBy(*row).agg(F.count(F.lit(1)).cast("int").alias("_count"))
    restored = (
        asked.join(originals, row, "left").join(counted, row, "left")
        .withColumn("_text", fill_placeholders(F.col(text_col), F.col("_originals")))
        .withColumn("restored_count", F.coalesce("_count", F.lit(0)))
        .drop("_originals", "_count")
    )
    staged = stage(restored.withColumn("_found", find_entities("_text", detectors=detectors)))
    leaks = new_leaks(explode_spans(staged.select(*keys, "_found"), "_found"), vault, session_cols)
    per_row = leaks.groupBy(*row).agg(
        F.collect_list(F.struct("start", *[c for c in SPAN_FIELDS if c != "start"])).alias("_leaks")
    )
    # Spans carry a map, which has no order; positions do.
    by_start = F.array_sort(
        F.col("_leaks"),
        lambda a, b: F.when(a["start"] < b["start"], -1).when(a["start"] > b["start"], 1).otherwise(0),
    )
    ordered = F.transform(by_start, lambda s: F.struct(*[s[c].alias(c) for c in SPAN_FIELDS]))
    joined = staged.join(per_row, row, "left").withColumn(
        "leaks", F.coalesce(ordered, F.array().cast(SPANS))
    )
    joined = joined.withColumn("_types", F.transform("leaks", lambda s: s["type"]))
    if rules:
        joined = decide(joined.drop("risk_score"), rules, out="_decision", entity_types="_types")
        stop = (F.size("leaks") > 0) & F.col("_decision.blocked")
        reason = F.coalesce("_decision.reason", F.lit(fixed.LEAK_REASON))
    else:
        stop, reason = F.lit(False), F.lit(None).cast("string")
    return (
        joined.withColumn("blocked", stop)
        .withColumn("block_reason", F.when(F.col("blocked"), reason))
        .withColumn(
            "checked", F.when(F.col("blocked"), F.lit("")).otherwise(redact("_text", "leaks"))
        )
        .select(*responses.columns, "checked", "restored_count", "leaks", "blocked", "block_reason")
    )
