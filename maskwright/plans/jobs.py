"""Whole jobs: request gate, response check, document batch, message log, audit review."""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import fixed_values as fixed
from ..functions.text import as_column
from ..operators import audit as A
from ..operators.canary import canary_token, scan_canaries
from ..operators.compliance import compliance_summary
from ..operators.detectors import DetectorSet, find_entities
from ..operators.documents import rewrite_pieces
from ..operators.firewall import Rule, score_prompts
from ..operators.joins import with_row_key
from ..operators.guard import Limits, judge_usage, with_usage
from ..operators.leaks import check_responses
from ..operators.policy import PolicyRule, decide
from ..operators.spans import type_counts
from ..operators.vault import anonymize, fill_placeholders
from ..sources.staging import stage


class Gate(NamedTuple):
    """``outbound``: admitted requests with ``sanitized``; ``refused``: the others with
    ``refused_by`` and ``refusal``; ``vault``; ``audit``: one record per request."""

    outbound: DataFrame
    refused: DataFrame
    vault: DataFrame
    audit: DataFrame


def gate_requests(
    requests: DataFrame,
    rules: Sequence[PolicyRule] = (),
    limits: Limits = Limits(),
    threshold: int = fixed.FIREWALL_THRESHOLD,
    extra_rules: Sequence[Rule] = (),
    canary_secret: str | None = None,
    detectors: DetectorSet | None = None,
    vault: DataFrame | None = None,
    turn: str | None = None,
) -> Gate:
    """Limits, screening, policy, optional canary, then pseudonyms, in that order.

    ``requests``: ``request_id, session_id, client, ts, department, role, model,
    is_streaming, prompt`` with one prompt per request. Cheap tests come first; the
    detection result is written once and feeds policy, counts and rewriting. Every row is one request, with one
    verdict and one audit record, also where ids repeat or ids, clients or sessions are null.
    """
    requests_, columns = stage(with_row_key(requests, "_request")), requests.columns
    usage = with_usage(requests_.select("_request", "request_id", "client", "ts", "prompt"), "prompt").drop("prompt")
    verdicts = judge_usage(usage, "client", "ts", "request_id", limits, tie="_request").select(
        "_request", "allowed", "circuit_state", F.col("reason").alias("_limit_reason")
    )
    judged = requests_.join(verdicts, "_request")
    scored = score_prompts(judged, "prompt", threshold, extra_rules)
    passed_limits, passed_screen = F.col("allowed"), F.col("safe")
    # Texts that are refused anyway are not searched.
    searched = scored.withColumn(
        "_text", F.when(passed_limits & passed_screen, F.col("prompt")).otherwise(F.lit(""))
    )
    searched = searched.withColumn("_found", find_entities("_text", detectors=detectors)).withColumn(
        "_types", F.transform("_found", lambda s: s["type"])
    )
    decided = stage(
        decide(searched.withColumn("provider", F.lit("openai")), list(rules), entity_types="_types").drop(
            "normalized_text", "_text"
        )
    )
    blocked = F.col("decision.blocked")
    refused_by = (
        F.when(~passed_limits, "LIMITS").when(~passed_screen, "SCREENING").when(blocked, "POLICY")
    )
    refusal = (
        F.when(~passed_limits, F.col("_limit_reason"))
        .when(~passed_screen, F.concat(F.lit("Prompt screening: "), F.array_join("flags", ", ")))
        .when(blocked, F.col("decision.reason"))
    )
    marked = decided.withColumn("refused_by", refused_by).withColumn("refusal", refusal)
    refused = marked.filter("refused_by IS NOT NULL")
    passed = marked.filter("refused_by IS NULL")
    if canary_secret:
        before, after = fixed.CANARY_MARK.split("{}")
        token = canary_token("request_id", canary_secret, "SENTINEL")
        passed = passed.withColumn("canary", token).withColumn(
            "system_note", F.concat(F.lit(before), token, F.lit(after))
        )
    done = anonymize(
        passed, "prompt", ["session_id"], [turn or "ts", "request_id", "_request"], spans_col="_found",
        redact=F.col("decision.redact_types"), allow=F.col("decision.allow_types"), detectors=detectors, vault=vault,
    )
    outbound = stage(done.rewritten.drop("_found", "_types", "_limit_reason", "_request", "refused_by", "refusal"))
    audit = _gate_audit(refused).unionByName(_gate_audit(outbound.withColumn("refused_by", F.lit(None).cast("string"))))
    keep = [*columns, "refused_by", "refusal", "risk_score", "flags"]
    return Gate(outbound, refused.select(*keep), done.vault, audit)


def _gate_audit(df: DataFrame) -> DataFrame:
    """Refused requests carry no breakdown; a policy refusal still counts its entities."""
    by = F.col("refused_by")
    counts = F.size("entities") if "entities" in df.columns else F.size("_found")
    breakdown = (
        type_counts("entities") if "entities" in df.columns else F.create_map().cast("map<string,int>")
    )
    rows = df.withColumn("_n", F.when(by.isin("LIMITS", "SCREENING"), 0).otherwise(counts)).withColumn("_map", breakdown)
    return A.audit_records(
        rows.select("request_id", "ts", "model", "is_streaming", "risk_score", "flags", "circuit_state", "refused_by", "decision", "_n", "_map"),
        "_map",
        request_id="request_id",
        timestamp=F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"),
        model=F.coalesce("model", F.lit("unknown")),
        entities_detected="_n",
        processing_latency_ms=F.lit(0), upstream_latency_ms=F.lit(0),
        is_streaming="is_streaming",
        status=F.when(F.col("refused_by").isNull(), "SUCCESS").otherwise("ERROR"),
        policy_action=F.when(by == "POLICY", "BLOCK").when(by.isNull(), F.col("decision.action")),
        risk_score=F.when(by.isNull() | (by == "SCREENING"), F.col("risk_score")),
        firewall_flags=F.when(by.isNull() | (by == "SCREENING"), F.col("flags")),
        circuit_breaker_tripped=F.when(by == "LIMITS", F.col("circuit_state") == "OPEN"),
    ).select(*A.AUDIT_FIELDS)


def check_responses_job(
    responses: DataFrame, vault: DataFrame, registry: DataFrame, text_col: str = "response",
    session_cols: Sequence[str] = ("session_id",), order_cols: Sequence[str] = ("request_id",),
    rules: Sequence[PolicyRule] = (), detectors: DetectorSet | None = None,
) -> DataFrame:
    """Canary check first, then restore and leak check: adds ``canary_alert``,
    ``matched_tokens`` and the columns of ``check_responses``."""
    asked = stage(with_row_key(responses, "_response"))
    alarms = scan_canaries(asked, registry, text_col, ["_response"])
    checked = check_responses(asked, vault, text_col, session_cols, order_cols, list(rules), detectors)
    joined = checked.join(alarms, "_response", "left").drop("_response").withColumn("canary_alert", F.coalesce("leak_detected", F.lit(False)))
    alert, (before, after) = F.col("canary_alert"), fixed.CANARY_REASON.split("{}")
    return joined.drop("leak_detected").withColumn(
        "checked", F.when(alert, F.lit("")).otherwise(F.col("checked"))
    ).withColumn("blocked", alert | F.col("blocked")).withColumn(
        "block_reason",
        F.when(alert, F.concat(F.lit(before), F.array_join("matched_tokens", ", "), F.lit(after))).otherwise(F.col("block_reason")),
    )


def preview(df: DataFrame, text_col: str = "text", detectors: DetectorSet | None = None) -> DataFrame:
    """Round trip per row: adds ``sanitized``, ``entities``, ``restored``, ``mappings``
    and ``differs``. Every row is its own session, so nothing is shuffled."""
    pieces = F.array(F.struct(F.col(text_col).alias("text"), F.lit(1).alias("kind")))
    work = rewrite_pieces(df.withColumn("_pieces", pieces), "_pieces", True, detectors)
    work = work.withColumn("sanitized", F.array_join("_parts", "")).drop("_parts", "_pieces")
    originals = F.map_from_entries(
        F.transform("vault", lambda e: F.struct(e["placeholder"].alias("key"), e["original_value"].alias("value")))
    )
    work = work.withColumn("mappings", originals)
    return (
        work.withColumn("restored", fill_placeholders(F.col("sanitized"), F.col("mappings")))
        .withColumn("differs", F.col("restored") != F.col(text_col))
        .select(*df.columns, "sanitized", "entities", "restored", "mappings", "differs")
    )


def review_audit(df: DataFrame, chain: Sequence[str], order: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Verification per chain, and the compliance summary."""
    return A.verify_audit(df, chain, order), compliance_summary(df, order)
