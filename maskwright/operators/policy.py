"""Declarative policy: which requests are blocked, which types are redacted or allowed.

Rules are configuration, a short ordered list. They become one expression, so a
decision is a projection: no join and no shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import as_column, let, wildcard_match

MAX_RULES = 2000


@dataclass(frozen=True)
class PolicyRule:
    """``None`` for a criterion means it is absent and always holds."""

    id: str
    action: str
    department: tuple[str, ...] | None = None
    role: tuple[str, ...] | None = None
    provider: tuple[str, ...] | None = None
    model: tuple[str, ...] | None = None
    entities: tuple[str, ...] = ()
    min_risk: int | None = None
    reason: str | None = None


def rules_from_table(rules: DataFrame, most: int = MAX_RULES) -> list[PolicyRule]:
    """Rules of a loaded policy table, in ``rule_idx`` order. A policy is configuration: one of
    more than ``most`` rules is refused, never cut."""
    rows = rules.orderBy("rule_idx").limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"a policy may have at most {most} rules")
    as_tuple = lambda v: None if v is None else tuple(v)
    return [
        PolicyRule(
            r["id"], r["action"], as_tuple(r["department"]), as_tuple(r["role"]), as_tuple(r["provider"]),
            as_tuple(r["model"]), tuple(r["entities"] or ()), r["min_risk"], r["reason"],
        )
        for r in rows
    ]


def _any_match(patterns: tuple[str, ...], value: Column) -> Column:
    """Any pattern fits; an absent or empty value fits none."""
    fits = F.lit(False)
    for p in patterns:
        fits = fits | wildcard_match(F.lit(p), value)
    return F.coalesce(value != "", F.lit(False)) & F.coalesce(fits, F.lit(False))


def rule_matches(rule: PolicyRule, fields: dict[str, Column]) -> Column:
    cond = F.lit(True)
    for name in ("department", "role", "provider", "model"):
        patterns = getattr(rule, name)
        if patterns is not None and patterns != ("",):
            cond = cond & _any_match(patterns, fields[name])
    if rule.min_risk is not None:
        cond = cond & (F.coalesce(fields["risk_score"], F.lit(0)) >= rule.min_risk)
    if rule.entities:
        wanted = F.array(*[F.lit(e) for e in rule.entities])
        cond = cond & F.coalesce(F.arrays_overlap(fields["entity_types"], wanted), F.lit(False))
    return cond


def decision(fields: dict[str, Column], rules: Sequence[PolicyRule], default: str = "CLOAK") -> Column:
    """``struct(action, blocked, reason, matched_rules, warnings, redact_types,
    cloak_types, allow_types)``.

    The first BLOCK ends the evaluation; otherwise the last matching rule gives the
    action. A rule without entities speaks for every detected type.
    """
    strings = lambda items: F.array(*[F.lit(i) for i in items]).cast("array<string>")
    candidates = [
        F.when(
            rule_matches(r, fields),
            F.struct(
                F.lit(r.id).alias("id"),
                F.lit(r.action).alias("action"),
                F.lit(r.reason or None).cast("string").alias("reason"),
                strings(r.entities).alias("entities"),
            ),
        )
        for r in rules
    ]
    shape = "array<struct<id:string,action:string,reason:string,entities:array<string>>>"
    fired = F.filter(F.array(*candidates).cast(shape), lambda r: r.isNotNull())
    detected = F.array_distinct(F.coalesce(fields["entity_types"], F.array().cast("array<string>")))

    def outcome(b: Column) -> Column:
        matched, stop = b["fired"], b["stop"]
        return let(
            F.when(stop > 0, F.slice(matched, 1, stop)).otherwise(matched),
            lambda used: _outcome(used, stop > 0),
        )

    def _outcome(used: Column, blocked: Column) -> Column:
        last = F.try_element_at(used, F.lit(-1))
        types_of = lambda action: F.array_distinct(
            F.flatten(
                F.transform(
                    F.filter(used, lambda r: r["action"] == action),
                    lambda r: F.when(F.size(r["entities"]) > 0, r["entities"]).otherwise(detected),
                )
            )
        )
        return F.struct(
            F.coalesce(last["action"], F.lit(default)).alias("action"),
            blocked.alias("blocked"),
            F.when(
                blocked,
                F.coalesce(last["reason"], F.concat(F.lit("Blocked by security policy rule: "), last["id"])),
            ).alias("reason"),
            F.transform(used, lambda r: r["id"]).alias("matched_rules"),
            F.transform(
                F.filter(used, lambda r: r["action"] == "WARN"),
                lambda r: F.coalesce(
                    r["reason"], F.concat(F.lit("Policy warning triggered by rule: "), r["id"])
                ),
            ).alias("warnings"),
            types_of("REDACT").alias("redact_types"),
            types_of("CLOAK").alias("cloak_types"),
            types_of("ALLOW").alias("allow_types"),
        )

    stop = lambda f: F.array_position(F.transform(f, lambda r: r["action"]), "BLOCK").cast("int")
    return let(
        fired, lambda f: let(F.struct(f.alias("fired"), stop(f).alias("stop")), outcome)
    )


def decide(
    requests: DataFrame, rules: Sequence[PolicyRule] | DataFrame, default: str | None = None, out: str = "decision",
    **columns: str,
) -> DataFrame:
    """Add a decision per request.

    Reads ``department``, ``role``, ``provider``, ``model``, ``risk_score`` and
    ``entity_types``; a missing column counts as absent. Keyword arguments rename
    them, for example ``department="c_mktsegment"``. ``default`` is the action where no rule
    says one: by default that of a loaded policy table, else ``CLOAK``.
    """
    if isinstance(rules, DataFrame):
        if default is None and "default_action" in rules.columns:
            first = rules.select("default_action").first()
            default = first[0] if first else None
        rules = rules_from_table(rules)
    default = default or "CLOAK"
    kinds = {"entity_types": "array<string>", "risk_score": "int"}
    fields = {}
    for name in ("department", "role", "provider", "model", "risk_score", "entity_types"):
        source = columns.get(name, name)
        kind = kinds.get(name, "string")
        fields[name] = as_column(source) if source in requests.columns else F.lit(None).cast(kind)
    return requests.withColumn(out, decision(fields, rules, default))
