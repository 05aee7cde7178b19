"""Prompt-injection scoring: weighted pattern rules over normalised text."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed_values as fixed
from ..functions.text import as_column, has_any, has_rare, java_pattern, let, normalize_text, plain_spaces


class Rule(NamedTuple):
    category: str
    pattern: str
    weight: int


BUILT_IN = tuple(Rule(*r) for r in fixed.FIREWALL_RULES)
_HITS = "array<struct<category:string,match:string,weight:int>>"
_INSTRUCTIONS = ("instruction", "rule", "prompt", "guideline", "directive", "constraint")
# Per built-in rule, words in small letters: a text that it matches holds one of each group. Bytes are
# compared, so this costs a fraction of the rule's pattern.
_NEEDS: tuple[tuple[tuple[str, ...], ...], ...] = (
    (_INSTRUCTIONS, ("previous", "prior", "earlier", "above", "initial")),
    (("cédentes", "cedentes", "térieures", "terieures", "initiales"),),
    (("override", "instruction", "rules"),),
    (("suis", "prioritaire"),),
    (("follow",), ("rules",)),
    (("above", "prior", "before", "beginning"), ("repeat", "print", "show", "display", "echo", "output", "reveal", "dump")),
    (("prompt", "instruction", "ci-dessus"),),
    (("what",), ("prompt", "instruction", "rule", "guideline")),
    (("initiales",),),
    (("output",), ("prompt", "instruction", "secret")),
    (("mode", "anything", "jailbreak"),),
    (("uncensored", "unfiltered", "hypothetical"),),
    (("filtre", "importe", "thique"),),
    (("pretend",),),
    (("avais", "limite"),),
    (("---", "===", "###"), ("system", "prompt", "instructions")),
    (("system>", "instruction>", "admin>", "prompt_context>"),),
    (("[system", "[admin", "[internal", "<<sys>>", "<|im_start|>system"),),
    (("base64", "rot13", "execute"),),
)
# Letters beside K that a pattern for any case takes as ASCII ones, and that stay or come apart in small letters.
_LIKE_ASCII = ("\u017f", "\u0131", "\u0130")


def custom_rule(pattern: str, category: str | None = None, weight: int | None = None) -> Rule:
    return Rule(category or "INSTRUCTION_OVERRIDE", pattern, weight or fixed.CUSTOM_RULE_WEIGHT)


def _flags(pattern: str) -> str:
    """Any case; beyond ASCII letters only where the pattern has such letters."""
    return "(?i)" if pattern.isascii() else "(?iu)"


def _hits(text: Column, rules: Sequence[Rule], possible: Mapping[Rule, Column] | None = None) -> Column:
    """One struct per rule that matches, in rule order; a rule whose ``possible`` is false is not tried."""
    if not rules:
        return F.array().cast(_HITS)

    def match(rule: Rule) -> Column:
        found = F.regexp_extract(text, _flags(rule.pattern) + java_pattern(rule.pattern), 0)
        return F.when(possible[rule], found).otherwise(F.lit("")) if possible else found

    tried = [
        F.struct(F.lit(r.category).alias("category"), match(r).alias("match"), F.lit(r.weight).alias("weight")) for r in rules
    ]
    return F.filter(F.array(*tried), lambda h: h["match"] != "")


def match_rules(normalized, extra_rules: Sequence[Rule] = ()) -> Column:
    """``array<struct(category, match, weight)>`` of an already normalised text."""
    text = as_column(normalized)
    return let(plain_spaces(text, has_rare(text)), lambda plain: _match(plain, extra_rules))


def _match(text: Column, extra_rules: Sequence[Rule]) -> Column:
    delimiters = [r for r in BUILT_IN if r.category == "DELIMITER_SMUGGLING"]
    words = [r for r in BUILT_IN if r.category != "DELIMITER_SMUGGLING"]
    before = [r for r in words if r.category != "OBFUSCATION_INDICATORS"]
    after = [r for r in words if r.category == "OBFUSCATION_INDICATORS"]
    ordered = [*before, *delimiters, *after]

    def gated(gates: Column) -> Column:
        built_in = {r: gates[f"r{i}"] for i, r in enumerate(ordered)}
        none = F.array().cast(_HITS)
        return F.when(gates["any"], _hits(text, ordered, built_in)).otherwise(none)

    def bind(low: Column) -> Column:
        odd = (F.octet_length(low) != F.length(low)) & has_any(text, _LIKE_ASCII)
        needed = dict(zip(BUILT_IN, _NEEDS, strict=True))
        holds = [odd | reduce(lambda a, b: a & b, [has_any(low, group) for group in needed[r]]) for r in ordered]
        return let(F.array(*holds), lambda flags: let(
            F.struct(
                F.array_contains(flags, True).alias("any"), *[flags[i].alias(f"r{i}") for i in range(len(ordered))]
            ), gated,
        ))

    found = let(F.lower(text), bind)
    return F.concat(found, _hits(text, list(extra_rules))) if extra_rules else found


def score_matches(matches, threshold: int = fixed.FIREWALL_THRESHOLD) -> Column:
    """``struct(safe, risk_score, flags, matched)``: each category's first rule counts."""

    def verdict(hits: Column) -> Column:
        first = F.filter(
            hits,
            lambda h, i: ~F.exists(F.slice(hits, 1, i), lambda o: o["category"] == h["category"]),
        )
        total = F.aggregate(first, F.lit(0), lambda acc, h: acc + h["weight"])
        return let(
            F.least(F.lit(100), total),
            lambda score: F.struct(
                (score < threshold).alias("safe"),
                score.alias("risk_score"),
                F.transform(first, lambda h: h["category"]).alias("flags"),
                hits.alias("matched"),
            ),
        )

    return let(as_column(matches), verdict)


def score_prompts(
    df: DataFrame, text_col: str = "text", threshold: int = fixed.FIREWALL_THRESHOLD,
    extra_rules: Sequence[Rule] = (),
) -> DataFrame:
    """Add ``normalized_text``, ``safe``, ``risk_score``, ``flags`` and ``matched``."""
    normalized = df.withColumn("normalized_text", normalize_text(text_col))
    scored = normalized.withColumn(
        "_verdict", score_matches(match_rules("normalized_text", extra_rules), threshold)
    )
    return scored.select(*df.columns, "normalized_text", "_verdict.*")
