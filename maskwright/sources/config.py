"""User rules and policies: JSON files to tables, and tables to detector settings."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import java_pattern, trim_all
from ..operators.detectors import DetectorSet, Dictionary, PatternRule

MAX_INLINE_TERMS = 500
_ANY = "array<string>"
_DICT = "name string, type string, terms array<string>, caseSensitive string, case_sensitive string"
_PATTERN = "name string, type string, pattern string, caseSensitive string, case_sensitive string"


class Rules(NamedTuple):
    """``terms``: ``(dict_name, type, term, case_sensitive)``; ``patterns``:
    ``(rule_name, type, pattern, case_sensitive)``."""

    terms: DataFrame
    patterns: DataFrame


def _first_list(body: Column, *keys: str) -> Column:
    """The first key with a non-empty array, as JSON texts of its elements."""
    found = [F.get_json_object(body, f"$.{k}") for k in keys]
    raw = F.coalesce(*[F.when(f.startswith("[") & (f != "[]"), f) for f in found])
    return F.coalesce(F.from_json(raw, _ANY), F.array().cast(_ANY))


def _flag(item: Column) -> Column:
    truthy = lambda c: F.coalesce(~c.isin("false", "", "0"), F.lit(False))
    return truthy(item["caseSensitive"]) | truthy(item["case_sensitive"])


def _type(item: Column) -> Column:
    return F.coalesce(F.nullif(F.upper(item["type"]), F.lit("")), F.lit("CUSTOM"))


def parse_rules(configs: DataFrame, body: str = "value") -> Rules:
    """Normalise configurations: upper-case types, default ``CUSTOM``, trimmed terms;
    entries without name, terms or pattern drop out."""
    dicts = configs.select(F.explode(_first_list(F.col(body), "dictionaries", "Dictionaries")).alias("_raw")).select(
        F.from_json("_raw", _DICT).alias("d")
    )
    d = F.col("d")
    terms = (
        dicts.filter("d.name != '' AND d.terms IS NOT NULL")
        .select(d["name"].alias("dict_name"), _type(d).alias("type"), F.explode("d.terms").alias("term"), _flag(d).alias("case_sensitive"))
        .withColumn("term", trim_all("term"))
        .filter("term != ''")
        .select("dict_name", "type", "term", "case_sensitive")
    )
    raw = configs.select(
        F.explode(_first_list(F.col(body), "customPatterns", "custom_patterns", "patterns")).alias("_raw")
    ).select(F.from_json("_raw", _PATTERN).alias("p"))
    p = F.col("p")
    patterns = raw.filter("p.name != '' AND p.pattern != ''").select(
        p["name"].alias("rule_name"), _type(p).alias("type"), p["pattern"].alias("pattern"), _flag(p).alias("case_sensitive")
    )
    return Rules(terms, patterns)


def load_rules(spark: SparkSession, path: str) -> Rules:
    return parse_rules(spark.read.text(path, wholetext=True))


def rule_inventory(terms: DataFrame) -> DataFrame:
    """Name, type and number of terms of each dictionary."""
    return terms.groupBy(F.col("dict_name").alias("name"), "type").agg(F.count("term").alias("terms"))


def upsert_rules(current: DataFrame, new: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
    """Replace rules by name, append the rest; return the table and the rejects."""
    body = "term" if "term" in new.columns else "pattern"
    complete = (F.coalesce(F.col(name), F.lit("")) != "") & (F.coalesce(F.col(body), F.lit("")) != "")
    good = new.filter(complete)
    kept = current.join(good.select(name).distinct(), name, "left_anti")
    return kept.select(*current.columns).unionByName(good), new.filter(~complete)


def detectors_from_rules(
    rules: Rules, base: DetectorSet = DetectorSet(), with_terms: bool = True
) -> tuple[DetectorSet, list[str]]:
    """Rules as detectors, and the names of patterns that do not compile.

    Terms become expressions, up to 500 of them. Longer lists stay a table: take
    ``with_terms=False`` and give ``rules.terms`` to ``anonymize(terms=…)``, a join of any size.
    """
    rows = rules.terms.limit(MAX_INLINE_TERMS + 1).collect() if with_terms else []
    if len(rows) > MAX_INLINE_TERMS:
        raise ValueError(f"more than {MAX_INLINE_TERMS} terms: give rules.terms to anonymize(terms=…)")
    grouped: dict[tuple, list[str]] = {}
    for r in rows:
        grouped.setdefault((r["dict_name"], r["type"], r["case_sensitive"]), []).append(r["term"])
    out, bad = base, []
    for (name, type_, cased), terms in grouped.items():
        out = out.with_dictionary(Dictionary(name, type_, tuple(terms), cased))
    patterns = rules.patterns.limit(MAX_INLINE_TERMS + 1).collect()
    if len(patterns) > MAX_INLINE_TERMS:
        raise ValueError(f"more than {MAX_INLINE_TERMS} patterns")
    for r in patterns:
        if pattern_compiles(rules.patterns.sparkSession, r["pattern"]):
            out = out.with_pattern(PatternRule(r["rule_name"], r["type"], r["pattern"], r["case_sensitive"]))
        else:
            bad.append(r["rule_name"])
    return out, bad


def pattern_compiles(spark: SparkSession, pattern: str) -> bool:
    try:
        spark.range(1).select(F.regexp_like(F.lit(""), F.lit(java_pattern(pattern)))).collect()
        return True
    except Exception:
        return False


_POLICY = (
    "id string, action string, reason string, match struct<department:string,role:string,provider:string,"
    "model:string,entities:array<string>,minRiskScore:int>"
)


def parse_policy(configs: DataFrame, body: str = "value") -> DataFrame:
    """Policy rules in order: ``rule_idx, id, department, role, provider, model,
    entities, min_risk, action, reason, default_action``. Criteria are string or list."""
    listed = configs.select(
        F.coalesce(F.get_json_object(body, "$.defaultAction"), F.lit("CLOAK")).alias("default_action"),
        F.posexplode(_first_list(F.col(body), "rules")).alias("rule_idx", "_raw"),
    ).withColumn("r", F.from_json("_raw", _POLICY))
    as_list = lambda c: F.when(F.col(c).startswith("["), F.from_json(F.col(c), _ANY)).when(
        F.col(c).isNotNull(), F.array(F.col(c))
    )
    return listed.filter("r.id IS NOT NULL AND r.action IS NOT NULL").select(
        "rule_idx", "r.id",
        *[as_list(f"r.match.{c}").alias(c) for c in ("department", "role", "provider", "model")],
        F.col("r.match.entities").alias("entities"), F.col("r.match.minRiskScore").alias("min_risk"),
        "r.action", "r.reason", "default_action",
    )


def load_policy(spark: SparkSession, path: str) -> DataFrame:
    return parse_policy(spark.read.text(path, wholetext=True))
