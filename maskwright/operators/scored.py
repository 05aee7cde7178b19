"""Entities from a scoring function of the caller's choice, or from its text reply."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import SPACE, as_column, let, trim_all
from .spans import make_span, merge_spans, metadata, no_spans
from .vault import value_spans

SCORED = "array<struct<label:string,word:string,start:int,end:int,score:double>>"
_NAME_EDGE = r"\p{L}\p{N}"


def _entity_type(label: Column) -> Column:
    low = F.upper(label)
    return F.when(low.contains("PER"), "PERSON").when(low.contains("ORG"), "ORGANIZATION")


def spans_from_scores(text, scored, source: str = "model") -> Column:
    """Spans of scored tokens: labels mapped, white space trimmed, positions aligned
    to the word if it lies within four characters, neighbours merged."""
    text = as_column(text)
    meta = metadata({"source": source})

    def placed(item: Column, type_: Column, word: Column) -> Column:
        raw = F.substr(text, item["start"] + 1, item["end"] - item["start"])
        lead = F.length(raw) - F.length(F.regexp_replace(raw, f"^{SPACE}+", ""))
        start = item["start"] + lead
        value = trim_all(raw)
        score = F.coalesce(item["score"], F.lit(0.90))
        begin = F.greatest(item["start"] - 3, F.lit(0))
        near = F.instr(F.lower(F.substr(text, begin + 1, F.length(word) + 8)), F.lower(word)) - 1 + begin
        aligned = (F.lower(value) != F.lower(word)) & (near >= begin) & (F.abs(near - item["start"]) <= 4)
        at = F.when(aligned, near).otherwise(start)
        shown = F.when(aligned, F.substr(text, near + 1, F.length(word))).otherwise(value)
        return F.array(make_span(type_, shown, at, score, meta))

    def one(item: Column) -> Column:
        word = F.regexp_replace(trim_all(F.coalesce(item["word"], F.lit(""))), "^##", "")
        type_ = _entity_type(item["label"])
        has_position = item["start"].isNotNull() & item["end"].isNotNull() & (item["end"] <= F.length(text))
        return let(
            word,
            lambda w: F.when(type_.isNull() | (F.length(w) < 2), no_spans())
            .when(has_position, placed(item, type_, w))
            .when(
                ~F.coalesce(item["word"], F.lit("")).startswith("##"),
                value_spans(text, w, type_, 0.90, meta, edge=_NAME_EDGE),
            )
            .otherwise(no_spans()),
        )

    found = F.filter(F.flatten(F.transform(as_column(scored), one)), lambda s: s["value"] != "")
    return F.when(F.coalesce(F.size(as_column(scored)), F.lit(0)) > 0, merge_spans(text, found)).otherwise(no_spans())


def spans_from_reply(text, reply, source: str = "model") -> Column:
    """Spans named in a text reply: ``{"entities": [{type, value}]}`` or a bare array,
    with or without code fences and words around it."""
    text = as_column(text)
    items = "array<struct<type:string,value:string>>"
    clean = trim_all(F.regexp_replace(as_column(reply), r"(?i)```(?:json)?", ""))
    in_object = lambda t: F.from_json(F.get_json_object(t, "$.entities"), items)
    bare = lambda t: F.when(t.startswith("["), F.from_json(t, items))
    listed = let(
        clean,
        lambda t: F.coalesce(
            bare(t),
            in_object(t),
            in_object(F.regexp_extract(t, r"(?s)\{.*\}", 0)),
            bare(F.regexp_extract(t, r"(?s)\[.*\]", 0)),
            F.array().cast(items),
        ),
    )
    meta = metadata({"source": source})

    def one(item: Column) -> Column:
        type_ = F.when(F.upper(item["type"]) == "ORGANIZATION", "ORGANIZATION").otherwise("PERSON")
        return let(
            trim_all(F.coalesce(item["value"], F.lit(""))),
            lambda v: F.when(F.length(v) < 2, no_spans()).otherwise(
                value_spans(text, v, type_, 0.88, meta, edge=_NAME_EDGE)
            ),
        )

    return F.flatten(F.transform(listed, one))


def score_entities(
    df: DataFrame, text_col: str, fn: Callable[[pd.Series], list], out: str = "model_spans", source: str = "model",
    failed: str = "model_failed",
) -> DataFrame:
    """Add spans from ``fn``, which maps a batch of texts to lists of
    ``{label, word, start, end, score}``. If a batch fails, its texts are
    tried one by one; a text that fails by itself has no entities and ``failed`` is true."""

    df_type = "array<struct<label: string, word: string, start: int, end: int, score: double>>"

    @F.pandas_udf(T.ArrayType(T.StructType([
        T.StructField("label", T.StringType()), T.StructField("word", T.StringType()),
        T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()),
        T.StructField("score", T.DoubleType()),
    ])))
    def call(texts: pd.Series) -> pd.Series:
        fields = ("label", "word", "start", "end", "score")
        pick = lambda replies: [[{k: item.get(k) for k in fields} for item in reply] for reply in replies]
        try:
            return pd.Series(pick(fn(texts)), dtype=object)
        except Exception:
            return pd.Series([one(texts.iloc[i : i + 1], pick) for i in range(len(texts))], dtype=object)

    def one(text: pd.Series, pick):
        try:
            return pick(fn(text))[0]
        except Exception:
            return None

    return (
        df.withColumn("_scored", call(text_col))
        .withColumn(failed, F.col("_scored").isNull())
        .withColumn("_scored", F.coalesce("_scored", F.array().cast(df_type)))
        .withColumn(out, spans_from_scores(text_col, "_scored", source))
        .drop("_scored")
    )
