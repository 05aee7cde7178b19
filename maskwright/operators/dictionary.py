"""Large dictionaries: terms meet texts in a join on their first words."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.staging import stage
from .joins import join_null_safe
from .spans import longest_cover, make_span
from .vault import gram_sizes, leading_gram, sift_grams, value_hits, word_grams


def dictionary_spans(
    df: DataFrame, terms: DataFrame, text_col: str = "text", keys: Sequence[str] = ("doc_id",), out: str = "term_spans"
) -> DataFrame:
    """Rows of ``df`` with a term in them: ``keys``, the text, and the spans.

    ``terms``: ``(dict_name, type, term, case_sensitive)``. A text meets only terms
    whose first four words occur in it as a sequence, whatever the size of the list;
    those are then located exactly. Terms without any word go by their first two characters. A Bloom
    filter of the terms' leading words drops the other words of a text before they are shuffled. Null keys
    are keys; rows that repeat their keys share candidates.
    """
    keys = list(keys)
    leading = leading_gram("term")
    listed = stage(terms.select(
        leading["gram"].alias("_gram"), leading["size"].alias("_size"),
        F.struct("dict_name", "type", "term", "case_sensitive").alias("_term"),
    ).filter(F.col("_gram").isNotNull()))
    sizes, bits = gram_sizes(listed, "_size")
    words = df.select(*keys, F.explode(word_grams(F.col(text_col), sizes)).alias("_gram"))
    hits = sift_grams(words, listed, bits).join(listed.drop("_size"), "_gram")
    candidates = hits.groupBy(*keys).agg(F.collect_set("_term").alias("_terms"))
    found = join_null_safe(df.select(*keys, text_col), candidates, keys, "inner").withColumn("_text", F.col(text_col))

    def locate(t):
        hits = value_hits(F.col("_text"), t["term"], minds_case=t["case_sensitive"])
        meta = F.create_map(F.lit("source"), F.lit("dictionary"), F.lit("dictionary"), t["dict_name"])
        return F.transform(hits, lambda h: make_span(t["type"], h["value"], h["start"], 1.0, meta))

    # A fixed order of terms, so that equal spans resolve the same way everywhere.
    spans = F.flatten(F.transform(F.array_sort("_terms"), locate))
    return found.withColumn(out, longest_cover(spans)).filter(F.size(out) > 0).select(*keys, text_col, out)
