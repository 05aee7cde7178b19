"""Text helpers as Spark columns: pattern dialect, trimming, folding, estimates."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterable
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import fixed_values as fixed

_SPACE_CHARS = r"\s\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}"
SPACE = f"[{_SPACE_CHARS}]"
# The white space that ECMAScript's \s knows and Java's does not.
WIDE_SPACES = "".join(
    map(chr, [0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000, 0xFEFF])
)
MARK = "\x01"
_EDGES = {
    r"\b": r"(?:(?<!\w)(?=\w)|(?<=\w)(?!\w))",
    r"\<": r"(?<!\w)",
    r"\>": r"(?!\w)",
}


def java_pattern(pattern: str) -> str:
    """Java spelling of the word edges in a pattern from ``fixed_values``.

    Texts are matched in the form given by :func:`plain_spaces`, so ``\\s`` needs no
    wider class: a chain of ranges tested at every character is slow.
    """
    out, in_class, i = [], False, 0
    while i < len(pattern):
        pair = pattern[i : i + 2]
        if pair[0] == "\\":
            out.append(pair if in_class else _EDGES.get(pair, pair))
            i += 2
            continue
        if pair[0] == "[":
            in_class = True
        elif pair[0] == "]":
            in_class = False
        out.append(pair[0])
        i += 1
    return "".join(out)


def has_rare(text: Column) -> Column:
    """Whether a text holds the mark or white space that Java's ``\\s`` does not know.
    Plain ASCII texts, the common case, are told by their byte length."""
    wide = (F.octet_length(text) != F.length(text)) & has_any(text, WIDE_SPACES)
    return text.contains(MARK) | wide


def has_any(text: Column, words: Iterable[str]) -> Column:
    """Whether a text holds one of the words. Bytes are compared, so many words cost less than one pattern."""
    return reduce(lambda a, b: a | b, [text.contains(w) for w in words])


def plain_spaces(text: Column, rare: Column) -> Column:
    """The text with wide spaces as vertical tabs and marks as blanks, same length."""
    return F.when(
        rare, F.translate(text, MARK + WIDE_SPACES, " " + "\x0b" * len(WIDE_SPACES))
    ).otherwise(text)


def as_column(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def let(value: Column, body) -> Column:
    """Bind ``value`` once inside an expression: ``body`` may use it many times."""
    return F.transform(F.array(value), body)[0]


def java_quote(literal: str) -> str:
    """A literal as a Java pattern."""
    return re.sub(r"([.*+?^${}()|\[\]\\])", r"\\\1", literal)


def quote_pattern(col) -> Column:
    """Column version of :func:`java_quote`."""
    return F.regexp_replace(as_column(col), r"([.*+?^${}()|\[\]\\])", r"\\$1")


def trim_all(col) -> Column:
    """Trim every kind of white space, not only U+0020."""
    return F.regexp_replace(as_column(col), f"^{SPACE}+|{SPACE}+$", "")


def lookup_key(col) -> Column:
    """The form in which two spellings of a value count as the same value."""
    return F.lower(trim_all(col))


def estimate_tokens(col) -> Column:
    """About four characters or 1.3 per word, whichever is more; at least 1."""
    text = as_column(col)
    ascii_only = F.octet_length(text) == F.length(text)
    counted = F.when(ascii_only, F.regexp_count(text, F.lit(r"\S+"))).otherwise(
        F.regexp_count(text, F.lit(f"[^{_SPACE_CHARS}]+"))
    )
    words = F.greatest(F.lit(1), counted)
    estimate = F.greatest(F.length(text) / 4, words * 1.3)
    return F.when(text.isNull() | (text == ""), F.lit(0)).otherwise(
        F.greatest(F.lit(1), F.floor(estimate + 0.5)).cast("int")
    )


def prompt_hash(col) -> Column:
    """First 16 hex digits of SHA-256."""
    return F.substring(F.sha2(as_column(col), 256), 1, 16)


def wildcard_match(pattern, value) -> Column:
    """``*`` wildcards, whole value, any case; a bare or empty pattern takes all."""
    pattern, value = as_column(pattern), as_column(value)
    escaped = F.regexp_replace(pattern, r"([.+?^${}()|\[\]\\])", r"\\$1")
    regex = F.concat(F.lit("(?iu)^"), F.replace(escaped, F.lit("*"), F.lit(".*")), F.lit("$"))
    return (
        F.when(pattern.isin("*", ""), F.lit(True))
        .when(~pattern.contains("*"), F.lower(pattern) == F.lower(value))
        .otherwise(F.regexp_like(value, regex))
    )


# Characters that NFKC leaves alone and that never combine with a neighbour from
# the same set: ASCII, Latin-1, Latin Extended-A without its ligatures, common
# typographic marks, Greek and Cyrillic letters. Other rows visit Python.
_STABLE = (
    r"[\x00-\x9F\x{00A1}-\x{00A7}\x{00A9}\x{00AB}-\x{00AE}\x{00B0}\x{00B1}\x{00B6}\x{00B7}\x{00BB}\x{00BF}-\x{0131}"
    r"\x{0134}-\x{013E}\x{0141}-\x{0148}\x{014A}-\x{017E}\x{0391}-\x{03A1}\x{03A3}-\x{03CE}\x{0400}-\x{0481}"
    r"\x{048A}-\x{0513}\x{2010}\x{2012}-\x{2016}\x{2018}-\x{201F}\x{2020}-\x{2022}\x{20AC}\x{FFFD}"
    r"\x{200B}-\x{200F}\x{FEFF}]*"
)


# Signs that no step of the normalisation touches, most texts in Latin script through.
_UNTOUCHED = (
    r"^[\t\n\r -~\x{00A1}-\x{00A7}\x{00A9}\x{00AB}\x{00AC}\x{00AE}\x{00B0}\x{00B1}\x{00B6}\x{00B7}\x{00BB}\x{00BF}-\x{0131}"
    r"\x{0134}-\x{013E}\x{0141}-\x{0148}\x{014A}-\x{017E}\x{2010}\x{2012}-\x{2016}\x{2018}-\x{201F}\x{2020}-\x{2022}\x{20AC}\x{FFFD}]*+\z"
)


@F.pandas_udf(T.StringType())
def _nfkc(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: unicodedata.normalize("NFKC", t), na_action="ignore")


def normalize_text(col) -> Column:
    """NFKC, then invisible characters removed, then look-alike letters to Latin.

    Only rows that NFKC could change carry text to Python; the rest pass a null.
    """
    text = F.coalesce(as_column(col), F.lit(""))
    untouched = F.regexp_like(text, F.lit(_UNTOUCHED))
    unstable = ~untouched & ~F.regexp_like(text, F.lit(f"^{_STABLE}$"))
    composed = F.coalesce(_nfkc(F.when(unstable, text)), text)
    hidden = f"(?:{fixed.ZERO_WIDTH}|{fixed.CONTROL_CHARACTERS})"
    visible = let(
        composed, lambda t: F.when(F.regexp_like(t, F.lit(hidden)), F.regexp_replace(t, hidden, "")).otherwise(t)
    )
    latin = let(
        visible,
        lambda t: F.when(
            F.regexp_like(t, F.lit(r"[\x{0370}-\x{03FF}\x{0400}-\x{052F}]")), F.translate(t, *fixed.LOOKALIKES)
        ).otherwise(t),
    )
    return F.when(untouched, text).otherwise(latin)
