"""Shannon entropy of a string and of its best window."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed_values as fixed
from .text import as_column, let


def signs(text: Column) -> Column:
    """The different characters of a text."""
    return F.array_distinct(F.split(text, ""))


def may_reach(text: Column, bits: float) -> Column:
    """Whether a text has signs enough for so many bits per character: n different ones give log2(n) at most,
    in the text and in any window of it."""
    return F.size(signs(text)) >= 2.0 ** (bits - 1e-9)


def shannon_entropy(col) -> Column:
    """Bits per character; 0 for an empty string."""

    def bits(text: Column) -> Column:
        length = F.length(text)
        shares = F.transform(signs(text), lambda c: (length - F.length(F.replace(text, c, F.lit("")))) / length)
        return F.aggregate(shares, F.lit(0.0), lambda acc, p: acc + -p * F.log2(p))

    return let(
        F.coalesce(as_column(col), F.lit("")),
        lambda t: F.when(t == "", F.lit(0.0)).otherwise(bits(t)),
    )


def window_entropy(col, size: int = fixed.ENTROPY_WINDOW, step: int = 2) -> Column:
    """``struct(max_entropy, best_window)``; the earliest of equal windows wins."""

    def best(text: Column) -> Column:
        starts = F.sequence(F.lit(0), F.length(text) - size, F.lit(step))
        scored = F.transform(
            starts, lambda i: F.struct(shannon_entropy(F.substr(text, i + 1, F.lit(size))).alias("h"), (-i).alias("i"))
        )
        return let(
            F.array_max(scored),
            lambda m: F.struct(
                m["h"].alias("max_entropy"), F.substr(text, 1 - m["i"], F.lit(size)).alias("best_window")
            ),
        )

    whole = lambda t: F.struct(shannon_entropy(t).alias("max_entropy"), t.alias("best_window"))
    return let(
        F.coalesce(as_column(col), F.lit("")),
        lambda t: F.when(F.length(t) <= size, whole(t)).otherwise(best(t)),
    )
