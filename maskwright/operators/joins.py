"""Joins in which a null key is a key like any other, and row keys of one's own."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def join_null_safe(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "left") -> DataFrame:
    """``left.join(right, keys, how)``, but null meets null. ``how``: inner, left, left_semi or left_anti.

    A check that joins by plain equality lets rows with a null session or turn pass unchecked.
    """
    keys = list(keys)
    own = {k: f"_right_{i}" for i, k in enumerate(keys)}
    renamed = right.select(*[F.col(k).alias(n) for k, n in own.items()], *[c for c in right.columns if c not in own])
    on = F.lit(True)
    for k, n in own.items():
        on = on & F.col(k).eqNullSafe(F.col(n))
    joined = left.join(renamed, on, how)
    return joined if how in ("left_semi", "left_anti") else joined.drop(*own.values())


def with_row_key(df: DataFrame, name: str = "_text_row") -> DataFrame:
    """Number rows, for joins back to single rows whatever the caller's keys repeat. Stage the
    result before it is read twice."""
    return df.withColumn(name, F.monotonically_increasing_id())
