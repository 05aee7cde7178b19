"""Signed honeytokens: minting, planting, finding them again."""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed_values as fixed
from ..functions.crypto import hmac_sha256
from ..functions.text import as_column, java_pattern, let
from .joins import join_null_safe


def clean_label(label) -> Column:
    text = F.lit(label) if isinstance(label, str) else label
    return let(
        F.substring(F.regexp_replace(F.upper(text), "[^A-Z0-9_-]", ""), 1, 16),
        lambda t: F.when(t == "", F.lit("TOKEN")).otherwise(t),
    )


def canary_token(id_col, secret: str, label="HONEY", salt: str = "") -> Column:
    """``CL-CANARY-<LABEL>-<4 nonce digits><8 signature digits>``.

    The nonce comes from the row's id and a salt, so a rerun mints the same token.
    """
    key = hashlib.sha256(secret.encode()).digest()
    nonce = F.substring(F.sha2(F.concat(as_column(id_col).cast("string"), F.lit(salt)), 256), 1, 16)
    signed = F.struct(clean_label(label).alias("label"), nonce.alias("nonce"))
    return let(
        signed,
        lambda s: F.concat(
            F.lit(fixed.CANARY_PREFIX),
            s["label"],
            F.lit("-"),
            F.substring(s["nonce"], 1, 4),
            F.substring(hmac_sha256(key, F.concat(s["label"], F.lit(":"), s["nonce"])), 1, 8),
        ),
    )


def mint_canaries(df: DataFrame, id_col: str, secret: str, label="HONEY", salt: str = "") -> DataFrame:
    """Add ``token`` and its clean ``label``."""
    return df.withColumn("token", canary_token(id_col, secret, label, salt)).withColumn(
        "label", clean_label(label)
    )


def active_registry(registry: DataFrame, now, days: int | None = None, minted_at: str = "minted_at") -> DataFrame:
    """Tokens minted up to ``now`` and at most so many ``days`` before it; without ``days``, all of
    them. The registry is a table and takes any number of tokens."""
    at, now = F.col(minted_at).cast("timestamp"), F.lit(now).cast("timestamp")
    fresh = at >= now - F.make_dt_interval(F.lit(days)) if days is not None else F.lit(True)
    return registry.filter((at <= now) & fresh)


def inject_canaries(
    turns: DataFrame, secret: str, session: str = "conv_id", turn: str = "turn", role: str = "role",
    text: str = "text", label: str = "SENTINEL", salt: str = "",
) -> DataFrame:
    """Sign each conversation in its first system turn, or in a new one before all turns.

    Rows with a null session are one conversation, signed as the empty name; a null turn comes before all
    others. Only keys and roles are aggregated; texts other than system turns never move.
    """
    before, after = fixed.CANARY_MARK.split("{}")
    mark = F.concat(F.lit(before), canary_token(F.coalesce(F.col(session).cast("string"), F.lit("")), secret, label, salt), F.lit(after))
    is_system = F.coalesce(F.col(role) == "system", F.lit(False))
    # a struct orders a null turn first
    system_turn = F.min(F.when(is_system, F.struct(F.col(turn).alias("turn"))))
    firsts = turns.groupBy(session).agg(
        system_turn.isNotNull().alias("_signed"), system_turn["turn"].alias("_system"), F.min(turn).alias("_first")
    )
    system = (
        turns.filter(is_system)
        .transform(lambda rows: join_null_safe(rows, firsts.select(session, "_system"), [session], "inner"))
        .withColumn(
            text, F.when(F.col(turn).eqNullSafe(F.col("_system")), F.concat(F.col(text), F.lit("\n"), mark)).otherwise(F.col(text))
        )
        .select(*turns.columns)
    )
    added = firsts.filter("NOT _signed").select(
        session,
        (F.coalesce("_first", F.lit(1)) - 1).cast(turns.schema[turn].dataType).alias(turn),
        F.lit("system").alias(role),
        mark.alias(text),
    )
    return turns.filter(~is_system).unionByName(system).unionByName(added, allowMissingColumns=True)


def find_canaries(text) -> Column:
    """Every token-shaped string, registered or not."""
    return F.regexp_extract_all(as_column(text), F.lit(java_pattern(fixed.CANARY)), F.lit(0))


def scan_canaries(
    df: DataFrame, registry: DataFrame, text_col: str = "text", keys: Sequence[str] = ("id",)
) -> DataFrame:
    """Rows that carry registered tokens: ``keys``, ``leak_detected``, ``matched_tokens``.

    Foreign tokens drop out in a semi join; rows without the prefix skip the pattern.
    """
    keys = list(keys)
    found = df.filter(F.col(text_col).contains(fixed.CANARY_PREFIX)).select(
        *keys, F.posexplode(find_canaries(text_col)).alias("_pos", "token")
    )
    own = found.join(registry.select("token").distinct(), "token", "left_semi")
    return (
        own.groupBy(*keys)
        .agg(F.array_sort(F.collect_list(F.struct("_pos", "token"))).alias("_found"))
        .select(*keys, F.lit(True).alias("leak_detected"), F.col("_found.token").alias("matched_tokens"))
    )
