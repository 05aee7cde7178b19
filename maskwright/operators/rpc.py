"""Tool messages (JSON-RPC lines): rewrite arguments and results, restore results."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed_values as fixed
from ..functions.json_text import FIXED, LEAF, SCREENED, quote_json, result_pieces, rpc_pieces
from ..functions.text import normalize_text
from .detectors import DetectorSet
from .firewall import match_rules, score_matches
from .joins import join_null_safe
from .vault import Anonymized, anonymize, restore


def direction(line) -> Column:
    """``server_to_client`` if the message has a result or an error."""
    line = F.col(line) if isinstance(line, str) else line
    has = lambda key: F.get_json_object(line, f"$.{key}").isNotNull()
    return F.when(has("result") | has("error"), "server_to_client").otherwise("client_to_server")


def _reassemble(df: DataFrame, parts: DataFrame, keys: Sequence[str], line: str, out: str) -> DataFrame:
    """Join the pieces of each line; lines without pieces pass through."""
    text = F.when(F.col("_kind") == FIXED, F.col("_done")).otherwise(quote_json("_done"))
    lines = (
        parts.select(*keys, F.struct("_piece", text.alias("t")).alias("_p"))
        .groupBy(*keys)
        .agg(F.array_sort(F.collect_list("_p")).alias("_ps"))
        .select(*keys, F.array_join(F.col("_ps.t"), "").alias(out))
    )
    return join_null_safe(df, lines, keys).withColumn(out, F.coalesce(out, line))


def _exploded(df: DataFrame, pieces: Column, keys: Sequence[str]) -> DataFrame:
    cut = df.select(*keys, pieces.alias("_ps"))
    return cut.select(*keys, F.posexplode_outer("_ps").alias("_piece", "_p")).filter("_p IS NOT NULL").select(
        *keys, "_piece", F.col("_p.text").alias("_text_in"), F.col("_p.kind").alias("_kind")
    )


def sanitize_rpc(
    df: DataFrame, line: str = "line", session_cols: Sequence[str] = ("session_id",), order_cols: Sequence[str] = ("seq",),
    two_pass: bool = True, detectors: DetectorSet | None = None, vault: DataFrame | None = None, out: str = "sanitized_line",
) -> tuple[DataFrame, DataFrame]:
    """Rewrite call arguments, tool texts and resource texts; return lines and vault.

    Tool texts that trip the screening rules get a notice in front. Lines that are no
    JSON, and messages with nothing to rewrite, keep their meaning.
    """
    keys = [*session_cols, *order_cols]
    parts = _exploded(df, rpc_pieces(line), keys)
    leaves = parts.filter(F.col("_kind") != FIXED)
    done: Anonymized = anonymize(
        leaves, "_text_in", session_cols, [*order_cols, "_piece"], two_pass=two_pass, detectors=detectors, vault=vault
    )
    screened = done.rewritten.withColumn(
        "_norm", normalize_text(F.when(F.col("_kind") == SCREENED, F.col("_text_in")))
    )
    unsafe = ~score_matches(match_rules("_norm"))["safe"]
    rewritten = screened.withColumn(
        "_done",
        F.when((F.col("_kind") == SCREENED) & unsafe, F.concat(F.lit(fixed.TOOL_NOTICE), F.col("sanitized"))).otherwise(
            F.col("sanitized")
        ),
    ).select(*keys, "_piece", "_kind", "_done")
    skeleton = parts.filter(F.col("_kind") == FIXED).select(*keys, "_piece", "_kind", F.col("_text_in").alias("_done"))
    return _reassemble(df, skeleton.unionByName(rewritten), keys, line, out), done.vault


def restore_rpc(
    df: DataFrame, vault: DataFrame, line: str = "line", session_cols: Sequence[str] = ("session_id",),
    order_cols: Sequence[str] = ("seq",), out: str = "restored_line",
) -> DataFrame:
    """Put originals back into every string below ``result``."""
    keys = [*session_cols, *order_cols]
    parts = _exploded(df, result_pieces(line), keys)
    leaves = restore(parts.filter(F.col("_kind") == LEAF), vault, "_text_in", session_cols, [*order_cols, "_piece"], "_done")
    skeleton = parts.filter(F.col("_kind") == FIXED).withColumn("_done", F.col("_text_in"))
    columns = [*keys, "_piece", "_kind", "_done"]
    return _reassemble(df, skeleton.select(*columns).unionByName(leaves.select(*columns)), keys, line, out)
