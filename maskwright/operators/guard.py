"""Usage limits and loop detection per client.

``offered_load`` and ``identical_runs`` measure what clients send; ``judge_usage`` makes
a decision per request of both.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import fixed_values as fixed
from ..functions.text import estimate_tokens, prompt_hash
from .ordered import micros, number_islands, sliding_totals, time_block, trailing_latest

WINDOW_SECONDS = 60


@dataclass(frozen=True)
class Limits:
    requests_per_minute: int = 60
    tokens_per_minute: int = 100_000
    identical_prompts: int = 3
    cooldown_ms: int = 30_000


def with_usage(df: DataFrame, prompt: str) -> DataFrame:
    """Add ``tokens`` and ``prompt_hash``; the prompt itself is not needed after."""
    return df.withColumn("tokens", estimate_tokens(prompt)).withColumn("prompt_hash", prompt_hash(prompt))


def offered_load(df: DataFrame, client: str, ts: str, limits: Limits = Limits(), tokens: str = "tokens") -> DataFrame:
    """Requests and tokens a client offered in the last 60 seconds, without this row.

    ``over_rate`` and ``over_quota`` tell whether this row would exceed a limit if all
    earlier ones had been admitted.
    """
    summed = sliding_totals(
        df, [client], ts, WINDOW_SECONDS, {"requests_60s": F.lit(1), "tokens_60s": F.col(tokens)}
    )
    return (
        summed.withColumn("requests_60s", F.col("requests_60s") - 1)
        .withColumn("tokens_60s", F.col("tokens_60s") - F.col(tokens))
        .withColumn("over_rate", F.col("requests_60s") >= limits.requests_per_minute)
        .withColumn("over_quota", F.col("tokens_60s") + F.col(tokens) > limits.tokens_per_minute)
    )


def identical_runs(
    df: DataFrame, client: str, ts: str, order: str, limits: Limits = Limits(), hash_col: str = "prompt_hash"
) -> DataFrame:
    """Runs of the same prompt, each within 60 seconds of the one before: ``run_no``,
    ``run_length`` so far, and ``looping`` from the limit on."""
    rows = df.withColumn("_at", micros(ts))
    runs = number_islands(
        rows, [client], ["_at", order], time_block(ts), [hash_col, "_at"],
        lambda prev: (prev[hash_col] != F.col(hash_col))
        | (F.col("_at") - prev["_at"] > WINDOW_SECONDS * 1_000_000),
        island="run_no", position="run_length",
    )
    return runs.drop("_at").withColumn("looping", F.col("run_length") >= limits.identical_prompts)


def judge_usage(
    df: DataFrame, client: str, ts: str, order: str, limits: Limits = Limits(), tie: str | None = None
) -> DataFrame:
    """Add ``allowed``, ``circuit_state`` and ``reason`` to rows with ``with_usage``.

    A row is refused if its client repeats itself too often or offered too much in the
    trailing minute, and for ``cooldown_ms`` after a row that repeats: that row opens the client's
    breaker. All offered requests count, refused ones too, so a decision is a
    sliding sum and needs no replay of earlier decisions; a client that goes on repeating itself keeps its
    breaker open. A null reason means allowed. Rows without a client are one client, rows without a time share
    one moment before all others. ``tie`` is a last order column where ``order`` may repeat.
    """
    order_cols = [order] + ([tie] if tie else [])
    moment = F.coalesce(F.col(ts).cast("timestamp"), F.timestamp_seconds(F.lit(0)))
    work = df.withColumn("_moment", moment).withColumn("_order", F.struct(*order_cols))
    load = offered_load(work, client, "_moment", limits)
    judged = identical_runs(load, client, "_moment", "_order", limits)
    opened = trailing_latest(
        judged, [client], "_moment", limits.cooldown_ms, F.col("looping"), "_opened", max(3600, -(-limits.cooldown_ms // 1000))
    )
    left = F.ceil((F.col("_opened") + limits.cooldown_ms * 1000 - micros("_moment")) / 1_000_000)
    before, after = fixed.COOLDOWN_REASON.split("{}")
    is_open = F.col("_opened").isNotNull()
    reason = (
        F.when(F.col("looping"), F.lit(fixed.LOOP_REASON.format(limits.identical_prompts)))
        .when(is_open, F.concat(F.lit(before), left.cast("string"), F.lit(after)))
        .when(F.col("over_rate"), F.lit(fixed.RATE_REASON.format(limits.requests_per_minute)))
        .when(F.col("over_quota"), F.lit(fixed.QUOTA_REASON.format(limits.tokens_per_minute)))
    )
    return opened.select(
        *df.columns, reason.isNull().alias("allowed"),
        F.when(F.col("looping") | is_open, "OPEN").otherwise("CLOSED").alias("circuit_state"), reason.alias("reason"),
    )


def reset_client(state: DataFrame, client: str, name: str) -> DataFrame:
    """A usage table without one client."""
    return state.filter(~F.col(client).eqNullSafe(F.lit(name)))
