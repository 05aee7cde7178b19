"""Response chunk streams: hold back what may be split, cut off leaked honeytokens."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions import fixed_values as fixed
from ..functions.text import java_pattern
from ..operators.leaks import check_responses
from ..operators.vault import restore

_OPEN = re.compile(fixed.PLACEHOLDER_START)
_TOKEN = re.compile(r"\S*\Z")


def held_length(text: str, tail: int = 0, longest: int = fixed.MAX_PLACEHOLDER_LENGTH) -> int:
    """How many last characters must wait for the next chunk.

    That is an open bracket that may still become a placeholder of up to ``longest`` characters,
    and with ``tail`` an unfinished word of up to so many characters.
    """
    at = text.rfind("[")
    held = 0
    if at >= 0 and len(text) - at <= longest and _OPEN.fullmatch(text, at):
        held = len(text) - at
    if tail:
        word = len(_TOKEN.search(text[: len(text) - held] if held else text).group())
        if word + held <= max(tail, held):
            held += word
    return held


def _realign(tail: int, longest: int, ts: str | None, idle_ms: int, columns: list[str]):
    """Each chunk gives the text that became safe with it; a ``done`` chunk gives the rest."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            buffer, last_seq, aborted, *last = state.get
            state.remove()
            if buffer and not aborted:
                yield pd.DataFrame([(*key, last_seq, buffer, False)], columns=columns)
            return
        rows = pd.concat(list(batches)).sort_values("seq", kind="stable")
        leaking = set(rows.loc[rows["_leak"], "seq"])
        rows = rows[rows["_nth"] == 0]
        buffer, last_seq, aborted = state.get if state.exists else ("", -1, False)
        out, finished = [], False
        for seq, delta, done in zip(rows["seq"], rows["delta"], rows["done"]):
            last_seq = int(seq)
            if aborted or finished:
                continue
            delta = delta or ""
            if seq in leaking:
                aborted, buffer = True, ""
                out.append((*key, last_seq, fixed.CANARY_NOTICE, True))
                continue
            buffer += delta
            keep = 0 if done else held_length(buffer, tail, longest)
            out.append((*key, last_seq, buffer[: len(buffer) - keep], False))
            buffer = buffer[len(buffer) - keep :]
            finished = bool(done)
        if finished:
            state.remove()
        else:
            state.update((buffer, last_seq, aborted))
            if ts is not None:
                newest = int(rows[ts].max().timestamp() * 1000)
                state.setTimeoutTimestamp(max(newest, state.getCurrentWatermarkMs()) + idle_ms)
        yield pd.DataFrame(out, columns=columns)

    return run


def realign_chunks(
    chunks: DataFrame, stream: str = "stream_id", tail: int = 0, canaries: DataFrame | Iterable[str] = (),
    ts: str | None = None, idle_ms: int = 1_800_000, longest: int = fixed.MAX_PLACEHOLDER_LENGTH,
) -> DataFrame:
    """Chunks ``(stream, seq, delta, done)`` re-cut so that no placeholder is split.

    Works on streams; state is the held text, at most a placeholder long (or ``tail``). Where
    types have long names, give ``longest_placeholder(vault)`` as ``longest``.
    ``canaries`` is the registry of active honeytokens, a table with ``token`` of any size, or a
    few tokens: a chunk that carries one becomes a notice with ``aborted``, and the rest of its
    stream is dropped. A stream
    without ``done`` gives its rest once the watermark of ``ts`` is ``idle_ms`` past its
    last chunk.
    """
    if not isinstance(canaries, DataFrame):
        rows = [(t,) for t in sorted(set(canaries))]
        canaries = chunks.sparkSession.createDataFrame(rows, "token string") if rows else None
    if canaries is None:
        marked = chunks.withColumn("_nth", F.lit(0)).withColumn("_leak", F.lit(False))
    else:
        # a row per token in a chunk, nearly always one, meets the registry
        found = F.array_distinct(F.regexp_extract_all("delta", F.lit(java_pattern(fixed.CANARY)), F.lit(0)))
        known = canaries.select(F.col("token").alias("_token"), F.lit(True).alias("_known")).distinct()
        marked = chunks.select("*", F.posexplode_outer(found).alias("_nth", "_token")).join(known, "_token", "left")
        marked = marked.withColumn("_nth", F.coalesce("_nth", F.lit(0))).withColumn("_leak", F.coalesce("_known", F.lit(False)))
        marked = marked.drop("_token", "_known")
    out = T.StructType(
        [
            chunks.schema[stream],
            T.StructField("seq", T.LongType()),
            T.StructField("text", T.StringType()),
            T.StructField("aborted", T.BooleanType()),
        ]
    )
    state = T.StructType(
        [
            T.StructField("buffer", T.StringType()),
            T.StructField("last_seq", T.LongType()),
            T.StructField("aborted", T.BooleanType()),
        ]
    )
    return marked.groupBy(stream).applyInPandasWithState(
        _realign(tail, longest, ts, idle_ms, out.names), out, state, "append",
        GroupStateTimeout.EventTimeTimeout if ts else GroupStateTimeout.NoTimeout,
    )


def longest_placeholder(vault: DataFrame) -> int:
    """Characters of the longest placeholder in a vault, and no less than the usual bound."""
    found = vault.agg(F.max(F.length("placeholder"))).first()[0]
    return max(fixed.MAX_PLACEHOLDER_LENGTH, found or 0)


def restore_stream(
    realigned: DataFrame, vault: DataFrame, session_cols: list[str], write: Callable[[DataFrame, int], None],
    checkpoint: str, order_cols: list[str] = ("seq",), leaks: bool = False, trigger: dict | None = None, **options,
) -> StreamingQuery:
    """Restore (and with ``leaks`` check) realigned chunks per micro-batch, then ``write``.

    Restoring needs no state once chunks are realigned, so a batch is an ordinary join.
    """

    def run(batch: DataFrame, batch_id: int) -> None:
        if leaks:
            done = check_responses(batch, vault, "text", session_cols, order_cols, **options)
        else:
            done = restore(batch, vault, "text", session_cols, order_cols)
        write(done, batch_id)

    writer = realigned.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"processingTime": "1 second"})).start()
