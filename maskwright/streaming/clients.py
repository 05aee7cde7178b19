"""Session vaults and windowed counts on streams."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions.text import lookup_key, trim_all

def _plain(row) -> object:
    return row[0] if isinstance(row, tuple) else row


class SessionVault(StatefulProcessor):
    """Placeholders of one session: a key-value map in the state store, so a large
    session is read and written by value and never as a whole."""

    def __init__(self, session: str, ttl_ms: int):
        self.session, self.ttl_ms = session, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.known = handle.getMapState("known", "k string", "seq long, original string", self.ttl_ms)
        self.counters = handle.getMapState("counters", "type string", "n long", self.ttl_ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows)).sort_values("position", kind="stable").reset_index(drop=True)
        seqs, originals, seen, counts = [], [], {}, {}
        for type_, k, value in zip(batch["type"], batch["lookup_key"], batch["value"]):
            full = f"{type_}\x01{k}"
            if full not in seen:
                if self.known.containsKey((full,)):
                    seq, original = self.known.getValue((full,))
                else:
                    if type_ not in counts:
                        counts[type_] = (
                            int(self.counters.getValue((type_,))[0]) if self.counters.containsKey((type_,)) else 0
                        )
                    counts[type_] += 1
                    seq, original = counts[type_], value
                # Written again on each use: the time to live counts from the last access.
                self.known.updateValue((full,), (int(seq), original))
                seen[full] = (int(seq), original)
            seqs.append(seen[full][0])
            originals.append(seen[full][1])
        for type_ in set(batch["type"]):
            if type_ not in counts and self.counters.containsKey((type_,)):
                counts[type_] = int(self.counters.getValue((type_,))[0])
        for type_, n in counts.items():
            self.counters.updateValue((type_,), (n,))
        out = batch[["position", "type", "lookup_key"]].copy()
        out.insert(0, self.session, _plain(key))
        out["placeholder"] = [f"[{t}_{n}]" for t, n in zip(batch["type"], seqs)]
        out["original_value"], out["seq"] = originals, seqs
        yield out

    def close(self) -> None:
        pass


def vault_stream(spans: DataFrame, session: str, position: str, ttl_ms: int = 1_800_000) -> DataFrame:
    """Placeholders for a stream of exploded spans; counters go on within a session.

    Needs the RocksDB state store provider. ``position`` orders spans inside a batch.
    Time to live runs on the clock, which keeps ``availableNow`` queries busy unless
    ``spark.sql.streaming.noDataMicroBatches.enabled`` is off.
    """
    rows = spans.select(
        session, F.col(position).alias("position"), "type",
        lookup_key("value").alias("lookup_key"), trim_all("value").alias("value"),
    )
    out = T.StructType(
        [
            spans.schema[session],
            T.StructField("position", spans.schema[position].dataType),
            T.StructField("type", T.StringType()),
            T.StructField("lookup_key", T.StringType()),
            T.StructField("placeholder", T.StringType()),
            T.StructField("original_value", T.StringType()),
            T.StructField("seq", T.LongType()),
        ]
    )
    return rows.groupBy(session).transformWithStateInPandas(SessionVault(session, ttl_ms), out, "append", "ProcessingTime")


def window_counts(audit: DataFrame, ts: str, window: str = "1 minute", lateness: str = "10 minutes") -> DataFrame:
    """Requests, entities and risky requests per tumbling window, emitted when complete."""
    return (
        audit.withWatermark(ts, lateness)
        .groupBy(F.window(ts, window))
        .agg(
            F.count(F.lit(1)).alias("requests"),
            F.sum("entities_detected").cast("bigint").alias("entities"),
            F.count_if(F.coalesce(F.col("risk_score"), F.lit(0)) > 0).alias("risky"),
            F.count_if(F.col("status") == "ERROR").alias("refused"),
        )
        .select(F.col("window.start").alias("window_start"), "requests", "entities", "risky", "refused")
    )


def offered_windows(df: DataFrame, client: str, ts: str, tokens: str = "tokens", lateness: str = "1 minute") -> DataFrame:
    """Offered requests and tokens per client in 60-second windows, every 10 seconds."""
    return (
        df.withWatermark(ts, lateness)
        .groupBy(client, F.window(ts, "60 seconds", "10 seconds"))
        .agg(F.count(F.lit(1)).alias("requests"), F.sum(tokens).alias("tokens"))
        .select(client, F.col("window.end").alias("window_end"), "requests", "tokens")
    )
