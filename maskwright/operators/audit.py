"""Audit records: building, sealing in hash chains, verifying, statistics."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import fixed_values as fixed
from ..functions.json_text import quote_json
from ..functions.text import as_column, let
from ..sources.staging import stage
from .joins import join_null_safe
from .ordered import default_block, ordered_rank, previous_row

AUDIT_SCHEMA = (
    "request_id string, timestamp string, model string, entities_detected int, "
    "entity_breakdown map<string,int>, processing_latency_ms double, upstream_latency_ms double, "
    "is_streaming boolean, status string, previous_hash string, hash string, policy_action string, "
    "risk_score int, firewall_flags array<string>, canary_alert boolean, circuit_breaker_tripped boolean, "
    "response_dlp_triggered boolean, response_entities_redacted int"
)
_FIELDS = dict(field.split(" ") for field in AUDIT_SCHEMA.split(", "))
AUDIT_FIELDS = tuple(_FIELDS)


def number_text(col) -> Column:
    """A number without a trailing ``.0``."""
    value = as_column(col).cast("double")
    return F.when(value == F.floor(value), value.cast("bigint").cast("string")).otherwise(value.cast("string"))


def breakdown_json(col) -> Column:
    """A map as a JSON object with sorted keys."""
    entries = F.array_sort(F.map_entries(F.coalesce(as_column(col), F.create_map().cast("map<string,int>"))))
    fields = F.transform(entries, lambda e: F.concat(quote_json(e["key"]), F.lit(":"), e["value"]))
    return F.concat(F.lit("{"), F.array_join(fields, ","), F.lit("}"))


def payload_head(columns: Sequence[str] | None = None) -> Column:
    """The sealed JSON of a record up to its previous hash. Absent optional fields are
    left out; alert flags are not sealed."""
    text = lambda key, col: F.concat(F.lit(f'"{key}":'), quote_json(col))
    plain = lambda key, value: F.concat(F.lit(f'"{key}":'), value)
    fields = [
        text("requestId", "request_id"),
        text("timestamp", "timestamp"),
        text("model", "model"),
        plain("entitiesDetected", F.col("entities_detected").cast("string")),
        plain("entityBreakdown", breakdown_json("entity_breakdown")),
        plain("processingLatencyMs", number_text("processing_latency_ms")),
        plain("upstreamLatencyMs", number_text("upstream_latency_ms")),
        plain("isStreaming", F.col("is_streaming").cast("string")),
        text("status", "status"),
        F.when(F.col("policy_action").isNotNull(), text("policyAction", "policy_action")),
        F.when(F.col("risk_score").isNotNull(), plain("riskScore", F.col("risk_score").cast("string"))),
    ]
    return F.concat(F.lit("{"), F.concat_ws(",", *fields), F.lit(',"previousHash":"'))


def record_hash(previous, head: Column | None = None) -> Column:
    """SHA-256 over the previous hash and the record's payload."""
    prev = as_column(previous)
    return F.sha2(F.concat(prev, head if head is not None else payload_head(), prev, F.lit('"}')), 256)


def audit_records(
    df: DataFrame, breakdown: str = "entity_breakdown", **columns
) -> DataFrame:
    """Shape a pipeline outcome as audit rows; missing optional fields become null.

    ``columns`` maps audit fields to columns. Values never enter the record.
    """
    chosen = {"entity_breakdown": F.col(breakdown), **columns}
    out = []
    for name, kind in _FIELDS.items():
        source = chosen.get(name)
        value = as_column(source) if source is not None else F.lit(None)
        out.append(value.cast(kind).alias(name))
    return df.select(*[c for c in df.columns if c not in _FIELDS], *out)


# --- chains --------------------------------------------------------------------


def _seal_partition(chain: Sequence[str], genesis: str):
    """Walk a partition sorted by chain and order; only the last hash is held."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, last = None, genesis
        for batch in batches:
            keys = list(zip(*[batch.column(c).to_pylist() for c in chain]))
            previous, hashes = [], []
            for key, head in zip(keys, batch.column("_head").to_pylist()):
                if key != current:
                    current, last = key, genesis
                previous.append(last)
                last = hashlib.sha256((last + head + last + '"}').encode()).hexdigest()
                hashes.append(last)
            columns, names = [], []
            for name, column in zip(batch.schema.names, batch.columns):
                if name == "_head":
                    continue
                names.append(name)
                columns.append({"previous_hash": pa.array(previous), "hash": pa.array(hashes)}.get(name, column))
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return run


def seal_audit(
    df: DataFrame, chain: Sequence[str], order: Sequence[str], genesis: str = fixed.GENESIS_HASH
) -> DataFrame:
    """Fill ``previous_hash`` and ``hash`` along each chain.

    A chain is sequential by definition, so its length is the caller's choice: use a
    key such as source and hour, and seal the chains' ends with :func:`chain_heads`.
    Rows stream through a sorted partition; no chain is held in memory.
    """
    columns = df.columns + [c for c in ("previous_hash", "hash") if c not in df.columns]
    rows = df.withColumn("_head", payload_head())
    rows = rows.withColumns({"previous_hash": F.lit("").cast("string"), "hash": F.lit("").cast("string")})
    rows = rows.select(*columns, "_head").repartition(*chain).sortWithinPartitions(*chain, *order)
    schema = T.StructType([f for f in rows.schema.fields if f.name != "_head"])
    return rows.mapInArrow(_seal_partition(list(chain), genesis), schema)


def chain_heads(df: DataFrame, chain: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Last hash and length of each chain."""
    return df.filter("hash IS NOT NULL").groupBy(*chain).agg(
        F.max_by("hash", F.struct(*order)).alias("latest_hash"), F.count(F.lit(1)).alias("records")
    )


def verify_audit(
    df: DataFrame, chain: Sequence[str], order: Sequence[str], genesis: str = fixed.GENESIS_HASH, block: Column | None = None
) -> DataFrame:
    """Per chain: ``valid``, ``broken_at_index`` and ``error`` of the first failure.

    Every row stores its predecessor's hash, so all rows are checked at once; the link
    test comes before the hash test. Rows without hashes are skipped but counted.
    ``genesis`` is the hash expected before the first row.
    """
    chain, order = list(chain), list(order)
    block = block if block is not None else default_block(df, order[0])
    slim = df.withColumn("_ok_hash", record_hash("previous_hash")).withColumn("_block", block).select(
        *chain, *[c for c in order if c not in chain], "_block", "previous_hash", "hash", "_ok_hash"
    )
    indexed = ordered_rank(slim.withColumnRenamed("_block", "_vb"), chain, order, F.col("_vb"), "_index")
    hashed = indexed.filter("hash IS NOT NULL AND hash != '' AND previous_hash IS NOT NULL AND previous_hash != ''")
    linked = previous_row(hashed, chain, order, F.col("_vb"), {"_before": "hash"})
    expected = F.coalesce("_before", F.lit(genesis))
    at = (F.col("_index") - 1).cast("int")
    error = F.when(
        F.col("previous_hash") != expected,
        F.concat(
            F.lit("Broken link at index "), at, F.lit(": expected previousHash "), expected,
            F.lit(", found "), F.col("previous_hash"),
        ),
    ).when(
        F.col("_ok_hash") != F.col("hash"),
        F.concat(
            F.lit("Tampered hash at index "), at, F.lit(": expected "), F.col("_ok_hash"), F.lit(", found "), F.col("hash")
        ),
    )
    checked = linked.withColumn("_error", error)
    failures = checked.groupBy(*chain).agg(
        F.min(F.when(F.col("_error").isNotNull(), F.struct(at.alias("i"), F.col("_error").alias("e")))).alias("_first"),
        F.count(F.lit(1)).alias("checked"),
    )
    return failures.select(
        *chain,
        F.col("_first").isNull().alias("valid"),
        F.col("_first.i").alias("broken_at_index"),
        F.col("_first.e").alias("error"),
        "checked",
    )


# --- chains of blocks -----------------------------------------------------------

#: Children of a node of the tree over block heads.
TREE_WIDTH = 64


class SealedBlocks(NamedTuple):
    """``rows``: the sealed records; ``heads``: latest hash and length of each block; ``roots``: one hash a chain."""

    rows: DataFrame
    heads: DataFrame
    roots: DataFrame


def seal_blocks(
    df: DataFrame, chain: Sequence[str], order: Sequence[str], block: str, genesis: str = fixed.GENESIS_HASH, width: int = TREE_WIDTH
) -> SealedBlocks:
    """Seal each ``block`` (a column that never decreases along ``order``) of a chain by itself, then all heads
    of a chain under one root.

    Blocks are sealed in parallel, so one day of one source is many tasks; only a narrow row per
    block goes on. Null chains and blocks are values like any other.
    """
    rows = stage(seal_audit(df, [*chain, block], order, genesis))
    heads = stage(chain_heads(rows, [*chain, block], order))
    return SealedBlocks(rows, heads, block_roots(heads, chain, block, width))


def block_roots(heads: DataFrame, chain: Sequence[str], block: str, width: int = TREE_WIDTH) -> DataFrame:
    """``chain root blocks records``: a tree of hashes over a chain's heads in block order.

    A node is the SHA-256 of up to ``width`` children joined by ``|``; a leaf is ``latest_hash:records``. Each level
    is one aggregation whose groups hold ``width`` rows at most, until every chain has one node.
    """
    chain = list(chain)
    number = F.row_number().over(Window.partitionBy(*chain).orderBy(block)) - 1
    leaf = F.concat_ws(":", F.coalesce("latest_hash", F.lit("")), F.col("records").cast("string"))
    nodes = heads.select(*chain, number.alias("_i"), leaf.alias("_h"), F.lit(1).cast("long").alias("blocks"), "records")
    done = None
    while True:
        children = F.array_sort(F.collect_list(F.struct("_i", "_h")))
        nodes = nodes.groupBy(*chain, F.floor(F.col("_i") / width).alias("_up")).agg(
            F.sha2(F.array_join(children["_h"], "|"), 256).alias("_h"), F.sum("blocks").alias("blocks"), F.sum("records").alias("records")
        )
        nodes = stage(nodes.withColumnRenamed("_up", "_i"))
        # a chain whose last node has number 0 is done; others go up a level
        wider = nodes.filter("_i > 0").select(*chain).distinct()
        ready = join_null_safe(nodes, wider, chain, "left_anti")
        done = ready if done is None else done.unionByName(ready)
        nodes = join_null_safe(nodes, wider, chain, "left_semi")
        if nodes.isEmpty():
            return done.select(*chain, F.col("_h").alias("root"), "blocks", "records")


def verify_blocks(
    df: DataFrame, heads: DataFrame, roots: DataFrame, chain: Sequence[str], order: Sequence[str], block: str,
    genesis: str = fixed.GENESIS_HASH, width: int = TREE_WIDTH,
) -> DataFrame:
    """Per chain: ``valid``, ``broken_blocks``, ``first_broken`` and ``error``.

    Records are checked block by block, each block's end and length against its stored head, and the stored
    heads against the root. So a changed record, a cut, missing or added block and a
    changed head are all found, and named by their block; where only the root differs no block is named.
    """
    chain = list(chain)
    keys = [*chain, block]
    checked = verify_audit(df, keys, order, genesis).select(*keys, F.lit(True).alias("_seen"), "valid", "broken_at_index", "error")
    found = join_null_safe(checked, chain_heads(df, keys, order).withColumnsRenamed({"latest_hash": "_hash", "records": "_records"}), keys)
    known = heads.select(*keys, "latest_hash", "records").withColumn("_known", F.lit(True))
    both = join_null_safe(found, known, keys)
    lost = join_null_safe(known, found, keys, "left_anti")
    both = both.unionByName(lost, allowMissingColumns=True)
    name = F.coalesce(F.col(block).cast("string"), F.lit("null"))
    error = (
        F.when(F.col("_seen").isNull(), F.concat(F.lit("Block "), name, F.lit(" is missing")))
        .when(F.col("_known").isNull(), F.concat(F.lit("Block "), name, F.lit(" has no head")))
        .when(~F.col("valid"), F.concat(F.lit("Block "), name, F.lit(": "), F.col("error")))
        .when(
            ~F.col("_hash").eqNullSafe(F.col("latest_hash")) | ~F.col("_records").eqNullSafe(F.col("records")),
            F.concat(F.lit("Block "), name, F.lit(" does not end at its head")),
        )
    )
    told = both.select(*chain, F.col(block).alias("_block"), error.alias("_error"))
    broken = F.col("_error").isNotNull()
    per_chain = told.groupBy(*chain).agg(
        F.count_if(broken).alias("broken_blocks"),
        F.min(F.when(broken, F.struct(F.col("_block").alias("block"), F.col("_error").alias("error")))).alias("_first"),
    )
    again = block_roots(heads, chain, block, width).select(*chain, F.col("root").alias("_root"))
    stored = join_null_safe(per_chain, roots.select(*chain, "root"), chain)
    compared = join_null_safe(stored, again, chain)
    same = F.col("root").eqNullSafe(F.col("_root")) & F.col("root").isNotNull()
    return compared.select(
        *chain, ((F.col("broken_blocks") == 0) & same).alias("valid"), "broken_blocks", F.col("_first.block").alias("first_broken"),
        F.coalesce(F.col("_first.error"), F.when(~same, F.lit("Heads do not give the root"))).alias("error"),
    )


# --- views ---------------------------------------------------------------------


def recent_audit(df: DataFrame, order: Sequence[str], n: int = 500) -> DataFrame:
    """The newest ``n`` records, newest first."""
    return df.orderBy(*[F.col(c).desc() for c in order]).limit(n)


def audit_stats(df: DataFrame, order: Sequence[str]) -> DataFrame:
    """One row: totals, totals per type, and the newest hash.

    A record contributes one row for itself (type null) and one per entity type, so
    a single aggregation gives everything.
    """
    own = F.struct(
        F.lit(None).cast("string").alias("type"), F.lit(1).alias("records"),
        F.col("entities_detected").alias("n"),
    )
    per_type = F.transform(
        F.map_entries(F.coalesce("entity_breakdown", F.create_map().cast("map<string,int>"))),
        lambda e: F.struct(e["key"].alias("type"), F.lit(0).alias("records"), e["value"].alias("n")),
    )
    tip = F.when(F.col("hash").isNotNull(), F.struct(*order))
    rows = df.select("hash", tip.alias("_tip"), F.explode(F.concat(F.array(own), per_type)).alias("p"))
    by_type = rows.groupBy("p.type").agg(
        F.sum("p.records").alias("records"), F.sum("p.n").alias("n"),
        F.max_by("hash", "_tip").alias("hash"),
    )
    return by_type.agg(
        F.coalesce(F.sum("records"), F.lit(0)).alias("total_requests"),
        F.coalesce(F.sum(F.when(F.col("type").isNull(), F.col("n"))), F.lit(0)).alias("total_entities"),
        F.map_from_entries(
            F.array_sort(F.collect_list(F.when(F.col("type").isNotNull(), F.struct("type", "n"))))
        ).alias("type_totals"),
        F.max(F.when(F.col("type").isNull(), F.col("hash"))).alias("latest_hash"),
    )


def summary_line() -> Column:
    """One log line per record, without values."""
    entries = F.map_entries(F.coalesce("entity_breakdown", F.create_map().cast("map<string,int>")))
    listed = F.array_join(F.transform(F.array_sort(entries), lambda e: F.concat(e["key"], F.lit(":"), e["value"])), ", ")
    return F.concat(
        F.lit("[AUDIT] "), F.col("timestamp"),
        F.lit(" | Req: "), F.col("request_id"),
        F.lit(" | Model: "), F.col("model"),
        F.lit(" | Stream: "), F.col("is_streaming").cast("string"),
        F.lit(" | Detected: "), F.col("entities_detected").cast("string"),
        F.lit(" ["), F.when(listed == "", "none").otherwise(listed), F.lit("]"),
        F.coalesce(F.concat(F.lit(" | Policy: "), F.nullif("policy_action", F.lit(""))), F.lit("")),
        F.coalesce(F.concat(F.lit(" | Risk: "), F.col("risk_score").cast("string")), F.lit("")),
        F.lit(" | Process: "), number_text("processing_latency_ms"),
        F.lit("ms | Upstream: "), number_text("upstream_latency_ms"),
        F.lit("ms | Status: "), F.col("status"),
        F.lit(" | Hash: "), F.substring("hash", 1, 12), F.lit("..."),
    )


def to_syslog(app: str = "maskwright", host: str = "localhost", pid: int | str = "-", sd_id: str = "audit@32473") -> Column:
    """RFC 5424 line: severity error for failed requests, informational otherwise."""
    entries = F.map_entries(F.coalesce("entity_breakdown", F.create_map().cast("map<string,int>")))
    listed = F.array_join(F.transform(F.array_sort(entries), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";")
    param = lambda key, value: F.concat(F.lit(f'{key}="'), value, F.lit('"'))
    or_else = lambda col, other: F.coalesce(F.nullif(col, F.lit("")), F.lit(other))
    params = F.concat_ws(
        " ",
        param("model", or_else("model", "unknown")),
        param("entities", F.col("entities_detected").cast("string")),
        param("breakdown", F.when(listed == "", "none").otherwise(listed)),
        param("process_ms", number_text("processing_latency_ms")),
        param("upstream_ms", number_text("upstream_latency_ms")),
        param("streaming", F.col("is_streaming").cast("string")),
        param("status", F.col("status")),
        F.when(F.col("hash") != "", param("hash", F.col("hash"))),
        F.when(F.col("previous_hash") != "", param("prev_hash", F.col("previous_hash"))),
    )
    return F.concat(
        F.when(F.col("status") == "ERROR", "<11>").otherwise("<14>"),
        F.lit("1 "), F.col("timestamp"),
        F.lit(f" {host} {app} {pid} "), or_else("request_id", "-"),
        F.lit(f" [{sd_id} "), params,
        F.lit("] Zero-knowledge audit event for request "), F.col("request_id"),
    )


def siem_payload(source: str = "maskwright", **syslog) -> Column:
    """JSON event for a collector: the record, its syslog line and its time."""
    event = F.struct(*_FIELDS)
    return F.to_json(
        F.struct(
            F.lit(source).alias("source"), event.alias("event"), to_syslog(**syslog).alias("syslog"),
            F.col("timestamp").alias("timestamp"),
        )
    )
