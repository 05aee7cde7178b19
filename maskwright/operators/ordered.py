"""Ordered computations per key that survive a key with a third of all rows.

A plain window over such a key is one task. Here a key's rows are cut into blocks
that follow the order (hours of a timestamp, ranges of a number). Each block is
its own window partition; one summary row per block carries what the next block
needs; only the summaries meet in a window per key.

``block`` must never decrease along ``order``.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def micros(ts) -> Column:
    ts = F.col(ts) if isinstance(ts, str) else ts
    return F.unix_micros(ts.cast("timestamp"))


def time_block(ts, seconds: int = 3600) -> Column:
    return F.floor(micros(ts) / F.lit(seconds * 1_000_000)).cast("bigint")


def default_block(df: DataFrame, column: str, span: int = 4096) -> Column:
    """Hours for time columns, ranges for integers, one block for anything else."""
    kind = df.schema[column].dataType
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return time_block(F.col(column))
    if isinstance(kind, T.IntegralType):
        return F.floor(F.col(column) / F.lit(span)).cast("bigint")
    return F.lit(0).cast("bigint")


def _join_blocks(rows: DataFrame, blocks: DataFrame, keys: Sequence[str]) -> DataFrame:
    renamed = blocks.select(*[F.col(k).alias(f"_b_{k}") for k in keys], *[c for c in blocks.columns if c not in keys])
    cond = F.lit(True)
    for k in keys:
        cond = cond & F.col(k).eqNullSafe(F.col(f"_b_{k}"))
    return rows.join(renamed, cond, "left").drop(*[f"_b_{k}" for k in keys])


def ordered_rank(
    df: DataFrame, group: Sequence[str], order: Sequence, block: Column, out: str = "rank"
) -> DataFrame:
    """``row_number`` per group without a window over a whole group."""
    keys = [*group, "_block"]
    rows = df.withColumn("_block", block)
    sizes = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    ahead = Window.partitionBy(*group).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(*keys, F.coalesce(F.sum("_n").over(ahead), F.lit(0)).alias("_before"))
    local = rows.withColumn("_local", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    ranked = _join_blocks(local, offsets, keys)
    return ranked.withColumn(out, (F.col("_local") + F.col("_before")).cast("bigint")).drop(
        "_local", "_before", "_block"
    )


def previous_row(
    df: DataFrame, group: Sequence[str], order: Sequence[str], block: Column, values: Mapping[str, str]
) -> DataFrame:
    """``lag`` per group: ``values`` maps new columns to the columns they look back at."""
    keys = [*group, "_block"]
    rows = df.withColumn("_block", block).withColumn(
        "_now", F.struct(*[F.col(c).alias(f"v{i}") for i, c in enumerate(values.values())])
    )
    last = rows.groupBy(*keys).agg(F.max_by("_now", F.struct(*order)).alias("_last"))
    carried = last.select(
        *keys, F.lag("_last").over(Window.partitionBy(*group).orderBy("_block")).alias("_carried")
    )
    inside = Window.partitionBy(*keys).orderBy(*order)
    local = rows.withColumn("_local", F.lag("_now").over(inside)).drop("_now")
    joined = _join_blocks(local, carried, keys)
    prev = F.coalesce(F.col("_local"), F.col("_carried"))
    return joined.select(
        *[c for c in df.columns], *[prev[f"v{i}"].alias(name) for i, name in enumerate(values)]
    )


def number_islands(
    df: DataFrame,
    group: Sequence[str],
    order: Sequence[str],
    block: Column,
    carry: Sequence[str],
    breaks: Callable[[Column], Column],
    island: str = "island",
    position: str = "position",
) -> DataFrame:
    """Number runs of rows per group and the rows inside each run, both from 1.

    A row opens a run if it is the group's first or ``breaks(previous)`` holds, with
    ``previous`` the struct of the ``carry`` columns of the row before it.
    """
    keys = [*group, "_block"]
    now = F.struct(*[F.col(c) for c in carry])
    inside = Window.partitionBy(*keys).orderBy(*order)
    so_far = inside.rowsBetween(Window.unboundedPreceding, 0)
    rows = (
        df.withColumn("_block", block)
        .withColumn("_now", now)
        .withColumn("_prev", F.lag("_now").over(inside))
        .withColumn("_rn", F.row_number().over(inside))
    )
    opens = F.col("_prev").isNotNull() & F.coalesce(breaks(F.col("_prev")), F.lit(False))
    rows = rows.withColumn("_open", opens)
    blocks = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_n"),
        F.count_if("_open").alias("_opened"),
        F.max(F.when(F.col("_open"), F.col("_rn"))).alias("_last_open"),
        F.max_by("_now", "_rn").alias("_last_row"),
        F.min_by("_now", "_rn").alias("_first_row"),
    )
    per_group = Window.partitionBy(*group).orderBy("_block")
    ahead = per_group.rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("_prev_row", F.lag("_last_row").over(per_group))
    # ``breaks`` reads the current row's columns; on a summary those are the first row's.
    blocks = blocks.select(
        *keys, "_n", "_opened", "_last_open", "_prev_row", *[F.col(f"_first_row.{c}").alias(c) for c in carry if c not in keys]
    ).withColumn(
        "_starts", F.col("_prev_row").isNull() | F.coalesce(breaks(F.col("_prev_row")), F.lit(False))
    )
    blocks = blocks.withColumn("_before", F.coalesce(F.sum("_n").over(ahead), F.lit(0)))
    blocks = blocks.withColumn(
        "_islands_before", F.coalesce(F.sum(F.col("_opened") + F.col("_starts").cast("int")).over(ahead), F.lit(0))
    ).withColumn(
        "_opened_at",
        F.coalesce(
            F.col("_before") + F.col("_last_open"), F.when(F.col("_starts"), F.col("_before") + 1)
        ),
    )
    blocks = blocks.withColumn("_carried_open", F.max("_opened_at").over(ahead)).select(
        *keys, "_before", "_starts", "_islands_before", "_carried_open"
    )
    local = (
        rows.withColumn("_local_islands", F.sum(F.col("_open").cast("int")).over(so_far))
        .withColumn("_local_open", F.max(F.when(F.col("_open"), F.col("_rn"))).over(so_far))
        .drop("_now", "_prev", "_open")
    )
    joined = _join_blocks(local, blocks, keys)
    opened_at = F.coalesce(
        F.col("_before") + F.col("_local_open"),
        F.when(F.col("_starts"), F.col("_before") + 1),
        F.col("_carried_open"),
    )
    return joined.select(
        *df.columns,
        (F.col("_islands_before") + F.col("_starts").cast("int") + F.col("_local_islands"))
        .cast("bigint")
        .alias(island),
        (F.col("_before") + F.col("_rn") - opened_at + 1).cast("bigint").alias(position),
    )


def sliding_totals(
    df: DataFrame,
    group: Sequence[str],
    ts: str,
    seconds: int,
    totals: Mapping[str, Column],
    block_seconds: int = 3600,
) -> DataFrame:
    """Sums over the trailing ``seconds`` (both ends included) per group.

    One shuffle: a row also visits the next block if it can still be inside a
    window that begins there, and is dropped from that block's result.
    """
    return _sliding(df, group, ts, -seconds * 1_000_000, 0, {k: F.sum(v) for k, v in totals.items()}, block_seconds)


def trailing_latest(
    df: DataFrame, group: Sequence[str], ts: str, millis: int, when: Column, out: str, block_seconds: int = 3600
) -> DataFrame:
    """Microseconds of the group's latest row for which ``when`` holds, less than ``millis`` before this one and
    not at its own moment; else null."""
    latest = F.max(F.when(when, micros(ts)))
    return _sliding(df, group, ts, 1 - millis * 1000, -1, {out: latest}, block_seconds)


def _sliding(
    df: DataFrame, group: Sequence[str], ts: str, first: int, last: int, totals: Mapping[str, Column], block_seconds: int
) -> DataFrame:
    width, step = -first, block_seconds * 1_000_000
    if width > step:
        raise ValueError("a block must be at least as long as the window")
    at = micros(ts)
    home = F.floor(at / F.lit(step)).cast("bigint")
    rows = df.withColumns({"_at": at, "_home": home})
    near_end = (F.col("_home") + 1) * step - F.col("_at") <= width
    rows = rows.withColumn(
        "_block",
        F.explode(F.when(near_end, F.array("_home", F.col("_home") + 1)).otherwise(F.array("_home"))),
    )
    window = Window.partitionBy(*group, "_block").orderBy("_at").rangeBetween(first, last)
    summed = rows.select(
        *df.columns, "_home", "_block",
        *[total.over(window).alias(name) for name, total in totals.items()],
    )
    return summed.filter(F.col("_home") == F.col("_block")).drop("_home", "_block")
