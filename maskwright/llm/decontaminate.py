"""Benchmark decontamination with DataFrame functions only.

Windows of benchmark words become a hash set that is broadcast; each window of
a document's words is hashed in generated code and looked up; hits are verified word
by word. A benchmark above ``BROADCAST_WINDOWS`` windows is cut by hash into parts below
it, each with a scan of its own, so what is broadcast stays bounded: a window is at most 13 words,
its hash and a key of 32 bytes. Which items hold a window is joined to the hits afterwards.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from maskwright.sources.staging import stage

WINDOW = 13
SHARE = 20
BROADCAST_WINDOWS = 1_000_000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_CASED_BETWEEN = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"


def words(text: Column) -> Column:
    """Lower-cased words; null has none. Only A-Z change case, so texts beyond ASCII take ``translate``."""
    plain = F.octet_length(text) == F.char_length(text)
    lowered = F.when(plain, F.lower(text)).otherwise(F.translate(text, _UPPER, _LOWER))
    return F.array_remove(F.split(F.coalesce(lowered, F.lit("")), _BETWEEN), "")


def _hash(parts: Column, start: Column, length: int) -> Column:
    return F.xxhash64(F.lit(length), *[F.get(parts, start + i) for i in range(length)])


def windows(benchmark: DataFrame, size: int = WINDOW) -> tuple[DataFrame, DataFrame]:
    """Each different window once, ``length hash window key``, and ``key item`` of the items that hold it.

    A null id is no item, but its text has windows like any other; a null text has none. ``key`` is
    SHA-256 of the window's words. A window that all items share stays one narrow row.
    """
    items = benchmark.select(F.col("item_id").cast("string").alias("item"), words(F.col("text").cast("string")).alias("ws"))
    items = items.withColumn("length", F.least(F.size("ws"), F.lit(size))).filter("length > 0")
    starts = items.select("item", "ws", "length", F.explode(F.sequence(F.lit(0), F.size("ws") - F.col("length"))).alias("at"))
    rows = starts.select("item", "length", F.slice("ws", F.col("at") + 1, F.col("length")).alias("window"))
    rows = stage(rows.withColumn("key", F.unhex(F.sha2(F.array_join("window", " "), 256))).distinct())
    by_length = F.coalesce(*[F.when(F.col("length") == k, _hash(F.col("window"), F.lit(0), k)) for k in range(1, size + 1)])
    known = rows.select("length", "window", "key").distinct().withColumn("hash", by_length)
    return known, rows.filter(F.col("item").isNotNull()).select("key", "item")


def _keyed(docs: DataFrame) -> DataFrame:
    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("mark"), words(text).alias("ws"))


def hits(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW, most: int = BROADCAST_WINDOWS) -> DataFrame:
    """Verified occurrences ``doc_id mark at length key`` of windows; ``mark`` tells apart texts under one id."""
    return _find(docs, windows(benchmark, size)[0], size, most)


def _find(docs: DataFrame, known: DataFrame, size: int, most: int = BROADCAST_WINDOWS) -> DataFrame:
    known = stage(known)
    counts = {r["length"]: r["count"] for r in known.groupBy("length").count().collect()}  # at most ``size`` rows
    parts = max(1, -(-sum(counts.values()) // most))
    lengths = sorted(counts) or [size]
    at = _keyed(docs).select("doc_id", "mark", "ws", F.posexplode("ws").alias("at", "_w"))
    if len(lengths) == 1:
        sought = at.withColumn("length", F.lit(lengths[0])).filter(F.col("at") + F.col("length") <= F.size("ws"))
        sought = sought.withColumn("hash", _hash(F.col("ws"), F.col("at"), lengths[0]))
    else:
        each = F.array(*[F.struct(F.lit(k).alias("length"), _hash(F.col("ws"), F.col("at"), k).alias("hash")) for k in lengths])
        sought = at.select("doc_id", "mark", "ws", "at", F.inline(each)).filter(F.col("at") + F.col("length") <= F.size("ws"))
    found = None
    for part in range(parts):
        some = known.filter(F.pmod("hash", F.lit(parts)) == part).select(
            F.col("hash").alias("_hash"), F.col("length").alias("_length"), "window", "key"
        )
        same = F.slice("ws", F.col("at") + 1, F.col("length")) == F.col("window")
        on = (F.col("hash") == F.col("_hash")) & (F.col("length") == F.col("_length")) & same
        got = sought.join(F.broadcast(some), on).select("doc_id", "mark", "at", "length", "key")
        found = got if found is None else found.unionAll(got)
    return found


def contamination(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW, share: int = SHARE) -> DataFrame:
    """``doc_id n_words n_hit n_items items_sha256 contaminated`` for every row.

    A word inside any occurrence of a benchmark window is hit; a document is contaminated
    if hit words are one in ``share`` or more. Null and empty texts have no words; repeated
    rows get equal results; rows with a null doc_id are judged by their text; an empty
    benchmark hits nothing. Items without an id hit words, but are not counted or named. Other
    columns are ignored.
    """
    known, holders = windows(benchmark, size)
    found = stage(_find(docs, known, size))
    key = ["doc_id", "mark"]
    before = Window.partitionBy(*key).orderBy("at", "length").rowsBetween(Window.unboundedPreceding, -1)
    end = F.col("at") + F.col("length")
    fresh = found.select(*key, "at", "length").distinct().withColumn("_seen", F.coalesce(F.max(end).over(before), F.lit(0)))
    covered = fresh.groupBy(*key).agg(F.sum(F.greatest(F.lit(0), end - F.greatest("_seen", "at"))).alias("n_hit"))
    held = found.select(*key, F.col("key")).distinct().join(holders, "key")
    items = held.groupBy(*key).agg(F.array_sort(F.collect_set("item")).alias("items"))
    counts = _keyed(docs).select(*key, F.size("ws").cast("long").alias("n_words"))
    summary = covered.join(items, [covered[k].eqNullSafe(items[k]) for k in key], "left").select(
        covered["doc_id"].alias("_id"), covered["mark"].alias("_mark"), "n_hit", "items"
    )
    joined = counts.join(summary, counts["doc_id"].eqNullSafe(F.col("_id")) & (counts["mark"] == F.col("_mark")), "left")
    n_hit, listed = F.coalesce("n_hit", F.lit(0)).cast("long"), F.coalesce("items", F.array().cast("array<string>"))
    return joined.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size(listed).cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", listed), 256).alias("items_sha256"),
        ((n_hit > 0) & (n_hit * share >= F.col("n_words"))).alias("contaminated"), "mark",
    )


def remove_documents(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW, share: int = SHARE) -> DataFrame:
    """The rows that are not contaminated, unchanged."""
    bad = contamination(docs, benchmark, size, share).filter("contaminated")
    bad = bad.select(F.col("doc_id").alias("_bad_id"), F.col("mark").alias("_bad_mark")).distinct()
    same = docs["doc_id"].cast("long").eqNullSafe(bad["_bad_id"]) & (F.xxhash64(docs["text"].cast("string")) == bad["_bad_mark"])
    return docs.join(bad, same, "left_anti")


def remove_spans(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW) -> DataFrame:
    """``doc_id text`` with hit words and the characters before each cut out; other rows unchanged."""
    found = hits(docs, benchmark, size).groupBy("doc_id", "mark").agg(F.collect_set(F.struct("at", "length")).alias("_hits"))
    found = found.select(F.col("doc_id").alias("_id"), F.col("mark").alias("_mark"), "_hits")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = rows.join(found, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.xxhash64("text") == F.col("_mark")), "left")
    pieces = F.regexp_extract_all("text", F.lit(f"({_CASED_BETWEEN}*{_CASED_BETWEEN.replace('[', '[^', 1)}+)"), F.lit(1))
    gone = F.flatten(F.transform("_hits", lambda h: F.sequence(h["at"], h["at"] + h["length"] - 1)))
    keep = F.array_except(F.sequence(F.lit(0), F.size(pieces) - 1), gone)
    cut = F.concat(F.concat_ws("", F.transform(keep, lambda i: F.get(pieces, i))), F.regexp_extract("text", f"({_CASED_BETWEEN}*)$", 1))
    return rows.select("doc_id", F.when(F.col("_hits").isNotNull(), cut).otherwise(F.col("text")).alias("text"))
