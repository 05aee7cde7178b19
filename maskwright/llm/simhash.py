"""Near duplicates by SimHash: a self-join of a binary trie under a Hamming budget.

Fingerprints are cut into ``budget + 1`` stretches; two within the budget agree on one of
them at least. For each stretch the fingerprints are rotated so that it leads, and
those that share it form a trie of their own. Inside one, pairs of trie nodes are
traversed together from the top bit: children that differ add an error, and a pair
of nodes over the budget is dropped with all that lies below. Links found in a
bucket leave it as a spanning forest, never as all pairs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from maskwright.llm.buckets import Forest, map_buckets, runs
from maskwright.llm.common import free_name, id_and_bytes, map_batches
from maskwright.llm.components import components
from maskwright.sources.staging import stage

WORDS = 4
BUDGET = 4
SEED = 42
BITS = 64
_LEAF = 32
_CHUNK = 1 << 16
_SALTS = 16


def fingerprint(text: bytes | None, words: int = WORDS) -> int:
    """Majority bits of the XXH64 of all word shingles; zero without words."""
    parts = (text or b"").lower().split()  # bytes: A-Z only, and ASCII blanks only
    if not parts:
        return 0
    joined = b" ".join(parts)
    sizes = np.fromiter(map(len, parts), np.int64, len(parts))
    ends = np.cumsum(sizes + 1) - 1
    starts, width = (ends - sizes).tolist(), min(words, len(parts))
    ends, of, total, n = ends[width - 1 :].tolist(), xxhash.xxh64_intdigest, np.zeros(BITS, np.int64), 0
    for at in range(0, len(ends), 1 << 14):  # long texts in stretches
        some = np.fromiter((of(joined[a:b], SEED) for a, b in zip(starts[at : at + (1 << 14)], ends[at : at + (1 << 14)])), np.uint64)
        bits = np.unpackbits(some.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        total += bits.sum(axis=0, dtype=np.int64)
        n += len(some)
    return int.from_bytes(np.packbits(total * 2 > n, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """``doc_id fp`` with the fingerprint as a signed long; a null text is an empty one."""

    def work(batch: pa.RecordBatch) -> dict:
        found = np.array([fingerprint(t, words) for t in batch.column("text").to_pylist()], np.uint64)
        return {"doc_id": batch.column("doc_id"), "fp": found.view(np.int64)}

    return map_batches(id_and_bytes(docs), work, "doc_id long, fp long")


def trie_links(values: np.ndarray, roots: np.ndarray, top: int, budget: int):
    """Index pairs of values within ``budget`` differing bits.

    ``values`` are sorted; ``roots`` bounds runs that agree on all bits above ``top``. A node is
    a range of values that share a prefix. Pairs of nodes wait on a stack in chunks, so
    memory does not follow the number of pairs.
    """
    lo, hi = roots[:-1], roots[1:]
    big = hi - lo > 1
    stack = [(top, lo[big], hi[big], lo[big], hi[big], np.zeros(int(big.sum()), np.int8))]
    while stack:
        bit, al, ah, bl, bh, err = stack.pop()
        small = ((ah - al) * (bh - bl) <= _LEAF) | (bit < 0)
        if small.any():
            yield from _compare(values, al[small], ah[small], bl[small], bh[small], budget)
        al, ah, bl, bh, err = (x[~small] for x in (al, ah, bl, bh, err))
        if not len(al):
            continue
        mid = lambda l, h: np.clip(np.searchsorted(values, (values[l] >> np.uint64(bit) | np.uint64(1)) << np.uint64(bit)), l, h)
        am, bm = mid(al, ah), mid(bl, bh)
        own = al == bl
        parts = [(al, am, bl, bm, err), (am, ah, bm, bh, err), (al, am, bm, bh, err + 1)]
        rest = ~own
        parts.append(tuple(x[rest] for x in (am, ah, bl, bm, err + 1)))
        al, ah, bl, bh, err = (np.concatenate(x) for x in zip(*parts))
        keep = (ah > al) & (bh > bl) & (err <= budget) & ~((al == bl) & (ah - al == 1))
        al, ah, bl, bh, err = (x[keep] for x in (al, ah, bl, bh, err))
        for at in range(0, len(al), _CHUNK):
            stack.append((bit - 1, *(x[at : at + _CHUNK] for x in (al, ah, bl, bh, err))))


def _compare(values, al, ah, bl, bh, budget):
    """Verify all value pairs of small node pairs."""
    wide, size = bh - bl, (ah - al) * (bh - bl)
    for at in range(0, len(size), _CHUNK):
        s = slice(at, at + _CHUNK)
        pair = np.repeat(np.arange(len(size[s])), size[s])
        nth = np.arange(len(pair)) - np.repeat(np.cumsum(size[s]) - size[s], size[s])
        i, j = al[s][pair] + nth // wide[s][pair], bl[s][pair] + nth % wide[s][pair]
        near = (i < j) if len(i) else np.zeros(0, bool)
        i, j = i[near], j[near]
        ok = np.bitwise_count(values[i] ^ values[j]) <= budget
        yield i[ok], j[ok]


def links(classes: DataFrame, budget: int = BUDGET) -> DataFrame:
    """Edges ``a b`` that join all fingerprint classes (``fp rep``) within ``budget`` bits.

    ``budget + 1`` rotations are the only copies made; a bucket holds the different
    fingerprints that share a stretch, sixteen bytes each.
    """
    count = budget + 1
    widths = [BITS // count + (i < BITS % count) for i in range(count)]
    turned = []
    for i, width in enumerate(widths):
        before = sum(widths[:i])
        fp = F.col("fp")
        value = F.shiftleft(fp, before).bitwiseOR(F.shiftrightunsigned(fp, BITS - before)) if before else fp
        turned.append(F.struct(F.lit(i).alias("turn"), F.shiftrightunsigned(value, BITS - width).alias("lead"), value.alias("value")))
    rows = classes.select("rep", F.explode(F.array(*turned)).alias("t")).select("t.*", "rep")

    def work(table: pa.Table) -> dict | None:
        turn, lead, rep = (table.column(c).to_numpy() for c in ("turn", "lead", "rep"))
        value = table.column("value").to_numpy().view(np.uint64)
        out_a, out_b = [], []
        for i in np.unique(turn):
            mine = np.flatnonzero(turn == i)
            mine = mine[np.lexsort((value[mine],))]
            reps, forest = rep[mine], Forest(len(mine))
            # links go by index; order by rep so that a root is the least rep
            order = np.argsort(reps, kind="stable")
            rank = np.empty_like(order)
            rank[order] = np.arange(len(order))
            for a, b in trie_links(value[mine], runs(lead[mine]), BITS - 1 - widths[i], budget):
                forest.link(rank[a], rank[b])
            joined = np.flatnonzero(forest.up != np.arange(len(mine)))
            out_a.append(reps[order][joined])
            out_b.append(reps[order][forest.up[joined]])
        return {"a": np.concatenate(out_a), "b": np.concatenate(out_b)}

    return map_buckets(rows, ["turn", "lead"], work, "a long, b long")


def fingerprint_column(text: Column, words: int = WORDS) -> Column:
    """The fingerprint as a signed long, next to a row's other columns."""

    @F.arrow_udf("long")
    def prints(column: pa.Array) -> pa.Array:
        return pa.array(np.array([fingerprint(t.as_py(), words) for t in column], np.uint64).view(np.int64), pa.int64())

    return prints(text.cast("string").cast("binary"))


def _groups(prints: DataFrame, budget: int) -> DataFrame:
    """``fp root component_id`` per fingerprint: the least fingerprint and the least doc_id of its component."""
    classes = stage(prints.groupBy("fp").agg(F.min("doc_id").alias("least")))
    # one id for several texts (repeated rows, edited copies under one id) joins their classes
    several = prints.filter(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("fp").alias("x"), F.max("fp").alias("y")).filter("x < y")
    edges = links(classes.select("fp", F.col("fp").alias("rep")), budget)
    shared = prints.join(several, "doc_id").select(F.col("x").alias("a"), F.col("fp").alias("b"))
    found = components(edges.unionAll(shared))
    named = stage(classes.join(found, classes["fp"] == found["vertex"], "left").select("fp", "least", "component"))
    alone = named.filter(F.col("component").isNull()).select("fp", F.col("fp").alias("root"), F.col("least").alias("component_id"))
    # a component with a large share of all fingerprints is looked up in several tasks
    salted = named.withColumn("salt", F.pmod(F.xxhash64("fp"), F.lit(_SALTS)).cast("int")).drop("least")
    least = named.filter(F.col("component").isNotNull()).groupBy("component").agg(F.min("least").alias("component_id"))
    least = least.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(_SALTS - 1))))
    return alone.unionAll(salted.join(least, ["component", "salt"]).select("fp", F.col("component").alias("root"), "component_id"))


def near_duplicates(docs: DataFrame, words: int = WORDS, budget: int = BUDGET) -> DataFrame:
    """``doc_id fingerprint component_id`` for every row.

    Fingerprints that differ in at most ``budget`` bits link; ``component_id`` is the least doc_id
    reachable, a document's own included. Equal fingerprints are one class before the
    join, so copies cost one row. Texts without words have fingerprint zero and link like
    any other. Rows with a null doc_id link like any other but never name a component: if
    it has no id, ``component_id`` is null. Repeated rows stay repeated.
    """
    prints = stage(fingerprints(docs, words))
    named = _groups(prints, budget)
    return prints.join(named, "fp", "left").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def deduplicate(docs: DataFrame, words: int = WORDS, budget: int = BUDGET) -> DataFrame:
    """One document of each group of near duplicates, the one with the least id, with all its columns.

    Of repeated rows of that id one stays. Where a whole group has no id, one row of its
    least fingerprint stays.
    """
    prints = stage(fingerprints(docs, words))
    groups = stage(_groups(prints, budget))
    keep = groups.filter(F.col("component_id").isNotNull()).select(F.col("component_id").alias("_kept")).distinct()
    rows = docs.join(keep, docs["doc_id"].cast("long") == keep["_kept"], "left_semi")
    rows = rows.dropDuplicates(["doc_id", "text"])
    # a row without an id is told by its fingerprint
    name = free_name(docs, "_fp")
    nameless = groups.filter(F.col("component_id").isNull() & (F.col("fp") == F.col("root"))).select(F.col("fp").alias(name))
    unnamed = docs.filter(docs["doc_id"].cast("long").isNull()).withColumn(name, fingerprint_column(F.col("text"), words))
    return rows.unionAll(unnamed.join(nameless, name, "left_semi").dropDuplicates([name]).drop(name))
