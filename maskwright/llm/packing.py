"""Packing of documents into sequences by minimum bin slack.

A packing depends on the pieces' lengths alone, and there are at most ``capacity``
different lengths whatever the corpus size. So the search runs on the histogram of
lengths: the longest length left opens a sequence, a subset-sum bitset over the
lengths still available finds the fullest combination for the room that is left, and
that combination is taken out as often as the counts allow before the next search.
Pieces are then numbered within their length and look up their place by number.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from maskwright.llm.common import dense_number, id_and_bytes, map_batches, texts
from maskwright.llm.tokens import WordEncoder, default_tokenizer
from maskwright.sources.staging import stage

CAPACITY = 4096
END_ID = 1


def fullest(lengths: list[tuple[int, int]], room: int) -> list[tuple[int, int]]:
    """The (length, copies) whose sum comes closest to ``room`` from below.

    Bit s of ``reach`` says that some choice sums to s. Copies of a length enter as
    powers of two; the search ends early once ``room`` itself is reached.
    """
    full, reach, layers = (1 << (room + 1)) - 1, 1, []
    for length, count in lengths:
        if length > room:
            continue
        copies = min(count, room // length)
        layers.append((length, copies, reach))
        step = 1
        while copies > 0:
            reach |= (reach << (length * min(step, copies))) & full
            copies -= step
            step *= 2
        if reach >> room & 1:
            break
    left, chosen = reach.bit_length() - 1, []
    for length, copies, before in reversed(layers):
        for used in range(copies + 1):
            if left >= used * length and before >> (left - used * length) & 1:
                if used:
                    chosen.append((length, used))
                left -= used * length
                break
    return chosen


def plan(histogram: Iterable[tuple[int, int]], capacity: int = CAPACITY) -> dict[str, np.ndarray]:
    """Place all lengths of a histogram.

    Returns parallel arrays, sorted by (length, rank): from number ``rank`` on, pieces of
    ``length`` go ``copies`` to a sequence, the first into ``sequence`` at ``offset``.
    """
    left = {int(n): int(c) for n, c in histogram if n > 0 and c > 0}
    order = sorted(left, reverse=True)
    ranks, rows, sequence = dict.fromkeys(left, 0), [], 0
    while order:
        largest = order[0]
        left[largest] -= 1
        rest = fullest([(n, left[n]) for n in order if left[n]], capacity - largest)
        left[largest] += 1
        take = dict(rest)
        take[largest] = take.get(largest, 0) + 1
        times = min(left[n] // c for n, c in take.items())
        offset = 0
        for n, c in sorted(take.items(), reverse=True):
            rows.append((n, ranks[n], c, sequence, offset))
            ranks[n] += times * c
            left[n] -= times * c
            offset += n * c
        sequence += times
        order = [n for n in order if left[n]]
    rows.sort()
    names = ("length", "rank", "copies", "sequence", "offset")
    columns = np.array(rows, np.int64).reshape(-1, 5).T
    return dict(zip(names, columns, strict=True))


def cut_documents(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """One row per piece: ``doc_id piece start length ids``.

    Each row's text (null: empty) is encoded whole and ends with id 1; only documents
    longer than ``capacity`` are cut. An empty text is a piece of length 1; repeated
    rows are documents of their own; other columns are ignored.
    """
    path = tokenizer or default_tokenizer()
    state: list[WordEncoder] = []

    def work(batch: pa.RecordBatch) -> dict:
        if not state:
            state.append(WordEncoder.shared(path))
        out: dict[str, list] = {k: [] for k in ("doc_id", "piece", "start", "length", "ids")}
        for doc, found in zip(batch.column("doc_id").to_pylist(), state[0].ids(texts(batch.column("text")))):
            ids = np.append(found, np.uint32(END_ID)).astype("<u4")
            for piece, start in enumerate(range(0, len(ids), capacity)):
                part = ids[start : start + capacity]
                for k, v in zip(out, (doc, piece, start, len(part), part.tobytes())):
                    out[k].append(v)
        return out

    return map_batches(id_and_bytes(docs), work, "doc_id long, piece int, start long, length long, ids binary")


def with_crc(pieces: DataFrame) -> DataFrame:
    """The digest of each piece in place of its ids."""
    return pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids")


def place(pieces: DataFrame, key: list[str], capacity: int = CAPACITY) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to rows with a ``length`` from 1 to ``capacity``.

    ``pieces`` is read twice: give a written table. Only the histogram (``capacity`` rows
    at most) reaches the driver, and the plan made from it is bounded in the same way.
    """
    counts = pieces.groupBy("length").count().collect()
    spots = plan([(r["length"], r["count"]) for r in counts], capacity)
    lookup = spots["length"] * (1 << 40) + spots["rank"]
    numbered, columns = dense_number(pieces, ["length"], key, "_number"), pieces.columns

    def work(batch: pa.RecordBatch) -> dict:
        column = lambda name: batch.column(name).to_numpy(zero_copy_only=False)
        length, number = column("length").astype(np.int64), column("_number").astype(np.int64)
        i = np.searchsorted(lookup, length * (1 << 40) + number, side="right") - 1
        bin_, nth = np.divmod(number - spots["rank"][i], spots["copies"][i])
        out = {c: batch.column(c) for c in columns}
        return out | {"sequence_id": spots["sequence"][i] + bin_, "offset": spots["offset"][i] + nth * length}

    schema = ", ".join(f"`{n}` {t}" for n, t in pieces.dtypes) + ", sequence_id long, offset long"
    return map_batches(numbered, work, schema, rows=10_000)


def pack_documents(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """Pieces with their digest and place: ``doc_id piece start length ids_crc32 sequence_id offset``.

    Null ids and repeated rows are documents like any other; an empty table gives no rows.
    """
    pieces = stage(with_crc(cut_documents(docs, tokenizer, capacity)))
    return place(pieces, ["doc_id", "piece"], capacity)


def sequences(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """The packed sequences themselves: ``sequence_id length ids`` (little-endian 32-bit ids).

    A sequence gathers ``capacity`` ids at most.
    """
    placed = place(stage(cut_documents(docs, tokenizer, capacity)), ["doc_id", "piece"], capacity)
    parts = placed.groupBy("sequence_id").agg(
        F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("parts"), F.sum("length").alias("length")
    )
    joined = F.aggregate("parts", F.lit(b""), lambda done, p: F.concat(done, p["ids"]))
    return parts.select("sequence_id", "length", joined.alias("ids"))
