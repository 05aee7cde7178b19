"""Token ids as directly addressable codes.

An id is cut into chunks of eight bits, lowest first. Level 0 holds the first chunk of
every id; a bit per entry says whether the id goes on in the next level, which holds
only the ids that do. A rank directory counts those bits every 512 entries, so the
place of an id's next chunk is a lookup and a count over at most 64 bytes: any id is
read without decoding a block.

A store is a Parquet table of segments in ascending document order. A segment holds
whole documents, so its size is the target or the longest document.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from maskwright.llm.common import _arrow_schema, id_and_bytes, map_batches, texts
from maskwright.llm.tokens import WordEncoder, default_tokenizer

END_ID = 1
RANK_BITS = 512
SEGMENT_TOKENS = 1 << 18
SEGMENT = (
    "part int, first_token long, n_tokens long, doc_ids array<long>, starts array<long>, "
    "levels array<struct<chunks: binary, more: binary, ranks: binary>>"
)


def encode(ids: np.ndarray) -> list[dict[str, bytes]]:
    """Levels of chunks, continuation bits and rank directories."""
    rest, levels = np.asarray(ids, np.uint32), []
    while True:
        goes_on = rest >= 256
        more = np.packbits(goes_on, bitorder="little")
        more = np.concatenate([more, np.zeros(-len(more) % (RANK_BITS // 8), np.uint8)])
        in_block = np.bitwise_count(more).reshape(-1, RANK_BITS // 8).sum(axis=1, dtype=np.uint64)
        ranks = np.concatenate([[0], np.cumsum(in_block)]).astype("<u8")
        levels.append({"chunks": (rest & 255).astype(np.uint8).tobytes(), "more": more.tobytes(), "ranks": ranks.tobytes()})
        if not goes_on.any():
            return levels
        rest = rest[goes_on] >> np.uint32(8)


def _rank(level: dict[str, bytes], i: int) -> int:
    """How many of the first ``i`` entries go on."""
    block = i // RANK_BITS
    bits = np.frombuffer(level["more"], np.uint8)[block * (RANK_BITS // 8) : i // 8 + 1]
    count = int(np.frombuffer(level["ranks"], "<u8")[block])
    if i % RANK_BITS == 0:
        return count
    tail = int(bits[-1]) & ((1 << (i % 8)) - 1)
    return count + int(np.bitwise_count(bits[:-1]).sum()) + tail.bit_count()


def access(levels: list[dict[str, bytes]], i: int) -> int:
    """The ``i``-th id."""
    value, shift = 0, 0
    for level in levels:
        value |= level["chunks"][i] << shift
        if not level["more"][i // 8] >> (i % 8) & 1:
            break
        i, shift = _rank(level, i), shift + 8
    return value


def read_range(levels: list[dict[str, bytes]], start: int, end: int) -> np.ndarray:
    """Ids ``start`` to ``end``: each level's share of a range is a range again."""
    out = np.zeros(end - start, np.uint32)
    where = np.arange(end - start)
    for depth, level in enumerate(levels):
        out[where] |= np.frombuffer(level["chunks"], np.uint8)[start:end].astype(np.uint32) << np.uint32(8 * depth)
        bits = np.unpackbits(np.frombuffer(level["more"], np.uint8)[start // 8 : (end + 7) // 8], bitorder="little")
        on = bits[start % 8 : start % 8 + end - start].astype(bool)
        where = where[on]
        if not len(where):
            break
        start = _rank(level, start)
        end = start + len(where)
    return out


def write_store(docs: DataFrame, path: str, tokenizer: str | None = None, segment: int = SEGMENT_TOKENS) -> None:
    """Write the ids of all documents, in ascending ``doc_id`` order, to ``path``.

    Null texts are empty, every document ends with id 1, null ids come first, repeated
    rows follow each other. Range partitions follow the order; inside one, segments are
    cut as the rows stream by.
    """
    tokenizer = tokenizer or default_tokenizer()
    arrow = _arrow_schema(docs.sparkSession, SEGMENT)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, encoder = TaskContext.get().partitionId(), WordEncoder.shared(tokenizer)
        first, held, doc_ids, starts, size = 0, [], [], [], 0

        def close() -> pa.RecordBatch:
            row = {"part": part, "first_token": first, "n_tokens": size, "doc_ids": doc_ids, "starts": starts}
            return pa.RecordBatch.from_pylist([row | {"levels": encode(np.concatenate(held))}], schema=arrow)

        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                some = batch.slice(at, 256)
                for doc, ids in zip(some.column("doc_id").to_pylist(), encoder.ids(texts(some.column("text")))):
                    doc_ids.append(doc)
                    starts.append(size)
                    held += [ids, np.array([END_ID], np.uint32)]
                    size += len(ids) + 1
                    if size >= segment:
                        yield close()
                        first, held, doc_ids, starts, size = first + size, [], [], [], 0
        if doc_ids:
            yield close()

    ordered = id_and_bytes(docs).repartitionByRange(F.col("doc_id").asc_nulls_first())
    ordered = ordered.sortWithinPartitions(F.col("doc_id").asc_nulls_first())
    ordered.mapInArrow(run, SEGMENT).write.parquet(path)


def _bases(segments: DataFrame) -> DataFrame:
    """``_part _base``: the ids before each write task's, one narrow row per task."""
    ahead = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = segments.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    return parts.select(F.col("part").alias("_part"), F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("_base"))


def token_at(spark: SparkSession, path: str, i: int) -> int:
    """The ``i``-th id of a store, counted from 0 over all documents.

    The segment is found from the narrow columns; then one row is read, by filters that reach the Parquet
    row groups, and the id by its rank directories, without decoding its neighbours. (Parquet itself unpacks the pages
    of that row.) Raises IndexError beyond the last id.
    """
    segments = spark.read.parquet(path)
    first = F.col("first_token") + F.col("_base")
    found = segments.select("part", "first_token", "n_tokens").join(F.broadcast(_bases(segments)), F.col("part") == F.col("_part"))
    home = found.filter((first <= i) & (first + F.col("n_tokens") > i)).select("part", "first_token", first.alias("first")).first() if i >= 0 else None
    if home is None:
        raise IndexError(f"no token {i}")
    row = segments.filter((F.col("part") == home["part"]) & (F.col("first_token") == home["first_token"])).select("levels").first()
    return access([level.asDict() for level in row["levels"]], i - home["first"])


def _read(spark: SparkSession, path: str, kind: str, value: Callable[[bytes], object]) -> DataFrame:
    """``doc_id start n_tokens value`` of every document; ``start`` counts all ids before it.

    The ids of the write tasks before one are summed over one narrow row per task, at most
    as many as the writing session's shuffle partitions, which is what is broadcast.
    """
    segments = spark.read.parquet(path)
    bases = _bases(segments)

    def work(batch: pa.RecordBatch) -> dict:
        out: dict[str, list] = {k: [] for k in ("doc_id", "part", "start", "n_tokens", "value")}
        for row in batch.to_pylist():
            ends = [*row["starts"][1:], row["n_tokens"]]
            ids = memoryview(read_range(row["levels"], 0, row["n_tokens"]).astype("<u4").tobytes())
            for doc, start, end in zip(row["doc_ids"], row["starts"], ends):
                found = value(ids[4 * start : 4 * end])
                for k, v in zip(out, (doc, row["part"], row["first_token"] + start, end - start, found)):
                    out[k].append(v)
        return out

    docs = map_batches(segments, work, f"doc_id long, part int, start long, n_tokens long, value {kind}", rows=1)
    joined = docs.join(F.broadcast(bases), docs["part"] == bases["_part"])
    return joined.select("doc_id", (F.col("start") + F.col("_base")).alias("start"), "n_tokens", "value")


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id start n_tokens ids`` from a store; ids are little-endian unsigned 32-bit."""
    return _read(spark, path, "binary", bytes).withColumnRenamed("value", "ids")


def document_digests(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id start n_tokens ids_crc32`` read from a store."""
    return _read(spark, path, "long", zlib.crc32).withColumnRenamed("value", "ids_crc32")
