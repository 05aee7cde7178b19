"""Streams of whole buckets through Arrow batches, and linking inside a task."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from maskwright.llm.common import _arrow_schema


def runs(*keys: np.ndarray) -> np.ndarray:
    """Where runs of equal keys begin, and the end."""
    n = len(keys[0])
    change = np.zeros(max(n - 1, 0), bool)
    for k in keys:
        change |= k[1:] != k[:-1]
    return np.concatenate([[0], np.flatnonzero(change) + 1, [n]]) if n else np.zeros(1, np.int64)


def map_buckets(df: DataFrame, keys: list[str], work: Callable[[pa.Table], dict | None], schema: str, order: list[str] = ()) -> DataFrame:
    """Shuffle rows by ``keys`` and hand ``work`` tables of whole buckets, sorted by ``keys`` and ``order``.

    Memory holds one Arrow batch and the bucket that it cuts.
    """
    arrow = _arrow_schema(df.sparkSession, schema)

    def done(table: pa.Table) -> Iterator[pa.RecordBatch]:
        if table.num_rows and (out := work(table)):
            yield pa.RecordBatch.from_pydict(out, schema=arrow)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            cut = int(runs(*[batch.column(k).to_numpy(zero_copy_only=False) for k in keys])[-2]) if batch.num_rows else 0
            same = held and all(held[0].column(k)[0] == batch.column(k)[0] for k in keys) if batch.num_rows else True
            if not batch.num_rows:
                continue
            if held and not same:
                yield from done(pa.Table.from_batches(held))
                held = []
            if cut:
                yield from done(pa.Table.from_batches([*held, batch.slice(0, cut)]))
                held = []
            held.append(batch.slice(cut))
        if held:
            yield from done(pa.Table.from_batches(held))

    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, schema)


class Forest:
    """Vertices 0 to n-1 joined by links; a vertex points to a smaller one or to itself."""

    def __init__(self, n: int):
        self.up = np.arange(n)

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        """Join the pairs: hang each larger root on the smallest it meets, until none is left."""
        while len(a):
            ra, rb = self.up[a], self.up[b]
            apart = ra != rb
            a, b = np.maximum(ra[apart], rb[apart]), np.minimum(ra[apart], rb[apart])
            np.minimum.at(self.up, a, b)
            while True:
                above = self.up[self.up]
                if np.array_equal(above, self.up):
                    break
                self.up = above
