"""Near duplicates of embeddings by cross-polytope hashing.

A hash is the largest coordinate, with its sign, after three rounds of random signs and
a fast Hadamard transform. A table joins several such hashes; each vector enters
its ``probes`` best buckets of every table. Pairs in a bucket are verified by cosine in double
precision, and a pair counts only in the first bucket that both share.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from maskwright.llm.buckets import Forest, map_buckets, runs
from maskwright.llm.common import map_batches
from maskwright.llm.components import components
from maskwright.sources.staging import stage

COSINE = 0.95
TABLES = 4
PROBES = 3
SEED = 11
#: Rows of a bucket that one task compares; a larger bucket is cut into blocks, compared pair by pair.
BLOCK = 2048
_PAIRS = 1 << 18


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of the rows; the width is a power of two."""
    n, width = x.shape
    h = 1
    while h < width:
        x = x.reshape(n, width // (2 * h), 2, h)
        x = np.concatenate([x[:, :, :1] + x[:, :, 1:], x[:, :, :1] - x[:, :, 1:]], axis=2)
        h *= 2
    return x.reshape(n, width) / math.sqrt(width)


def bucket_codes(unit: np.ndarray, hashes: int, tables: int = TABLES, probes: int = PROBES, seed: int = SEED) -> np.ndarray:
    """Codes (rows, tables, probes): the best ``probes`` buckets of each vector in each table.

    Every hash offers its three largest coordinates; a bucket's loss is how far its
    coordinates fall short of the largest. -1 where there are fewer buckets than probes.
    Long vectors take fewer hashes where codes would leave 63 bits.
    """
    n, dim = unit.shape
    width = 1 << max(1, (dim - 1).bit_length())
    padded = np.zeros((n, width))
    padded[:, :dim] = unit
    draw = np.random.default_rng([seed, dim])
    hashes = hashes_that_fit(hashes, dim)
    out = np.full((n, tables, probes), -1, np.int64)
    for t in range(tables):
        codes, loss = np.zeros((n, 1), np.int64), np.zeros((n, 1))
        for _ in range(hashes):
            y = padded
            for _ in range(3):
                y = hadamard(y * draw.choice([-1.0, 1.0], width))
            both = np.concatenate([y, -y], axis=1)
            best = np.argsort(-both, axis=1, kind="stable")[:, :3]
            short = np.take_along_axis(both, best[:, :1], 1) - np.take_along_axis(both, best, 1)
            codes = (codes[:, :, None] * (2 * width) + best[:, None, :]).reshape(n, -1)
            loss = (loss[:, :, None] + short[:, None, :] ** 2).reshape(n, -1)
            order = np.argsort(loss, axis=1, kind="stable")[:, :probes]
            codes, loss = np.take_along_axis(codes, order, 1), np.take_along_axis(loss, order, 1)
        out[:, t, : codes.shape[1]] = codes
    return out


def _unit(x: np.ndarray) -> np.ndarray:
    """Rows of length 1; scaled by the largest component first, so that squares neither overflow nor vanish."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def hashes_for(vectors: int, dim: int) -> int:
    """Hashes per table, so that an even spread leaves tens of vectors to a bucket."""
    width = 2 << max(1, (dim - 1).bit_length())
    return min(6, max(1, math.ceil(math.log(max(vectors, 2) / 64, width)))) if vectors > 64 else 1


def _code_bits(dim: int) -> int:
    """Bits of one hash of vectors of ``dim`` components: a coordinate and its sign."""
    return max(1, (dim - 1).bit_length()) + 1


def hashes_that_fit(hashes: int, dim: int) -> int:
    """At most ``hashes``, so that the largest code is a positive long."""
    return min(hashes, 63 // _code_bits(dim))


def code_type(hashes: int, dim: int) -> str:
    """The narrowest integer that holds every code of vectors of ``dim`` components."""
    return "<i4" if hashes_that_fit(hashes, dim) * _code_bits(dim) <= 31 else "<i8"


def _usable(vectors: DataFrame) -> DataFrame:
    """``vec_id vec``: the vector, or null where it can link with nothing. Single precision stays so."""
    kind = "float" if "array<float>" in dict(vectors.dtypes)["embedding"] else "double"
    vec = F.col("embedding").cast(f"array<{kind}>")
    fine = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    usable = vec.isNotNull() & fine & F.exists(vec, lambda x: x != 0)
    return vectors.select(F.col("vec_id").cast("long"), F.when(F.coalesce(usable, F.lit(False)), vec).alias("vec"))


def _first_shared(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first table, and the least code in it, that rows of the code lists ``a`` and ``b`` share."""
    both = (a[:, :, :, None] == b[:, :, None, :]) & (a[:, :, :, None] >= 0)
    shared = both.any(axis=3)
    table = shared.any(axis=2).argmax(axis=1)
    rows = np.arange(len(a))
    least = np.where(shared[rows, table], a[rows, table].astype(np.int64), np.iinfo(np.int64).max).min(axis=1)
    return table, least


def near_vectors(vectors: DataFrame, cosine: float = COSINE, tables: int = TABLES, probes: int = PROBES, block: int = BLOCK) -> DataFrame:
    """``vec_id n_links component_id kept`` for every row of ``vec_id embedding``.

    Vectors that are null, empty, zero or hold null or non-finite components link with
    nothing; vectors of different length do not link. Equal vectors are one class before
    hashing and count as linked. A bucket above ``block`` rows is cut into blocks whose pairs
    are compared in tasks of their own, so no bucket is dropped or cut off. A row with a
    null vec_id counts as a link of others and has a null component only where no linked
    row has an id. Repeated rows count as vectors of their own.
    """
    rows = stage(_usable(vectors))
    different = rows.filter(F.col("vec").isNotNull()).groupBy("vec").agg(F.min("vec_id").alias("rep"), F.count("*").alias("n"))
    classes = stage(different.withColumn("dim", F.size("vec")).withColumn("class", F.monotonically_increasing_id()))
    shape = classes.groupBy("dim").count().orderBy(F.desc("count"), "dim").limit(1).collect()
    hashes = hashes_for(shape[0]["count"], shape[0]["dim"]) if shape else 1
    real = "<f4" if "float" in dict(classes.dtypes)["vec"] else "<f8"

    def spread(batch: pa.RecordBatch, whole: bool) -> dict:
        """A row per bucket that a vector enters, with what verification needs if ``whole``."""
        dims = batch.column("dim").to_numpy()
        out: dict[str, list] = {k: [] for k in ("dim", "t", "code", *(("class", "n", "vec", "codes") if whole else ()))}
        for dim in np.unique(dims):
            at = np.flatnonzero(dims == dim)
            x = np.array([batch.column("vec")[int(i)].as_py() for i in at], np.float64)
            codes = bucket_codes(_unit(x), hashes, tables, probes)
            for row, i in enumerate(at):
                entered = [(dim, t, code) for t in range(tables) for code in codes[row, t].tolist() if code >= 0]
                names = zip(*entered)
                for k, v in zip(("dim", "t", "code"), names):
                    out[k] += v
                if whole:
                    packed = (batch.column("class")[int(i)].as_py(), batch.column("n")[int(i)].as_py(), x[row].astype(real).tobytes(), codes[row].astype(code_type(hashes, int(dim))).tobytes())
                    for k, v in zip(("class", "n", "vec", "codes"), packed):
                        out[k] += [v] * len(entered)
        return out

    slim = map_batches(classes, lambda batch: spread(batch, False), "dim int, t int, code long")
    sent = map_batches(classes, lambda batch: spread(batch, True), "dim int, t int, code long, class long, n long, vec binary, codes binary")
    key = ["dim", "t", "code"]
    large = slim.groupBy(*key).count().filter(F.col("count") > block).select(*key, F.ceil(F.col("count") / block).cast("int").alias("blocks"))
    dealt = sent.join(large, key, "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    own = F.pmod(F.xxhash64("class", F.lit(7)), F.col("blocks")).cast("int")
    dealt = dealt.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.withColumn("x", F.least("own", "other")).withColumn("y", F.greatest("own", "other")).drop("blocks", "other")

    def verify(table: pa.Table) -> dict | None:
        col = {c: table.column(c).to_numpy() for c in ("dim", "t", "code", "x", "y", "own", "class", "n")}
        bounds = runs(*[col[c] for c in (*key, "x", "y")])
        vecs, codes = table.column("vec").to_pylist(), table.column("codes").to_pylist()
        adds, forest = np.zeros(len(vecs), np.int64), Forest(len(vecs))
        for dim in np.unique(col["dim"]):
            mine = col["dim"] == dim
            v = _unit(np.frombuffer(b"".join(vecs[i] for i in np.flatnonzero(mine)), real).reshape(-1, dim).astype(np.float64))
            c = np.frombuffer(b"".join(codes[i] for i in np.flatnonzero(mine)), code_type(hashes, int(dim))).reshape(-1, tables, probes)
            base = int(np.argmax(mine))
            for i, j in _pairs(bounds, mine):
                i, j = i - base, j - base
                cross = (col["own"][i + base] != col["own"][j + base]) | (col["x"][i + base] == col["y"][i + base])
                i, j = i[cross], j[cross]
                near = np.einsum("ij,ij->i", v[i], v[j]) >= cosine
                i, j = i[near], j[near]
                if not len(i):
                    continue
                forest.link(i + base, j + base)
                t, code = _first_shared(c[i], c[j])
                first = (t == col["t"][i + base]) & (code == col["code"][i + base])
                np.add.at(adds, i[first] + base, col["n"][j[first] + base])
                np.add.at(adds, j[first] + base, col["n"][i[first] + base])
        out = np.flatnonzero((adds > 0) | (forest.up != np.arange(len(adds))))
        return {"class": col["class"][out], "adds": adds[out], "root": col["class"][forest.up[out]]}

    parts = stage(map_buckets(dealt, [*key, "x", "y"], verify, "class long, adds long, root long"))
    adds = parts.groupBy("class").agg(F.sum("adds").alias("adds"))
    joined = components(parts.select(F.col("class").alias("a"), F.col("root").alias("b")))
    named = classes.select("vec", "class", "rep", "n").join(adds, "class", "left")
    named = named.join(joined.withColumnRenamed("vertex", "class"), "class", "left").withColumn("component", F.coalesce("component", "class"))
    least = named.groupBy("component").agg(F.min("rep").alias("least"))
    known = named.join(least, "component").select("vec", (F.col("n") - 1 + F.coalesce("adds", F.lit(0))).alias("n_links"), F.col("least").alias("component_id"))
    linked = rows.filter(F.col("vec").isNotNull()).join(known, "vec").select("vec_id", "n_links", "component_id")
    alone = rows.filter(F.col("vec").isNull()).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionAll(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def _pairs(bounds: np.ndarray, mine: np.ndarray):
    """Index pairs i < j inside the runs of the rows in ``mine``, in chunks."""
    lo, hi = bounds[:-1], bounds[1:]
    keep = mine[lo] if len(lo) else np.zeros(0, bool)
    lo, hi = lo[keep], hi[keep]
    # one entry per row: how many rows of its run come after it
    i = np.concatenate([np.arange(a, b) for a, b in zip(lo, hi)]) if len(lo) else np.zeros(0, np.int64)
    after = np.repeat(hi, hi - lo) - i - 1
    i, after = i[after > 0], after[after > 0]
    ends = np.cumsum(after)
    at = 0
    while at < len(i):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + _PAIRS, side="right")))
        a, n = i[at:to], after[at:to]
        first = np.repeat(a, n)
        yield first, first + 1 + np.arange(len(first)) - np.repeat(np.cumsum(n) - n, n)
        at = to
