"""Whitening of embeddings by QDWH spectral divide-and-conquer.

Spark sums the centred covariance of the different vectors; it has as many entries as the
square of the vectors' length, whatever the number of rows. The polar factor of the shifted
covariance, found by dynamically weighted Halley steps, is +1 on the eigenvectors above the
shift and -1 below, so it gives the spectral projectors. They split the space in
two, and each part is split again until parts are single components. The whitening
matrix then travels to the tasks that project the rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from maskwright.llm.common import _arrow_schema, free_name
from maskwright.sources.staging import stage

SCALE = 256
COMPONENTS = 4
_EPS = np.finfo(float).eps


def polar_factor(a: np.ndarray) -> np.ndarray:
    """The orthogonal polar factor of a symmetric matrix by QR-based QDWH steps.

    Singular values start within [1e-16, 1] of the scaled matrix; six or so steps bring them to 1.
    """
    n = len(a)
    x, least = a / np.linalg.norm(a), 1e-16
    for _ in range(12):
        d = np.cbrt(4 * (1 - least**2) / least**4)
        p = np.sqrt(1 + d) + 0.5 * np.sqrt(8 - 4 * d + 8 * (2 - least**2) / (least**2 * np.sqrt(1 + d)))
        b = (p - 1) ** 2 / 4
        c = p + b - 1
        q, _ = np.linalg.qr(np.concatenate([np.sqrt(c) * x, np.eye(n)]))
        new = (b / c) * x + (p - b / c) / np.sqrt(c) * (q[:n] @ q[n:].T)
        new = (new + new.T) / 2
        moved, x = np.linalg.norm(new - x), new
        least = min(1.0, least * (p + b * least**2) / (1 + c * least**2))
        if 1 - least < 4 * _EPS and moved < 1e-8:
            break
    return x


def split(a: np.ndarray, shift: float) -> tuple[np.ndarray, np.ndarray] | None:
    """Orthonormal bases of the invariant subspaces above and below ``shift``; None where it lies too
    close to an eigenvalue."""
    n = len(a)
    projector = (polar_factor(a - shift * np.eye(n)) + np.eye(n)) / 2
    rank = int(round(np.trace(projector)))
    if not 0 < rank < n or np.linalg.norm(projector @ projector - projector) > 1e-6:
        return None
    draw = np.random.default_rng(n).standard_normal((n, n))
    both = np.concatenate([projector @ draw[:, :rank], draw[:, rank:] - projector @ draw[:, rank:]], axis=1)
    for _ in range(3):  # a projector's range needs one step; more take out rounding
        above, _ = np.linalg.qr(both[:, :rank])
        below, _ = np.linalg.qr(both[:, rank:])
        both = np.concatenate([projector @ above, below - projector @ below], axis=1)
    basis, _ = np.linalg.qr(both)
    if np.linalg.norm(basis[:, rank:].T @ a @ basis[:, :rank]) > 1e-12 * np.linalg.norm(a):
        return None
    return basis[:, :rank], basis[:, rank:]


def top_components(a: np.ndarray, keep: int = COMPONENTS) -> tuple[np.ndarray, np.ndarray]:
    """The ``keep`` largest eigenvalues of a symmetric matrix, falling, and their unit eigenvectors.

    The shift is the mean of the eigenvalues, which always has some on either side. Only
    subspaces that hold wanted components are split on. Where all eigenvalues of
    a part agree to rounding, any basis of it serves.
    """
    size = np.linalg.norm(a)
    found: list[np.ndarray] = []

    def visit(part: np.ndarray, basis: np.ndarray) -> None:
        n = len(part)
        mean = np.trace(part) / n
        spread = np.linalg.norm(part - mean * np.eye(n))
        if n == 1 or spread <= 8 * n * _EPS * size:
            found.extend(basis.T[np.argsort(-np.diag(part), kind="stable")])
            return
        halves = None
        for nudge in (0.0, 0.02, -0.02, 0.11, -0.11, 0.3, -0.3, 0.7, -0.7):
            halves = split(part, mean + nudge * spread / np.sqrt(n))
            if halves is not None:
                break
        if halves is None:  # eigenvalues too close to part in double precision
            found.extend(basis.T[np.argsort(-np.diag(part), kind="stable")])
            return
        for half in halves:
            if len(found) < keep:
                visit(_symmetric(half.T @ part @ half), basis @ half)

    if len(a):
        visit(_symmetric(a), np.eye(len(a)))
    vectors = np.array(found[:keep]).reshape(-1, len(a)).T
    values = np.einsum("ij,ij->j", vectors, a @ vectors)
    order = np.argsort(-values, kind="stable")
    return values[order], vectors[:, order]


def _symmetric(a: np.ndarray) -> np.ndarray:
    return (a + a.T) / 2


def scaled(vector: Column, scale: int = SCALE) -> Column:
    """``floor(scale * c)`` of every entry, as longs; null where the vector or an entry is null or not finite."""
    vec = vector.cast("array<double>")
    fine = F.forall(vec, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    return F.when(F.coalesce(fine, F.lit(False)), F.transform(vec, lambda c: F.floor(F.lit(float(scale)) * c)))


def _matrix(batch: pa.RecordBatch, dim: int) -> np.ndarray:
    return batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def _about_mean(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """``n * x - sums``, exactly: in longs where they hold it, else in Python's integers."""
    largest = max(int(x.max()), -int(x.min())) if x.size else 0
    if n * largest + max(map(abs, sums), default=0) < 2**62:
        return n * x - np.array(sums, np.int64)
    return n * x.astype(object) - np.array(sums, object)


def _per_task(df: DataFrame, add, emit, schema: str) -> DataFrame:
    """Fold a task's batches with ``add(state, batch)`` and emit one result per task."""
    arrow = _arrow_schema(df.sparkSession, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = None
        for batch in batches:
            if batch.num_rows:
                state = add(state, batch)
        if state is not None:
            yield pa.RecordBatch.from_pydict(emit(state), schema=arrow)

    return df.mapInArrow(run, schema)


def _sums(fit: DataFrame, dim: int) -> tuple[int, list[int]]:
    """The number of vectors and the exact sum of each entry: a row per entry reaches the driver."""

    def add(state, batch):
        x = _matrix(batch, dim)
        largest = max(int(x.max()), -int(x.min()))
        total = x.sum(axis=0) if largest * len(x) < 2**62 else x.astype(object).sum(axis=0)
        n, sums = state or (0, [0] * dim)
        return n + len(x), [a + int(b) for a, b in zip(sums, total)]

    def emit(state):
        from decimal import Decimal

        return {"i": [-1, *range(dim)], "v": [Decimal(state[0]), *map(Decimal, state[1])]}

    parts = _per_task(fit, add, emit, "i int, v decimal(38,0)")
    found = {r["i"]: int(r["v"]) for r in parts.groupBy("i").agg(F.sum("v").cast("decimal(38,0)").alias("v")).collect()}
    return found.get(-1, 0), [found.get(i, 0) for i in range(dim)]


def _second_moment(fit: DataFrame, dim: int, project, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Sums of ``project(x)`` and of its outer products: ``width`` squared numbers at most reach the driver."""
    upper = np.triu_indices(width)

    def add(state, batch):
        z = project(_matrix(batch, dim))
        total, gram = state or (np.zeros(width), np.zeros((width, width)))
        return total + z.sum(axis=0), gram + z.T @ z

    def emit(state):
        return {"i": [*[-1] * width, *upper[0].tolist()], "j": [*range(width), *upper[1].tolist()], "v": np.concatenate([state[0], state[1][upper]])}

    parts = _per_task(fit, add, emit, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).toArrow()
    i, j, v = (parts.column(c).to_numpy() for c in ("i", "j", "v"))
    total, gram = np.zeros(width), np.zeros((width, width))
    total[j[i < 0]] = v[i < 0]
    i, j, v = i[i >= 0], j[i >= 0], v[i >= 0]
    gram[i, j] = v
    gram[j, i] = v
    return total, gram


def whiten(vectors: DataFrame, column: str = "embedding", keep: int = COMPONENTS, scale: int = SCALE) -> DataFrame:
    """The columns of ``vectors`` but ``column``, and per row and component ``component n deviation whitened explained identity_error``.

    Rows whose vector is null, empty or holds null or non-finite entries are dropped. Entries are
    ``floor(scale * c)``. The fit takes each different vector once: ``n`` of them, covariance
    with divisor ``n``, centred before multiplying. ``deviation`` is the exact squared length of
    ``n * x - sums`` (decimal). ``whitened`` is the projection over the root of the
    component's eigenvalue, 0 where that is zero to rounding (fewer different directions than
    components); ``explained`` its share of the trace; ``identity_error`` the largest
    entry by which the covariance of the fitted ``whitened`` departs from the identity,
    over components that are not zero.

    All vectors should have one length. Those of another length than the most common (of
    equals the smaller) have no place among the components and are dropped too. Repeated rows
    and null ids are rows of their own; extra columns are kept, names that clash get underscores in front.
    An empty table gives no rows.
    """
    rest = [c for c in vectors.columns if c.lower() != column.lower()]
    made = [free_name(vectors.select(*rest), c) for c in ("component", "n", "deviation", "whitened", "explained", "identity_error")]
    rows = stage(vectors.select(F.struct(*rest).alias("row") if rest else F.struct(F.lit(1)).alias("row"), scaled(F.col(column), scale).alias("x")).filter(F.size("x") > 0))
    common = rows.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    dim = common[0]["d"] if common else 1
    rows = rows.filter(F.size("x") == dim)
    fit = stage(rows.select("x").distinct())
    n, sums = _sums(fit, dim)

    def centred(x: np.ndarray) -> np.ndarray:
        return _about_mean(x, n, sums).astype(np.float64) / n

    covariance = _second_moment(fit, dim, centred, dim)[1] / max(n, 1)
    values, axes = top_components(covariance, keep)
    trace, keep = float(np.trace(covariance)), len(values)
    real = values > 4 * dim * _EPS * max(trace, 0.0)
    matrix = np.where(real, axes / np.sqrt(np.where(real, values, 1.0)), 0.0)
    total, moment = _second_moment(fit, dim, lambda x: centred(x) @ matrix, keep)
    mean = total / max(n, 1)
    error = np.abs(moment / max(n, 1) - np.outer(mean, mean) - np.diag(real.astype(float)))
    identity_error = float(error.max()) if error.size else 0.0
    explained = (values / trace if trace > 0 else np.zeros(keep)).tolist()

    done = "component int, n long, deviation decimal(38,0), whitened double"
    schema = f"row {rows.schema['row'].dataType.simpleString()}, {done}"
    arrow = _arrow_schema(rows.sparkSession, schema)

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from decimal import Decimal

        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                some = batch.slice(at, 4096)
                about = _about_mean(_matrix(some, dim), n, sums)
                small = about.dtype != object and int(np.abs(about).max(initial=0)) ** 2 * dim < 2**63
                squares = (about**2).sum(axis=1) if small else (about.astype(object) ** 2).sum(axis=1)
                white = (about.astype(np.float64) / n) @ matrix
                each = np.repeat(np.arange(some.num_rows), keep)
                deviation = pa.array([Decimal(int(v)) for v in squares], pa.decimal128(38, 0)).take(pa.array(each))
                columns = [some.column("row").take(pa.array(each)), pa.array(np.tile(np.arange(1, keep + 1, dtype=np.int32), some.num_rows))]
                columns += [pa.array(np.full(len(each), n)), deviation, pa.array(white.reshape(-1))]
                yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, arrow)], schema=arrow)

    out = rows.mapInArrow(project, schema)
    share = F.element_at(F.array(*map(F.lit, explained or [0.0])), F.col("component"))
    values_of = [F.col(c) for c in ("component", "n", "deviation", "whitened")] + [share, F.lit(identity_error)]
    return out.select(*[F.col("row")[c].alias(c) for c in rest], *[v.alias(name) for v, name in zip(values_of, made)])
