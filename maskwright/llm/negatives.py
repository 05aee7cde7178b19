"""Hard negatives by inner product, found exactly in cover trees.

A further coordinate gives all candidates of a block one norm, so that inner products with
an anchor follow angles. A cover tree halves its covering radius from level to level; the radius
of a node bounds the scores of everything below it from both sides. An anchor descends best
node first, skips nodes whose scores all lie outside what it still needs, and scores the
rest exactly. Candidates lie in blocks with a tree each; anchors visit every block.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from maskwright.llm.common import _arrow_schema
from maskwright.llm.whitening import scaled
from maskwright.sources.staging import stage

POSITIVES = NEGATIVES = 5
#: A negative's score lies between ``LOW`` and ``HIGH`` hundredths of the positive's.
LOW, HIGH = 80, 100
#: Candidates of a block, in the mean.
BLOCK = 4096
LEAF = 24
#: Squared length below which all sums of products are whole numbers that doubles hold exactly.
EXACT = float(2**53)
_NET = 64


class CoverTree:
    """A tree over the rows of ``x``; ``scored`` counts rows scored by searches so far.

    ``centre[k]`` is a row; ``cone[k]`` the largest angle from it to a row below node k. A node has
    its rows in ``order[low[k]:high[k]]`` (a leaf) or children ``first[k]`` to ``last[k]``.
    A child's centre is scored with its parent; ``own`` marks a child that shares it.
    """

    def __init__(self, x: np.ndarray, leaf: int = LEAF):
        self.x, self.scored, self.leaf = x, 0, leaf
        squares = np.einsum("ij,ij->i", x, x)
        self.norm = float(np.sqrt(squares.max(initial=0.0)))
        self.points = np.column_stack([x, np.sqrt(np.maximum(self.norm**2 - squares, 0.0))])
        self.centre: list[int] = []
        self.own: list[bool] = []
        nodes: list[tuple[float, int, int, int, int]] = []
        todo = self._add([(0, np.arange(1, len(x)), False)])
        order, filled = [], 0
        for node, rows in todo:  # grows while it is read: one level after the other
            chord = self._chords(self.centre[node], rows)
            radius = float(chord.max(initial=0.0))
            cone = 2 * np.arcsin(min(1.0, radius / (2 * self.norm))) if self.norm else 0.0
            if len(rows) <= leaf or radius <= 1e-6 * self.norm:
                order.append(rows)
                nodes.append((cone, filled, filled + len(rows), 0, 0))
                filled += len(rows)
            else:
                start = len(self.centre)
                todo += self._add(self._net(self.centre[node], rows, chord, radius / 2))
                nodes.append((cone, 0, 0, start, len(self.centre)))
        self.order = np.concatenate(order) if order else np.zeros(0, np.int64)
        self.cone, self.low, self.high, self.first, self.last = map(np.array, zip(*nodes))
        self.centre, self.own = np.array(self.centre), np.array(self.own)

    def _add(self, children: list[tuple[int, np.ndarray, bool]]) -> list[tuple[int, np.ndarray]]:
        start = len(self.centre)
        self.centre += [c for c, _, _ in children]
        self.own += [own for _, _, own in children]
        return [(start + k, rows) for k, (_, rows, _) in enumerate(children)]

    def _chords(self, centre: int, rows: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(2 * self.norm**2 - 2 * (self.points[rows] @ self.points[centre]), 0.0))

    def _net(self, centre: int, rows: np.ndarray, chord: np.ndarray, radius: float) -> list[tuple[int, np.ndarray, bool]]:
        """Cover ``rows`` by balls of ``radius``: around the parent's centre, then around rows that
        no ball covers yet, so centres lie further than ``radius`` apart."""
        near = chord <= radius
        children = [(centre, rows[near], True)] if near.any() else []
        rest = rows[~near]
        while len(rest):
            some = rest[:_NET]
            covers = 2 * self.norm**2 - 2 * (self.points[some] @ self.points[rest].T) <= radius**2
            alive = np.ones(len(rest), bool)
            for k, c in enumerate(some.tolist()):
                if alive[k]:
                    ball = covers[k] & alive
                    ball[k] = True
                    alive &= ~ball
                    ball[k] = False
                    children.append((c, rest[ball], False))
            rest = rest[alive]
        return children

    def search(self, q: np.ndarray, windows: list[tuple[float, float]], k: int, take: Callable[[np.ndarray], np.ndarray], ids: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each window (lowest, highest score) the first ``k`` rows that ``take`` admits and their
        scores: higher scores first, ties by ``ids``, then by row."""
        reach = float(np.sqrt(q @ q)) * self.norm
        slack = 1e-6 * reach
        best = [(np.zeros(0, np.int64), np.zeros(0)) for _ in windows]
        need = np.array([low for low, _ in windows])
        tops = np.array([high for _, high in windows])

        def visit(rows: np.ndarray, scores: np.ndarray) -> None:
            self.scored += len(rows)
            fine = (scores >= need.min()) & (scores <= tops.max())
            rows, scores = rows[fine], scores[fine]
            if len(rows):
                fine = take(rows)
                rows, scores = rows[fine], scores[fine]
            if not len(rows):
                return
            for w, (low, high) in enumerate(windows):
                inside = (scores >= need[w]) & (scores <= high)
                if inside.any():
                    r = np.concatenate([best[w][0], rows[inside]])
                    s = np.concatenate([best[w][1], scores[inside]])
                    first = np.lexsort((r, ids[r], -s))[:k]
                    best[w] = (r[first], s[first])
                    if len(first) == k:
                        need[w] = max(low, s[first[-1]])

        def bounds(nodes: np.ndarray, scores: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            if not reach:
                return np.zeros(len(nodes)), np.zeros(len(nodes))
            angle = np.arccos(np.clip(scores / reach, -1.0, 1.0))
            upper = reach * np.cos(np.maximum(angle - self.cone[nodes], 0.0)) + slack
            return upper, reach * np.cos(np.minimum(angle + self.cone[nodes], np.pi)) - slack

        def wanted(upper, lower):
            return ((upper[:, None] >= need) & (lower[:, None] <= tops)).any(axis=1)

        root = np.array([0])
        score = self.x[self.centre[root]] @ q
        visit(self.centre[root], score)
        upper, lower = bounds(root, score)
        heap = [(-float(upper[0]), 0, float(score[0]), float(lower[0]))]
        while heap and -heap[0][0] >= need.min():
            above, node, own_score, below = heapq.heappop(heap)
            if not ((-above >= need) & (below <= tops)).any():
                continue
            if self.first[node] == self.last[node]:
                rows = self.order[self.low[node] : self.high[node]]
                visit(rows, self.x[rows] @ q)
                continue
            nodes = np.arange(self.first[node], self.last[node])
            scores = self.x[self.centre[nodes]] @ q
            scores[self.own[nodes]] = own_score
            fresh = ~self.own[nodes]
            visit(self.centre[nodes[fresh]], scores[fresh])
            more = (self.last[nodes] > self.first[nodes]) | (self.high[nodes] > self.low[nodes])
            nodes, scores = nodes[more], scores[more]
            upper, lower = bounds(nodes, scores)
            keep = wanted(upper, lower)
            for up, kid, s, low in zip(upper[keep].tolist(), nodes[keep].tolist(), scores[keep].tolist(), lower[keep].tolist()):
                heapq.heappush(heap, (-up, kid, s, low))
        return best


def _rows(vectors: DataFrame, scale: int) -> DataFrame:
    """``row id label anchor x dim`` of the rows that take part; ``x`` holds whole numbers."""
    x = F.transform(scaled(F.col("embedding"), scale), lambda c: c.cast("double"))
    made = vectors.select(F.col("vec_id").cast("long").alias("id"), F.col("label").cast("long").alias("label"), F.col("anchor").cast("boolean").alias("anchor"), x.alias("x"))
    fine = F.col("id").isNotNull() & F.col("label").isNotNull() & (F.size("x") > 0)
    short = F.aggregate("x", F.lit(0.0), lambda s, c: s + c * c) < EXACT
    return stage(made.filter(fine & short).withColumn("dim", F.size("x")).withColumn("row", F.monotonically_increasing_id()))


def _in_blocks(rows: DataFrame, asked: DataFrame, blocks: int, leaf: int, k: int, schema: str, windows_of, take_of, out_of) -> DataFrame:
    """Send every asked row to every block and search there. ``asked`` has ``row id label x dim`` and
    the columns that ``windows_of`` reads.

    A block's candidates come first and are held; the asked rows stream past.
    """
    extra = [c for c in asked.columns if c not in ("row", "id", "label", "x", "dim")]
    candidates = rows.select(
        "dim", F.pmod(F.xxhash64("row", F.lit(5)), F.lit(blocks)).cast("int").alias("block"), F.lit(0).alias("kind"), "row", "id", "label", "x",
        *[F.lit(None).cast(asked.schema[c].dataType).alias(c) for c in extra],
    )
    sent = asked.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).withColumn("kind", F.lit(1))
    both = candidates.unionByName(sent.select(*candidates.columns))
    arrow = _arrow_schema(rows.sparkSession, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, tree, known = None, [], None, {}
        for batch in batches:
            if not batch.num_rows:
                continue
            col = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in ("dim", "block", "kind", "row", "id", "label")}
            change = np.zeros(batch.num_rows, bool)
            for c in ("dim", "block", "kind"):
                change[1:] |= col[c][1:] != col[c][:-1]
            ends = np.append(np.flatnonzero(change), batch.num_rows)
            for a, b in zip(np.append(0, ends[:-1]), ends):
                dim = int(col["dim"][a])
                if key != (dim, col["block"][a]):
                    key, held, tree = (dim, col["block"][a]), [], None
                part = {c: col[c][a:b] for c in ("row", "id", "label")}
                part["x"] = batch.column("x").slice(a, b - a).flatten().to_numpy().reshape(-1, dim)
                if not col["kind"][a]:
                    held.append(part)
                    continue
                if not held and tree is None:
                    continue  # no candidates of this length in the block
                if tree is None:
                    known = {c: np.concatenate([h[c] for h in held]) for c in part}
                    # the order of rows in a block is not given: sorted, results do not depend on it
                    at = np.argsort(known["row"])
                    known, held = {c: v[at] for c, v in known.items()}, []
                    tree = CoverTree(known["x"], leaf)
                more = batch.slice(a, b - a).select(extra).to_pylist() if extra else [{}] * (b - a)
                found: list[tuple] = []
                for i in range(b - a):
                    mine = {c: part[c][i] for c in ("row", "id", "label")}
                    windows = windows_of(more[i])
                    if windows:
                        lists = tree.search(part["x"][i], windows, k, take_of(known, mine), known["id"])
                        for w, (r, s) in enumerate(lists):
                            found += [out_of(mine, more[i], w, int(known["id"][j]), int(known["row"][j]), int(v)) for j, v in zip(r, s)]
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(zip(*found), arrow)], schema=arrow)

    keys = ["dim", "block"]
    return both.repartition(*keys).sortWithinPartitions(*keys, "kind").mapInArrow(run, schema)


def _first(df: DataFrame, group: list[str], k: int, out: str) -> DataFrame:
    order = Window.partitionBy(*group).orderBy(F.desc("score"), "found", "found_row")
    return df.withColumn(out, F.row_number().over(order)).filter(F.col(out) <= k)


def hard_negatives(
    vectors: DataFrame, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH,
    scale: int = 256, block: int = BLOCK, leaf: int = LEAF,
) -> DataFrame:
    """``anchor_id positive_id rank negative_id positive_score negative_score`` for rows of ``vec_id label anchor embedding``.

    An anchor (``anchor`` true) takes its best ``positives`` other rows of its label, and for each
    of them the best ``negatives`` rows of other labels that score from ``low`` to
    ``high`` hundredths of the positive. Scores are inner products of ``floor(scale * c)``;
    higher ones come first, ties by smaller ``vec_id``.

    Rows with a null id, label or vector, an empty vector, or null or non-finite components take no part, nor
    those whose scaled squared length reaches 2^53 (unit vectors have 65 536), so scores are exact.
    Vectors of different length are not compared. A repeated row is another row: it may be the
    positive of its copy, and a repeated anchor has results of its own. An empty table, or an anchor whose
    windows are empty (any positive below zero), gives no rows.
    """
    rows = _rows(vectors, scale)
    blocks = max(1, -(-rows.count() // block))
    anchors = rows.filter("anchor").select("row", "id", "label", "x", "dim")
    whole = [(-np.inf, np.inf)]
    same = lambda known, me: lambda r: (known["label"][r] == me["label"]) & (known["row"][r] != me["row"])
    other = lambda known, me: lambda r: known["label"][r] != me["label"]
    near = _in_blocks(
        rows, anchors, blocks, leaf, positives, "row long, found long, found_row long, score long", lambda _: whole, same,
        lambda me, _, w, i, r, s: (int(me["row"]), i, r, s),
    )
    chosen = _first(near, ["row"], positives, "place").withColumn("pair", F.struct("place", F.col("found").alias("id"), "score"))
    chosen = chosen.groupBy("row").agg(F.sort_array(F.collect_list("pair")).alias("pairs"))
    asked = stage(anchors.join(chosen, "row"))

    def windows(more: dict) -> list[tuple[float, float]]:
        # a negative score has no window: 80 s is above 100 s
        bounds = [(-(-low * p["score"] // 100), high * p["score"] // 100) for p in more["pairs"]]
        return bounds if any(a <= b for a, b in bounds) else []

    hard = _in_blocks(
        rows, asked, blocks, leaf, negatives,
        "row long, anchor_id long, place int, positive_id long, positive_score long, found long, found_row long, score long", windows, other,
        lambda me, more, w, i, r, s: (int(me["row"]), int(me["id"]), more["pairs"][w]["place"], more["pairs"][w]["id"], more["pairs"][w]["score"], i, r, s),
    )
    best = _first(hard, ["row", "place"], negatives, "rank")
    return best.select("anchor_id", "positive_id", "rank", F.col("found").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
