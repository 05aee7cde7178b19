"""Toxicity by a linear classifier on character n-grams scaled by log-count ratios.

A text's n-grams are hashed to buckets and count once. A bucket's ratio compares how
often it occurs in toxic and in clean texts; buckets whose ratio says little are left
out; a logistic regression on presence times ratio gives the weights.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from maskwright.llm.common import free_name, hash_order, id_and_bytes, map_batches, text_scores, texts
from maskwright.llm.linear import fit_logistic

GRAMS = (3, 4, 5, 6)
BITS = 20
#: At most so many labelled rows of each class are fitted, the first in a hashed order.
FIT_ROWS = 2_500
THRESHOLD = 0.7
_OTHER = re.compile(r"[\W\d_]+")


def buckets(text: str) -> np.ndarray:
    """Hashed n-grams of the lower-cased text, runs of anything but letters as one blank; with repeats."""
    codes = np.frombuffer(f" {_OTHER.sub(' ', text.lower()).strip()} ".encode("utf-32-le", "replace"), np.uint32).astype(np.uint64)
    if len(codes) < 3:
        return np.zeros(0, np.int64)
    out, rolled = [], codes.copy()
    for n in range(2, max(GRAMS) + 1):
        if len(codes) < n:
            break
        rolled = rolled[:-1] * np.uint64(0x9E3779B97F4A7C15) + codes[n - 1 :]
        if n in GRAMS:
            mixed = (rolled ^ (rolled >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            out.append((mixed >> np.uint64(64 - BITS)).astype(np.int64))
    return np.concatenate(out)


def held_out() -> Column:
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))


def sample(labels: DataFrame, rows: int = FIT_ROWS) -> DataFrame:
    """The first ``rows`` labelled ids of each class outside the held-out third: ``_id toxic share``.

    ``share`` is how many labelled rows one of the sample stands for. An id labelled both
    ways is left out.
    """
    known = labels.filter(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out())
    known = known.groupBy(F.col("doc_id").cast("long").alias("_id")).agg(F.max((F.col("toxic") != 0).cast("int")).alias("toxic"), F.min((F.col("toxic") != 0).cast("int")).alias("low"))
    known = known.filter("toxic = low").select("_id", "toxic")
    counts = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    first = [
        known.filter(F.col("toxic") == c).orderBy(hash_order(3, "_id"), "_id").limit(rows).withColumn("share", F.lit(max(1.0, counts.get(c, 0) / rows)))
        for c in (0, 1)
    ]
    return first[0].unionAll(first[1])


def fit(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> dict:
    """The model, from at most ``rows`` labelled rows of each class (they fit one task).

    Without labels of both classes the model says 0 for all texts.
    """
    chosen = sample(labels, rows)
    # one text per id, so that the bound holds where ids repeat
    found = id_and_bytes(docs).join(F.broadcast(chosen), F.col("doc_id") == F.col("_id"))
    texts_of = found.groupBy("_id").agg(*[F.min(c).alias(c) for c in ("text", "toxic", "share")])

    def features(batch: pa.RecordBatch) -> dict:
        found = [np.unique(buckets(t)).astype("<i4").tobytes() for t in texts(batch.column("text"))]
        return {"toxic": batch.column("toxic"), "share": batch.column("share"), "found": found}

    def train(pdf: pd.DataFrame) -> pd.DataFrame:
        y, share = pdf["toxic"].to_numpy(np.float64), pdf["share"].to_numpy(np.float64)
        found = [np.frombuffer(b, "<i4") for b in pdf["found"]]
        seen = [np.bincount(np.concatenate([f for f, t in zip(found, y) if t == c] or [np.zeros(0, np.int32)]), minlength=1 << BITS) for c in (0, 1)]
        clean, toxic = max(1, (y == 0).sum()), max(1, (y == 1).sum())
        ratio = np.log((seen[1] + 0.5) / (toxic + 1)) - np.log((seen[0] + 0.5) / (clean + 1))
        keep = np.flatnonzero((np.abs(ratio) >= 1.5) & (seen[0] + seen[1] >= 4)) if (y == 0).any() and (y == 1).any() else np.zeros(0, np.int64)
        at = np.full(1 << BITS, -1, np.int64)
        at[keep] = np.arange(len(keep))
        index = [(i := at[f])[i >= 0] for f in found]
        weights, bias = np.zeros(0), -40.0
        if len(keep):
            weights, bias = fit_logistic(index, [ratio[keep][i] for i in index], y, share, len(keep))
        return pd.DataFrame({"keep": [keep.astype("<i4").tobytes()], "weights": [(weights * ratio[keep]).astype("<f8").tobytes()], "bias": [bias]})

    rows_ = map_batches(texts_of, features, "toxic int, share double, found binary", rows=256)
    got = rows_.withColumn("one", F.lit(0)).groupBy("one").applyInPandas(train, "keep binary, weights binary, bias double").collect()  # one row
    if not got:
        return {"keep": np.zeros(0, np.int64), "weights": np.zeros(0), "bias": -40.0}
    return {"keep": np.frombuffer(got[0]["keep"], "<i4").astype(np.int64), "weights": np.frombuffer(got[0]["weights"], "<f8"), "bias": got[0]["bias"]}


def scored(docs: DataFrame, model: dict, out: str = "score") -> DataFrame:
    """All columns and the score of each row; a null text is an empty one."""
    state: list[tuple[np.ndarray, np.ndarray]] = []

    def work(some: list[str]) -> list[float]:
        if not state:
            weight, known = np.zeros(1 << BITS, np.float32), np.zeros(1 << BITS, bool)
            weight[model["keep"]], known[model["keep"]] = model["weights"], True
            state.append((weight, known))
        weight, known = state[0]
        z = [weight[np.unique(found[known[found]])].sum(dtype=np.float64) + model["bias"] for found in map(buckets, some)]
        return (1 / (1 + np.exp(-np.clip(np.array(z), -40, 40)))).tolist()

    return docs.withColumn(out, text_scores(F.col("text"), work))


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id held_out score predicted`` for every row.

    Labels are learnt outside the held-out third only; scores read nothing but the text.
    Empty and null texts get the score of a text without n-grams; repeated rows get
    equal scores; a null doc_id counts as not held out.
    """
    rows = scored(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), fit(docs, labels))
    return rows.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def remove_toxic(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows with a score below ``threshold``, with all their columns."""
    name = free_name(docs, "_toxicity")
    return scored(docs, fit(docs, labels), name).filter(F.col(name) < threshold).drop(name)
