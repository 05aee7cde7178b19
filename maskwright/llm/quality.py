"""Quality without hand labels: heuristic labellers, their accuracies by expectation
maximisation, and a hashed linear scorer trained on the posterior labels.
"""

from __future__ import annotations

import unicodedata
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from maskwright.llm.common import free_name, hash_order, id_and_bytes, map_batches, text_scores, texts
from maskwright.llm.linear import fit_logistic
from maskwright.sources.staging import stage

LABELLERS = ("capitals", "capital_words", "marks", "marked_words", "letters", "repeats", "variety", "top_word", "sentences")
WIDTH = 1 << 13
#: The scorer is fitted on at most so many documents, the first in a hashed order.
FIT_ROWS = 4_000
THRESHOLD = 0.5
_UPPER, _LETTER, _DIGIT, _BLANK, _LINE, _POINT, _MARK = range(7)
_CLASSES = np.zeros(0, np.uint8)
POINTS = ".,;:'’\"()-?"


def _classes() -> np.ndarray:
    """Character class per code point of the basic plane; sentence marks apart from other symbols."""
    global _CLASSES
    if not len(_CLASSES):
        kinds = {"Lu": _UPPER, "Lt": _UPPER, "Nd": _DIGIT, "Zs": _BLANK}
        found = np.full(1 << 16, _MARK, np.uint8)
        for c in range(1 << 16):
            kind = unicodedata.category(chr(c))
            found[c] = kinds.get(kind, _LETTER if kind[0] in "LMC" else _MARK)
        found[[ord(c) for c in POINTS]] = _POINT
        found[[9, 32, 160]] = _BLANK
        found[[10, 13]] = _LINE
        _CLASSES = found
    return _CLASSES


def shape(text: str) -> np.ndarray:
    codes = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)
    return _classes()[np.minimum(codes, 0xFFFF)]


def votes(text: str) -> list[int]:
    """One vote per labeller: 1 good, 0 bad, -1 none. Labellers overlap: each kind of damage is seen by several."""
    count, words = np.bincount(shape(text), minlength=7), text.split()
    letters, inked, n = count[_UPPER] + count[_LETTER], count[[_UPPER, _LETTER, _DIGIT, _POINT, _MARK]].sum(), max(1, len(words))
    vote = lambda value, good, bad, enough: -1 if not enough else 1 if value <= good else 0 if value >= bad else -1
    chunks = [words[i : i + 100] for i in range(0, len(words), 100)]
    marked = sum(not (w[-1].isalnum() or w[-1] in POINTS) for w in words) if count[_MARK] else 0
    closed = sum(w[-1] in ".!?" for w in words)
    return [
        vote(count[_UPPER] / max(1, letters), 0.25, 0.5, letters >= 10),
        vote(sum(map(str.isupper, words)) / n, 0.15, 0.5, n >= 4),
        vote(count[_MARK] / max(1, inked), 0.03, 0.06, inked >= 10),
        vote(marked / n, 0.1, 0.3, n >= 4),
        vote(1 - letters / max(1, inked), 0.12, 0.16, inked >= 10),
        vote(sum(map(str.__eq__, words, words[1:])) / n, 0.08, 0.3, n >= 6),
        vote(1 - sum(len(set(c)) for c in chunks) / n, 0.6, 0.75, n >= 20),
        vote(sum(max(Counter(c).values()) for c in chunks) / n, 0.2, 0.35, n >= 20),
        vote(abs(closed / n - 0.17), 0.165, 0.3, n >= 30),
    ]


def accuracies(patterns: list[tuple[list[int], int]], rounds: int = 200) -> tuple[np.ndarray, np.ndarray]:
    """How often each labeller votes what on good documents and on each kind of poor ones, by
    expectation maximisation over counted vote patterns (three to the power of labellers at most).

    Class 0 is good. Poor documents are poor in different ways, and a labeller sees only
    some of them, so there is one class per labeller, which starts from the documents that it and
    another one reject. Returns the classes' shares and probabilities (class, labeller, vote + 1).
    """
    vote = np.array([p for p, _ in patterns], np.int64).reshape(len(patterns), -1)
    count = np.array([c for _, c in patterns], np.float64)
    bad = vote == 0
    start = np.concatenate([(bad.sum(axis=1, keepdims=True) < 2), bad & (bad.sum(axis=1, keepdims=True) >= 2)], axis=1)
    post = start / start.sum(axis=1, keepdims=True)
    for _ in range(rounds):
        weight = post.T * count
        share = (weight.sum(axis=1) + 1e-3) / (weight.sum() + 1e-3 * len(weight))
        table = np.array([[np.bincount(vote[:, j] + 1, w, 3) + 0.1 for j in range(vote.shape[1])] for w in weight])
        table /= table.sum(axis=2, keepdims=True)
        new = _classes_given(vote, share, table)
        if np.abs(new - post).max() < 1e-7:
            break
        post = new
    return share, table


def _classes_given(vote: np.ndarray, share: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Probability of each class per row of votes; a vote that is not cast says nothing."""
    given = table[:, :, 1:] / table[:, :, 1:].sum(axis=2, keepdims=True)
    logit = np.tile(np.log(share), (len(vote), 1))
    for j in range(vote.shape[1]):
        logit += np.where(vote[:, j, None] >= 0, np.log(given[:, j, :])[:, np.maximum(vote[:, j], 0)].T, 0.0)
    odds = np.exp(logit - logit.max(axis=1, keepdims=True))
    return odds / odds.sum(axis=1, keepdims=True)


def posterior(vote: np.ndarray, share: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Probability of good per row of votes."""
    return _classes_given(vote, share, table)[:, 0]


def features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Hashed features: shares of shape trigrams and of words equal to the last or seen shortly before."""
    found = shape(text).astype(np.int64)
    index, value = [], []
    if len(found) >= 3:
        grams = np.bincount(found[:-2] * 64 + found[1:-1] * 8 + found[2:], minlength=512)
        at = np.flatnonzero(grams)
        index.append((at * 0x9E3779B1 >> 7) % WIDTH)
        value.append(np.sqrt(grams[at] / (len(found) - 2)))
    words = text.split()
    if words:
        chunks = [words[i : i + 100] for i in range(0, len(words), 100)]
        shares = [sum(a == b for a, b in zip(words, words[1:])) / len(words), 1 - sum(len(set(c)) for c in chunks) / len(words)]
        index.append((np.arange(600, 602) * 0x9E3779B1 >> 7) % WIDTH)
        value.append(np.sqrt(np.array(shares)))
    if not index:
        return np.zeros(0, np.int64), np.zeros(0)
    return np.concatenate(index), np.concatenate(value)


def vote_table(docs: DataFrame) -> DataFrame:
    def work(batch: pa.RecordBatch) -> dict:
        return {"doc_id": batch.column("doc_id"), "votes": [votes(t) for t in texts(batch.column("text"))]}

    return map_batches(id_and_bytes(docs), work, "doc_id long, votes array<int>")


def fit(docs: DataFrame, rows: int = FIT_ROWS) -> dict:
    """Accuracies from the votes on all documents, and the scorer's weights.

    Vote patterns are counted before they reach the driver. The scorer sees the first
    ``rows`` documents in a hashed order of ids with their posterior labels, in one task.
    """
    every = stage(vote_table(docs))
    counted = [(r["votes"], r["count"]) for r in every.groupBy("votes").count().collect()]
    if not counted:
        return {"weights": np.zeros(WIDTH), "bias": 0.0, "share": np.ones(1), "table": np.full((1, len(LABELLERS), 3), 1 / 3)}
    share, table = accuracies(counted)
    chosen = every.filter(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").alias("_id")).agg(F.min("votes").alias("votes"))
    chosen = chosen.orderBy(hash_order(7, "_id"), "_id").limit(rows)
    # one text per id, so that the bound holds where ids repeat
    few = id_and_bytes(docs).join(F.broadcast(chosen), F.col("doc_id") == F.col("_id"))
    few = few.groupBy("_id").agg(F.min("text").alias("text"), F.min("votes").alias("votes"))

    def describe(batch: pa.RecordBatch) -> dict:
        found = [features(t) for t in texts(batch.column("text"))]
        label = posterior(np.array(batch.column("votes").to_pylist(), np.int64).reshape(-1, len(LABELLERS)), share, table)
        return {"label": label, "at": [i.astype("<i4").tobytes() for i, _ in found], "value": [v.astype("<f8").tobytes() for _, v in found]}

    def train(pdf: pd.DataFrame) -> pd.DataFrame:
        index = [np.frombuffer(b, "<i4").astype(np.int64) for b in pdf["at"]]
        value = [np.frombuffer(b, "<f8") for b in pdf["value"]]
        weights, bias = fit_logistic(index, value, pdf["label"].to_numpy(), np.ones(len(pdf)), WIDTH, ridge=1e-5, rounds=300, rate=0.1)
        return pd.DataFrame({"weights": [weights.astype("<f8").tobytes()], "bias": [bias]})

    described = map_batches(few, describe, "label double, at binary, value binary").withColumn("one", F.lit(0))
    got = described.groupBy("one").applyInPandas(train, "weights binary, bias double").collect()  # one row
    weights, bias = (np.frombuffer(got[0]["weights"], "<f8"), got[0]["bias"]) if got else (np.zeros(WIDTH), 0.0)
    return {"weights": weights, "bias": bias, "share": share, "table": table}


def scored(docs: DataFrame, model: dict, out: str = "quality_score") -> DataFrame:
    """All columns and the scorer's probability of good for each row."""

    def work(some: list[str]) -> list[float]:
        z = [(model["weights"][index] * value).sum() + model["bias"] for index, value in map(features, some)]
        return (1 / (1 + np.exp(-np.clip(np.array(z), -40, 40)))).tolist()

    return docs.withColumn(out, text_scores(F.col("text"), work))


def quality(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id score good`` for every row; ``good`` is 1 from ``threshold`` on.

    Null and empty texts have no features and get the scorer's base rate; repeated rows
    get equal scores; rows with a null id are scored but not used for the fit.
    """
    rows = scored(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), fit(docs), "score")
    return rows.select("doc_id", "score", (F.col("score") >= threshold).cast("int").alias("good"))


def remove_poor(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows with a score of ``threshold`` or more, with all their columns."""
    name = free_name(docs, "_quality")
    return scored(docs, fit(docs), name).filter(F.col(name) >= threshold).drop(name)
