"""Language by cross-parsing: a text is cut into the longest phrases that occur in a
language's sample, found with the sample's suffix automaton; the language that
describes the text with the fewest bits for its phrases wins.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from maskwright.llm.common import hash_order, id_and_bytes, map_batches, texts

#: Characters of labelled text per language: whole texts, the first in a hashed order that fit.
SAMPLE_CHARS = 20_000
CANDIDATES = 64
BLOCK = 256
_OTHER = re.compile(r"[\W\d_]+")


def normalise(text: str) -> str:
    """Lower-cased letters; runs of anything else are one blank."""
    return _OTHER.sub(" ", text.lower()).strip()


def automaton(codes: list[int], width: int) -> np.ndarray:
    """Transitions (state, code) of the suffix automaton of a sequence; -1 where none."""
    after, link, length, last = [{}], [-1], [0], 0
    for c in codes:
        now = len(after)
        after.append({})
        link.append(0)
        length.append(length[last] + 1)
        p = last
        while p >= 0 and c not in after[p]:
            after[p][c] = now
            p = link[p]
        if p >= 0:
            q = after[p][c]
            if length[p] + 1 == length[q]:
                link[now] = q
            else:
                copy = len(after)
                after.append(dict(after[q]))
                link.append(link[q])
                length.append(length[p] + 1)
                while p >= 0 and after[p].get(c) == q:
                    after[p][c] = copy
                    p = link[p]
                link[q] = link[now] = copy
        last = now
    table = np.full((len(after), width), -1, np.int32)
    for state, moves in enumerate(after):
        for c, to in moves.items():
            table[state, c] = to
    return table


def phrases(table: np.ndarray, blocks: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Phrases of each block: column ``j`` of ``blocks`` holds ``sizes[j]`` codes, sizes descending.

    All blocks step together. Where no transition goes on, a phrase ends and the next starts with
    this character; one that the sample lacks is a phrase of its own.
    """
    flat, width = table.ravel(), table.shape[1]
    state, count = np.zeros(len(sizes), np.int64), (sizes > 0).astype(np.int64)
    active = np.searchsorted(-sizes, -np.arange(1, blocks.shape[0] + 1), side="right")
    for i, n in enumerate(active.tolist()):
        if not n:
            break
        code = blocks[i, :n]
        to = flat.take(state[:n] * width + code)
        ends = np.flatnonzero(to < 0)
        if len(ends):
            # a state of 0 has no open phrase to end
            count[ends] += state[ends] != 0
            again = flat.take(code[ends])
            count[ends[again < 0]] += 1
            to[ends] = np.maximum(again, 0)
        state[:n] = to
    return count


def held_out() -> Column:
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def learn(docs: DataFrame, chars: int = SAMPLE_CHARS) -> dict:
    """Automata per language from whole labelled texts of at most ``chars`` characters together.

    Of the first ``CANDIDATES`` texts that fit a quarter of the sample, in a hashed order, those
    that still fit are taken; a language with longer texts only gives its shortest one.
    """
    size = F.char_length(F.col("text").cast("string"))
    known = docs.filter(F.col("text").isNotNull() & F.col("lang").isNotNull() & ~held_out() & (size > 0)).select(
        F.col("lang").cast("string").alias("lang"), F.col("doc_id").cast("long").alias("doc_id"), size.alias("size")
    )
    order = Window.partitionBy("lang").orderBy(F.when(F.col("size") <= chars // 4, 0).otherwise(F.col("size")), hash_order(5, "doc_id"), "doc_id", "size")
    first = known.withColumn("nth", F.row_number().over(order)).filter(F.col("nth") <= CANDIDATES).orderBy("lang", "nth").collect()
    taken: dict[str, list] = {}
    used: dict[str, int] = {}
    for r in first:
        if r["nth"] == 1 or used[r["lang"]] + r["size"] <= chars:
            taken.setdefault(r["lang"], []).append(r["doc_id"])
            used[r["lang"]] = used.get(r["lang"], 0) + r["size"]
    wanted = [i for ids in taken.values() for i in ids if i is not None]
    # one text per id and language, so that the bound holds where ids repeat
    one = docs.filter(F.col("doc_id").isin(wanted) & (size > 0)).groupBy("doc_id", "lang").agg(F.min(F.struct(size.alias("size"), "text"))["text"].alias("text"))
    rows = one.collect() if wanted else []
    parts: dict[str, list[str]] = {lang: [] for lang in sorted(taken)}
    for r in sorted(rows, key=lambda r: (r["lang"] or "", r["doc_id"], r["text"] or "")):
        if r["lang"] in parts and r["doc_id"] in taken[r["lang"]] and r["text"]:
            parts[r["lang"]].append(normalise(r["text"]))
    samples = {lang: " ".join(p) for lang, p in parts.items() if any(p)}
    alphabet = {c: i + 1 for i, c in enumerate(sorted(set("".join(samples.values()))))}
    width = len(alphabet) + 1
    tables = [automaton([alphabet[c] for c in t], width) for t in samples.values()]
    bits = [float(np.log2(max(2, len(t)))) for t in samples.values()]
    return {"langs": list(samples), "alphabet": alphabet, "tables": tables, "bits": bits}


def languages(docs: DataFrame, chars: int = SAMPLE_CHARS) -> DataFrame:
    """``doc_id held_out lang_pred score`` for every row.

    Learns from ``text`` and non-null ``lang`` outside the held-out quarter; predictions read
    the text alone, whole, in blocks of ``BLOCK`` characters. ``score`` is the winner's share under
    the phrases' code lengths. ``und`` with score 0 where the text is null or has no
    letter, or nothing could be learnt. Ties go to the first language by name. A null
    doc_id counts as not held out.
    """
    model = learn(docs, chars)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def work(batch: pa.RecordBatch) -> dict:
        m = shared.value
        table = np.zeros(1 << 16, np.int64)
        for c, i in m["alphabet"].items():
            table[min(ord(c), 0xFFFF)] = i
        plain = [normalise(t) for t in texts(batch.column("text"))]
        coded = [table[np.minimum(np.frombuffer(p.encode("utf-32-le", "replace"), np.uint32), 0xFFFF)] for p in plain]
        cuts = [(d, c[i : i + BLOCK]) for d, c in enumerate(coded) for i in range(0, len(c), BLOCK)]
        cuts.sort(key=lambda x: -len(x[1]))
        sizes = np.array([len(c) for _, c in cuts], np.int64)
        blocks = np.zeros((BLOCK, len(cuts)), np.int64)
        for j, (_, c) in enumerate(cuts):
            blocks[: len(c), j] = c
        owner = np.array([d for d, _ in cuts], np.int64)
        cost = np.stack([np.bincount(owner, phrases(t, blocks, sizes), len(plain)) * b for t, b in zip(m["tables"], m["bits"])], 1) if m["langs"] and len(cuts) else np.zeros((len(plain), 1))
        best = cost.argmin(axis=1)
        share = 1 / np.exp2(np.minimum(cost.min(axis=1, keepdims=True) - cost, 0)).sum(axis=1)
        letters = [any(map(str.isalpha, p)) and bool(m["langs"]) for p in plain]
        return {
            "doc_id": batch.column("doc_id"),
            "lang_pred": [m["langs"][b] if ok else "und" for b, ok in zip(best, letters)],
            "score": [float(s) if ok else 0.0 for s, ok in zip(share, letters)],
        }

    rows = map_batches(id_and_bytes(docs), work, "doc_id long, lang_pred string, score double")
    return rows.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
