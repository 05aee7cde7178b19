"""Token counts that follow edits.

A text's blank-separated pieces are grouped into leaves of ``LEAF`` pieces; a segment
tree over the leaves keeps sums of characters and tokens. An edit finds the leaves it
touches by descending the tree, re-encodes only the pieces that the edit reaches, out to the
next blank on either side, and updates the sums on the way up. Blanks always end a
token, so nothing further away can change.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from maskwright.llm.common import id_and_bytes, map_batches, texts
from maskwright.llm.tokens import WordEncoder, default_tokenizer

LEAF = 32
_BLANK = " \n\r\t"


class SegmentTree:
    """Sums of (characters, tokens) over the leaves of one text."""

    def __init__(self, chars: Sequence[int], tokens: Sequence[int]):
        self.leaves = max(1, len(chars))
        self.size = 1 << (self.leaves - 1).bit_length()
        self.sums = np.zeros((2 * self.size, 2), np.int64)
        self.sums[self.size : self.size + len(chars), 0] = chars
        self.sums[self.size : self.size + len(tokens), 1] = tokens
        for level in range(self.size.bit_length() - 1, 0, -1):
            low, high = 1 << (level - 1), 1 << level
            self.sums[low:high] = self.sums[2 * low : 2 * high : 2] + self.sums[2 * low + 1 : 2 * high : 2]

    @property
    def total(self) -> int:
        return int(self.sums[1, 1])

    def leaf_at(self, char: int) -> tuple[int, int]:
        """The leaf that holds a character and where that leaf begins."""
        node, before = 1, 0
        while node < self.size:
            node *= 2
            inside = int(self.sums[node, 0])
            if char >= before + inside and int(self.sums[node + 1, 0]):
                before += inside
                node += 1
        return node - self.size, before

    def set_leaf(self, leaf: int, chars: int, tokens: int) -> None:
        node = leaf + self.size
        change = np.array([chars, tokens]) - self.sums[node]
        while node:
            self.sums[node] += change
            node //= 2


class CountedText:
    """A text with its tree. A leaf's text runs from its first piece to the next leaf's."""

    def __init__(self, text: str, encoder: WordEncoder):
        self.encoder, self.parts = encoder, self._leaves(text)
        self.tree = SegmentTree([len(p) for p in self.parts], encoder.counts(self.parts))
        self.encoded_chars = 0

    @staticmethod
    def _leaves(text: str) -> list[str]:
        from maskwright.llm.tokens import _WORDS

        starts = [m.start() for m in _WORDS.finditer(text)][::LEAF]
        bounds = [0, *starts[1:], len(text)]
        return [text[a:b] for a, b in zip(bounds, bounds[1:])]

    def edit(self, start: int, end: int, new: str) -> None:
        """Replace characters ``start`` to ``end`` (clipped to the text) with ``new``."""
        size = int(self.tree.sums[1, 0])
        start, end = min(max(start, 0), size), min(max(end, start, 0), size)
        first, before = self.tree.leaf_at(start)
        last, last_before = self.tree.leaf_at(end)
        old = "".join(self.parts[first : last + 1])
        left, right = start - before, end - before
        # context: the pieces that the edit cuts or touches
        low = left
        while low and old[low - 1] not in _BLANK:
            low -= 1
        high = right
        while high < len(old) and old[high] not in _BLANK:
            high += 1
        # a piece may begin in an earlier leaf only if this leaf's own start was edited away
        while low == 0 and first and (not self.parts[first - 1] or self.parts[first - 1][-1] not in _BLANK):
            first -= 1
            low = high_shift = len(self.parts[first])
            old = self.parts[first] + old
            left, right, high = left + high_shift, right + high_shift, high + high_shift
            while low and old[low - 1] not in _BLANK:
                low -= 1
        # and it may run on into a later leaf if the blank between them was
        while high == len(old) and last + 1 < len(self.parts):
            last += 1
            old += self.parts[last]
            while high < len(old) and old[high] not in _BLANK:
                high += 1
        region = old[low:left] + new + old[right:high]
        known = int(self.tree.sums[self.tree.size + first : self.tree.size + last + 1, 1].sum())
        gone, come = self.encoder.counts([old[low:high], region])
        self.encoded_chars += len(region) + high - low
        merged = old[:low] + region + old[high:]
        for leaf in range(first + 1, last + 1):
            self.parts[leaf] = ""
            self.tree.set_leaf(leaf, 0, 0)
        self.parts[first] = merged
        self.tree.set_leaf(first, len(merged), known - gone + come)


def count_with_edits(docs: DataFrame, edits: Column, tokenizer: str | None = None) -> DataFrame:
    """Token counts of each text before and after its edits, which apply one after another.

    ``edits`` gives ``array<struct<start: int, stop: int, new: string>>`` in characters of the
    text as it is by then; null or empty means none, positions beyond the text are
    clipped. Returns ``doc_id n_edits tokens_before tokens_after chars_after text_crc32
    leaves encoded_chars``: the last is what the edits had encoded. Null texts are empty. One map, no
    shuffle; a row holds one text.
    """
    path = tokenizer or default_tokenizer()
    rows = docs.select(
        F.col("doc_id").cast("long"),
        F.col("text").cast("string").cast("binary").alias("text"),
        edits.cast("array<struct<start: int, stop: int, new: string>>").alias("edits"),
    )
    state: list[WordEncoder] = []

    def work(batch: pa.RecordBatch) -> dict:
        import zlib

        if not state:
            state.append(WordEncoder.shared(path))
        out: dict[str, list] = {k: [] for k in SCHEMA_NAMES}
        every = zip(batch.column("doc_id").to_pylist(), texts(batch.column("text")), batch.column("edits").to_pylist())
        for doc, text, changes in every:
            counted = CountedText(text, state[0])
            before, changes = counted.tree.total, [c for c in changes or [] if c]
            for c in changes:
                counted.edit(c["start"] or 0, c["stop"] or 0, c["new"] or "")
            after = "".join(counted.parts)
            values = (
                doc, len(changes), before, counted.tree.total, len(after), zlib.crc32(after.encode("utf-8", "replace")),
                counted.tree.leaves, counted.encoded_chars,
            )
            for k, v in zip(out, values):
                out[k].append(v)
        return out

    SCHEMA_NAMES = ("doc_id", "n_edits", "tokens_before", "tokens_after", "chars_after", "text_crc32", "leaves", "encoded_chars")
    return map_batches(rows, work, ", ".join(f"{n} long" for n in SCHEMA_NAMES))


def revision_edits(text: Column) -> Column:
    """Three edits that any text has: its second tenth loses half its characters, a word from
    its middle is put in at one third, and a line is added at the end."""
    n = F.coalesce(F.length(text), F.lit(0))
    tenth = F.floor(n / 10).cast("int")
    edit = lambda a, b, s: F.struct(
        a.cast("int").alias("start"), b.cast("int").alias("stop"), s.alias("new")
    )
    word = F.coalesce(F.substring(text, F.floor(n / 2).cast("int") + 1, F.lit(7)), F.lit(""))
    return F.array(
        edit(tenth, tenth + F.floor(tenth / 2), F.lit("")),
        edit(F.floor(n / 3), F.floor(n / 3), word),
        edit(n, n, F.lit("\nEnd of revision.")),
    )


def recount(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """Token counts of whole texts, encoded anew."""
    path = tokenizer or default_tokenizer()
    state: list[WordEncoder] = []

    def work(batch: pa.RecordBatch) -> dict:
        if not state:
            state.append(WordEncoder.shared(path))
        counts = [len(ids) for ids in state[0].ids(texts(batch.column("text")))]
        return {"doc_id": batch.column("doc_id"), "n_tokens": counts}

    return map_batches(id_and_bytes(docs), work, "doc_id long, n_tokens long")
