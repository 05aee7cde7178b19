"""Token ids of whole texts through the tokenizers library, each remembered word encoded once."""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np

_WORDS = re.compile(r"[^ \n\r\t]+")
#: What the short way must not see: anything but printable ASCII and the letters of
#: Latin-1, and what may open a special token.
_ODD = re.compile(r"[^\x21-\x7e\xc0-\xff]|<\|")
#: The tokenizer's own pre-token pattern, for the characters of the short way in lower case.
_UNITS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z\xdf-\xf6\xf8-\xff]+|[0-9]|[^a-z\xdf-\xf6\xf8-\xff0-9]+")


#: Characters of texts that are looked up together.
GROUP = 1_000_000
#: Words that an encoder remembers, and characters of them for each.
WORDS, WORD_CHARS = 400_000, 32
#: Rules under which a text's ids are those of its blank-separated words: blanks are no part of
#: any pre-token, and the short way knows the letters' lower case.
_BLANK_RULES = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {"type": "Sequence", "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ]},
}
#: Encoders of this worker process, by tokenizer file.
_ENCODERS: dict[str, WordEncoder] = {}


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class WordEncoder:
    """Encode texts word by word and remember each word's ids.

    Where the tokenizer's rules never join text across a blank, the ids of a text are those of
    its blank-separated words in turn. A word of printable ASCII and Latin-1 letters is
    lower-cased, cut into pre-tokens and given to the library's model, many at a time; any other
    text keeps its words as they are, and those with other characters go through the
    whole tokenizer. A tokenizer with other rules (read from its file, not its name) encodes
    whole texts.

    Past ``most`` words, or ``WORD_CHARS`` characters for each, the memory keeps the words seen
    again since they were learnt, the commonest first and up to half of it. Rare
    words, whose number grows with the corpus, so never push out common ones.
    """

    def __init__(self, path: str, most: int = WORDS):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer, self.most = Tokenizer.from_file(path), most
        rules = json.loads(self.tokenizer.to_str())
        self.by_word = all(rules[k] == v for k, v in _BLANK_RULES.items()) and rules["model"].get("end_of_word_suffix") == "</w>"
        self.model = Tokenizer(self.tokenizer.model)
        self.model.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        vocabulary = self.tokenizer.get_vocab()
        self.closes = np.zeros(max(vocabulary.values()) + 1, bool)
        self.closes[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        bytes_of = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.as_bytes = {c: bytes_of.pre_tokenize_str(chr(c))[0][0] for c in range(0xC0, 0x100)}
        self.index: dict[str, int] = {"": 0}
        self.flat, self.used, self.chars = np.zeros(1 << 16, np.uint32), 0, 0
        self.at, self.n, self.seen = (np.zeros(1 << 14, np.int64) for _ in range(3))

    @classmethod
    def shared(cls, path: str) -> WordEncoder:
        """One encoder per worker process, for all its tasks."""
        import maskwright.llm.tokens as home  # the imported module, also where this class was shipped by value

        if path not in home._ENCODERS:
            home._ENCODERS[path] = cls(path)
        return home._ENCODERS[path]

    def _forget_rare(self) -> None:
        """Keep the words seen again, at most half of the memory's words and characters."""
        words = list(self.index)
        seen = self.seen[: len(words)]
        order = np.argsort(-seen, kind="stable")
        order = order[(seen[order] > 1) & (order > 0)][: self.most // 2]
        sizes = np.fromiter((len(words[i]) for i in order), np.int64, len(order))
        order = order[np.cumsum(sizes) <= self.most * WORD_CHARS // 2]
        keep = np.concatenate([[0], np.sort(order)])
        size = self.n[keep]
        ends = np.cumsum(size)
        flat = self.flat[np.repeat(self.at[keep] - ends + size, size) + np.arange(int(ends[-1]))]
        self.index = {words[i]: k for k, i in enumerate(keep.tolist())}
        self.chars, self.used = sum(map(len, self.index)), len(flat)
        self.flat = np.zeros(max(1 << 16, 2 * len(flat)), np.uint32)
        self.flat[: self.used] = flat
        room = max(1 << 14, 2 * len(keep))
        held = [ends - size, size, seen[keep] // 2]
        self.at, self.n, self.seen = (np.concatenate([h, np.zeros(room - len(h), np.int64)]) for h in held)

    def _encode_units(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pre-tokens in turn and how many each has: the model marks where each of a joined line ends."""
        cuts = [units[k : k + 256] for k in range(0, len(units), 256)]
        lines = [" ".join(u if u.isascii() else u.translate(self.as_bytes) for u in some) for some in cuts]
        ids, sizes = [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)]
        for some, got in zip(cuts, self.model.encode_batch_fast(lines, add_special_tokens=False)):
            line = np.array(got.ids, np.uint32)
            ends = np.flatnonzero(self.closes[line]) + 1
            if len(ends) != len(some):
                each = [self.tokenizer.encode(u, add_special_tokens=False).ids for u in some]
                line, ends = np.array([i for e in each for i in e], np.uint32), np.cumsum([len(e) for e in each])
            ids.append(line)
            sizes.append(np.diff(ends, prepend=0))
        return np.concatenate(ids), np.concatenate(sizes)

    def _encode(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of new lower-case words without odd characters, in turn, and how many each has."""
        cut = [[w] if w.isalpha() else _UNITS.findall(w) for w in words]
        ids, sizes = self._encode_units(list(chain.from_iterable(cut)))
        ends = np.concatenate([[0], np.cumsum(sizes)])[np.cumsum([0, *map(len, cut)])]
        return ids, np.diff(ends)

    def _learn(self, new: list[str], odd: set[str], plain: bool) -> None:
        """Remember new words; ``plain`` words are in lower case and hold no odd characters."""
        if odd:
            new = [*(w for w in new if w not in odd), *odd]
        easy = new[: len(new) - len(odd)]
        flat, sizes = self._encode(easy if plain else [w.lower() for w in easy])
        if odd:
            whole = [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(new[len(easy) :], add_special_tokens=False)]
            flat, sizes = np.concatenate([flat, *whole]), np.concatenate([sizes, [len(w) for w in whole]])
        first, total = len(self.index), len(flat)
        while self.used + total > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while first + len(new) > len(self.at):
            self.at, self.n, self.seen = (np.concatenate([x, np.zeros_like(x)]) for x in (self.at, self.n, self.seen))
        self.flat[self.used : self.used + total] = flat
        self.at[first : first + len(new)] = self.used + np.cumsum(sizes) - sizes
        self.n[first : first + len(new)] = sizes
        self.used += total
        self.chars += sum(map(len, new))
        self.index.update(zip(new, range(first, first + len(new))))

    def numbers(self, texts: list[str]) -> list[np.ndarray]:
        """The numbers of each text's words in this encoder's memory."""
        if len(self.index) > self.most or self.chars > self.most * WORD_CHARS:
            self._forget_rare()
        words = [t.lower().replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ") for t in texts]
        new = set().union(*words).difference(self.index)
        odd = {w for w in new if _ODD.search(w)}
        if not odd:
            return self._numbers(words, True, new)
        # odd words are never learnt in lower case, so their texts always come this way
        again = [i for i, ws in enumerate(words) if not odd.isdisjoint(ws)]
        skip = set(again)
        easy = [i for i in range(len(texts)) if i not in skip]
        found = dict(zip(easy, self._numbers([words[i] for i in easy], True)))
        found.update(zip(again, self._numbers([_WORDS.findall(texts[i]) for i in again], False)))
        return [found[i] for i in range(len(texts))]

    def _numbers(self, words: list[list[str]], plain: bool, new: set[str] | None = None) -> list[np.ndarray]:
        new = list(set().union(*words).difference(self.index) if new is None else new)
        if new:
            self._learn(new, set() if plain else {w for w in new if _ODD.search(w)}, plain)
        of = self.index.__getitem__
        numbers = [np.fromiter(map(of, ws), np.int64, len(ws)) for ws in words]
        for some in numbers:
            np.add.at(self.seen, some, 1)
        return numbers

    def ids(self, texts: list[str]) -> Iterator[np.ndarray]:
        """All ids of each text, without special tokens; texts are taken together up to ``GROUP`` characters."""
        held, size = [], 0
        for text in texts:
            held.append(text)
            size += len(text)
            if size > GROUP:
                yield from self._ids(held)
                held, size = [], 0
        yield from self._ids(held)

    def _ids(self, texts: list[str]) -> Iterator[np.ndarray]:
        if not self.by_word:
            for found in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False):
                yield np.array(found.ids, np.uint32)
            return
        for numbers in self.numbers(texts):
            sizes = self.n[numbers]
            ends = np.cumsum(sizes)
            total = int(ends[-1]) if len(ends) else 0
            yield self.flat[np.repeat(self.at[numbers] - ends + sizes, sizes) + np.arange(total)]

    def counts(self, texts: list[str]) -> list[int]:
        """How many ids each text has."""
        if not self.by_word:
            return [len(e.ids) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        return [int(self.n[numbers].sum()) for numbers in self.numbers(texts)]
