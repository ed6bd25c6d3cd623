"""BPE encoding and decoding by dynamic programming over prefixes.

For every prefix of a word exactly one token can be the last of its encoding: among the
vocabulary entries that end there (found by an automaton that reports all suffixes in
the vocabulary), the one that is compatible with the last token of the prefix before it.
Back-pointers from the full word then give the ids; no merge is ever simulated.
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Callable, Iterator
from functools import cache
from itertools import chain

import ahocorasick
import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_NEVER = 1 << 60
#: What a cached word takes besides its letters and ids: two objects and their slots.
_ENTRY_BYTES = 200
_SPACES = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_CHUNK = regex.compile(f"[^{_SPACES}]+")
_SEPARATORS = regex.compile("[\x1c-\x1f]")
WORD = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|\p{{L}}+|\p{{N}}|[^{_SPACES}\p{{L}}\p{{N}}]+")


def byte_letters() -> list[str]:
    """The letter that stands for each byte: itself if visible in Latin-1, else a spare one."""
    visible = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in visible else chr(next(spare)) for b in range(256)]


class Recent(dict):
    """Values of a function for recently used keys: two generations of ``size`` bytes each.

    Bytes are estimated from the lengths of key and value.
    """

    def __init__(self, make: Callable, size: int):
        super().__init__()
        self.make, self.size, self.older, self.held = make, size, {}, 0

    def __missing__(self, key):
        value = self.older.get(key)
        if value is None:
            value = self.make(key)
        own = _ENTRY_BYTES + len(key) + 8 * len(value)
        if self.held + own > self.size and self.held:
            self.older, self.held = dict(self), 0
            self.clear()
        self[key] = value
        self.held += own
        return value


def text_pieces(text: str) -> Iterator[list[str]]:
    """What stands between white space, in lists of bounded size."""
    if _SEPARATORS.search(text):  # str.split takes these for white space
        yield _CHUNK.findall(text)
        return
    start, step = 0, 1 << 20
    while len(text) - start > step:
        cut = text.find(" ", start + step)
        if cut < 0:
            break
        yield text[start:cut].split()
        start = cut
    yield text[start:].split()


def pre_tokens(piece: str) -> list[str]:
    """The normalised words of what stands between white space."""
    if piece.isascii():
        piece = piece.lower()
    else:
        piece = "".join(map(str.lower, unicodedata.normalize("NFC", piece)))
    return [piece] if piece.isalpha() else WORD.findall(piece)


def read_spec(path: str) -> dict:
    with open(path, encoding="utf-8") as file:
        return json.load(file)


def token_names(path: str) -> dict[int, str]:
    """The text of every id: in byte letters, with word ends."""
    spec = read_spec(path)
    names = {i: t for t, i in spec["model"]["vocab"].items()}
    return names | {t["id"]: t["content"] for t in spec.get("added_tokens", [])}


#: Words that a worker process keeps, in both caches and both of their generations.
CACHE_BYTES = 160 << 20


class WordBpe:
    """Vocabulary and merges of a tokenizer file of the kind "BPE with word ends".

    Text is put in normal form C, lower-cased letter by letter and cut into words; white
    space is dropped. Special tokens in a text stand for themselves.
    """

    def __init__(self, path: str, cache_bytes: int = CACHE_BYTES):
        spec = read_spec(path)
        model = spec["model"]
        if model["type"] != "BPE" or not model.get("end_of_word_suffix"):
            raise ValueError("not a BPE vocabulary with word ends")
        end = model["end_of_word_suffix"]
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self._special = regex.compile("|".join(map(regex.escape, self.special)) or r"(?!)")
        self.letters = byte_letters()
        # The end of a word becomes one character, so that a token's length is its cover.
        self._end = "\x00"
        ids = {t.removesuffix(end) + self._end if t.endswith(end) else t: i for t, i in model["vocab"].items()
               if i not in self.special.values()}
        self._rank: dict[int, int] = {}
        self._parts: dict[int, tuple[int, int]] = {}
        self._merge: dict[tuple[int, int], int] = {}
        for rank, pair in enumerate(model["merges"]):
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            whole = model["vocab"][left + right]
            pair = model["vocab"][left], model["vocab"][right]
            self._merge.setdefault(pair, rank)
            if whole not in self._rank:
                self._rank[whole], self._parts[whole] = rank, pair
        self._fits: dict[tuple[int, int], bool] = {}
        self._whole: dict[int, bool] = {}
        self._edges: tuple[dict, dict] = ({}, {})
        self._automaton = ahocorasick.Automaton()
        for text, i in ids.items():
            if len(text.removesuffix(self._end)) == 1 or self._reachable(i):
                self._automaton.add_word(text, (i, len(text)))
        self._automaton.make_automaton()
        self.words = Recent(self._encode_word, cache_bytes // 4)
        self.chunks = Recent(self._encode_chunk, cache_bytes // 4)

    def _edge(self, token: int, side: int) -> list[tuple[int, int]]:
        """Parts along one edge, smallest first, each with the rank at which it grows."""
        found = self._edges[side].get(token)
        if found is None:
            parts = self._parts.get(token)
            below = [] if parts is None else self._edge(parts[side], side)
            found = [*below[:-1], (below[-1][0], self._rank[token])] if below else []
            found.append((token, _NEVER))
            self._edges[side][token] = found
        return found

    def _apart(self, left: int, right: int, limit: int = _NEVER) -> bool:
        """Whether no merge below rank ``limit`` joins the edges while both tokens grow.

        Each part along an edge lives from its own rank to that of the next. A merge of
        two parts that live at once comes first if its rank is below the next of the left
        part, and not above the next of the right one (of equal merges the leftmost wins).
        """
        lefts, rights = iter(self._edge(left, 1)), iter(self._edge(right, 0))
        (part, grows), (other, grows_too) = next(lefts), next(rights)
        while True:
            merge = self._merge.get((part, other), _NEVER)
            if merge < limit and merge < grows and merge <= grows_too:
                return False
            if grows == grows_too == _NEVER:
                return True
            if grows <= grows_too:
                part, grows = next(lefts)
            else:
                other, grows_too = next(rights)

    def _reachable(self, token: int) -> bool:
        """Whether the token is the encoding of its own text."""
        found = self._whole.get(token)
        if found is None:
            parts = self._parts.get(token)
            found = parts is None or (
                self._reachable(parts[0]) and self._reachable(parts[1]) and self._apart(*parts, self._rank[token])
            )
            self._whole[token] = found
        return found

    def _compatible(self, left: int, right: int) -> bool:
        if len(self._fits) > 400_000:
            self._fits.clear()
        found = self._fits[left, right] = self._apart(left, right)
        return found

    def _encode_word(self, word: str) -> tuple[int, ...]:
        if word.isascii() and word.isprintable():
            text = word + self._end
        else:
            text = "".join([self.letters[b] for b in word.encode("utf-8", "replace")]) + self._end
        size = len(text)
        last, back = [-1] * (size + 1), [0] * (size + 1)
        last[0] = -2
        last[size - 1] = -3  # the last letter only counts together with the word's end
        fits = self._fits
        for at, (token, length) in self._automaton.iter(text):
            at += 1
            if last[at] != -1 or (before := last[at - length]) == -1 or before == -3:
                continue
            if before != -2:
                good = fits.get((before, token))
                if not (self._compatible(before, token) if good is None else good):
                    continue
            last[at], back[at] = token, at - length
        ids, at = [], size
        while at > 0:
            ids.append(last[at])
            at = back[at]
        return tuple(ids[::-1])

    def _encode_chunk(self, chunk: str) -> tuple[int, ...]:
        words = pre_tokens(chunk)
        if len(words) == 1:
            return self.words[words[0]]
        return tuple(i for w in words for i in self.words[w])

    def _encode_plain(self, text: str) -> list[int]:
        ids = []
        for pieces in text_pieces(text):
            ids += chain.from_iterable(map(self.chunks.__getitem__, pieces))
        return ids

    def encode(self, text: str | None) -> np.ndarray:
        """The ids of a text; a null is empty."""
        text = text or ""
        if "<" not in text or not self._special.search(text):
            return np.array(self._encode_plain(text), dtype=np.int32)
        ids, at = [], 0
        for match in self._special.finditer(text):
            ids += self._encode_plain(text[at : match.start()])
            ids.append(self.special[match[0]])
            at = match.end()
        ids += self._encode_plain(text[at:])
        return np.array(ids, dtype=np.int32)


@cache
def worker_bpe(path: str) -> WordBpe:
    """One encoder per worker process, so that later tasks find its words."""
    return WordBpe(path)


@cache
def worker_names(path: str) -> dict[int, str]:
    return token_names(path)


def encode(docs: DataFrame, path: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """``docs`` with the ids of ``text`` as an array of integers.

    The whole text is encoded, however long, in pieces; a null or empty text has no ids.
    Distinct words are encoded once per worker process as long as they stay in a cache of
    ``CACHE_BYTES``. ``path`` must exist on every node. Other columns are passed on.
    """

    def encoded(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        bpe = worker_bpe(path)
        for batch in batches:
            yield pd.Series([bpe.encode(t) for t in batch], dtype=object)

    return docs.withColumn(ids, F.pandas_udf(encoded, "array<int>")(F.col(text)))


def decode(docs: DataFrame, path: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """``docs`` with the text of the ids, as token texts with blanks between; a null gives a null."""

    def decoded(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        name = worker_names(path).__getitem__
        for batch in batches:
            yield pd.Series([None if row is None else " ".join(map(name, row.tolist())) for row in batch], dtype=object)

    return docs.withColumn(out, F.pandas_udf(decoded, "string")(F.col(ids)))
