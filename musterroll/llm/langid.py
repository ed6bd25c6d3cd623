"""Language identification by string kernels.

The kernel of two texts is the cosine of their n-gram presence sets, blended over n-gram
lengths. N-grams are taken inside white-space separated, padded words, in lower case.
Landmarks give the Nyström feature map, and one ridge regression per language is solved
in it. Scoring is a product of presence rows, landmark rows and weights per batch.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from musterroll.llm.common import free_name

UNDETERMINED = "und"
_BLOCK = 1 << 18
_PARTS = 1_000_003
#: Entries of a table of n-grams.
_TABLE = 1 << 24


def word_ngrams(word: str, longest: int) -> set[str]:
    """All n-grams up to ``longest`` of the word between spaces; the space alone is none."""
    padded = f" {word} "
    grams = {padded[i : i + n] for n in range(1, longest + 1) for i in range(len(padded) - n + 1)}
    grams.discard(" ")
    return grams


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


class Presence:
    """Rows of n-gram presence over a fixed alphabet of n-grams.

    Characters of the alphabet are numbered, white space is one and all others are zero.
    An n-gram is then a number in that base, and a table gives its column (a sorted list,
    where many characters would make the table large); the last column takes all n-grams
    that are not in the alphabet, and is cut off.
    """

    def __init__(self, alphabet: dict[str, int], longest: int):
        self.longest, self.size = longest, len(alphabet)
        letters = sorted(set("".join(alphabet)) - {" "})
        self.code = np.zeros(max([0x3000, *map(ord, letters)]) + 2, dtype=np.int32)
        self.code[[c for c in range(len(self.code)) if chr(c).isspace()]] = 1
        for number, letter in enumerate(letters, 2):
            self.code[ord(letter)] = number
        self.base = len(letters) + 2
        self.tables, self.lists = {}, {}
        for n in range(1, longest + 1):
            own = {int(self._numbers(gram, n)[0]): column for gram, column in alphabet.items() if len(gram) == n}
            if self.base**n <= _TABLE:
                self.tables[n] = np.full(self.base**n, self.size, dtype=np.int32)
                self.tables[n][list(own)] = list(own.values())
            else:
                numbers = np.array([*sorted(own), np.iinfo(np.int64).max])
                self.lists[n] = numbers, np.array([*[own[k] for k in sorted(own)], self.size])

    def _columns(self, numbers: np.ndarray, n: int) -> np.ndarray:
        if n in self.tables:
            return self.tables[n][numbers]
        known, columns = self.lists[n]
        at = np.searchsorted(known, numbers)
        return np.where(known[at] == numbers, columns[at], self.size)

    def _numbers(self, text: str, n: int) -> np.ndarray:
        points = np.frombuffer(text.encode("utf-32-le", "replace"), dtype=np.uint32)
        codes = self.code[np.minimum(points, len(self.code) - 1)].astype(np.int64)
        numbers = codes[: len(codes) - n + 1].copy()
        for k in range(1, n):
            numbers *= self.base
            numbers += codes[k : len(codes) - n + 1 + k]
        return numbers

    def rows(self, texts: list[str]) -> np.ndarray:
        rows = np.zeros((len(texts), self.size + 1), dtype=np.float32)
        for row, text in zip(rows, texts, strict=True):
            padded = f" {text.lower()} "
            for start in range(0, len(padded), _BLOCK):
                block = padded[start : start + _BLOCK + self.longest - 1]
                for n in range(1, self.longest + 1):
                    row[self._columns(self._numbers(block, n), n)] = 1
        rows = rows[:, : self.size]
        norms = np.sqrt(rows.sum(axis=1, keepdims=True))
        return rows / np.maximum(norms, 1)


@dataclass(frozen=True)
class LanguageModel:
    """``weights`` maps kernel values with the landmarks to one value per language."""

    languages: list[str]
    alphabet: dict[str, int]
    longest: int
    landmarks: np.ndarray
    weights: np.ndarray
    sharpness: float = 6.0

    def values(self, rows: np.ndarray) -> np.ndarray:
        return (rows @ self.landmarks.T) @ self.weights

    def predict(self, presence: Presence, texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, score (a softmax of the regression values), and whether any n-gram is known."""
        if not self.languages:
            return [UNDETERMINED] * len(texts), np.zeros(len(texts)), np.zeros(len(texts), dtype=bool)
        rows = presence.rows(texts)
        values = self.values(rows) * self.sharpness
        odds = np.exp(values - values.max(axis=1, keepdims=True))
        best = odds.argmax(axis=1)
        scores = (odds.max(axis=1) / odds.sum(axis=1)).astype(np.float64)
        lettered = np.array([has_letter(t) for t in texts], dtype=bool)
        names = [self.languages[b] if ok else UNDETERMINED for b, ok in zip(best, lettered, strict=True)]
        return names, np.where(lettered, scores, 0.0), rows.any(axis=1)


def _alphabet(texts: list[str], longest: int, characters: int, size: int) -> Counter:
    """The most frequent n-grams of one language, made of its most frequent characters."""
    seen = Counter(g for t in texts for g in set().union(*(word_ngrams(w, longest) for w in set(t.lower().split()))))
    letters = sorted((g for g in seen if len(g) == 1), key=lambda g: (-seen[g], g))[:characters]
    known = {*letters, " "}
    ranked = sorted((g for g in seen if known.issuperset(g)), key=lambda g: (-seen[g], g))[:size]
    return Counter({g: seen[g] for g in ranked})


def fit(
    texts: list[str], langs: list[str], longest: int = 3, alphabet_size: int = 3000, landmarks: int = 32,
    characters: int = 1000, ridge: float = 1e-2, seed: int = 7, most_landmarks: int = 1024, most_ngrams: int = 60_000,
) -> LanguageModel:
    """``landmarks`` texts per language give the kernel, ``most_landmarks`` in all.

    Every language brings its own ``alphabet_size`` most frequent n-grams, made of its own
    most frequent ``characters``, into the alphabet; with many languages each brings an
    equal share of ``most_ngrams``.
    """
    languages = sorted(set(langs))
    if not languages:
        return LanguageModel([], {}, longest, np.zeros((0, 0), np.float32), np.zeros((0, 0), np.float32))
    chosen = np.random.default_rng(seed).permutation(len(texts))
    of_language: dict[str, list[int]] = {name: [] for name in languages}
    for i in chosen:
        of_language[langs[i]].append(i)
    each = max(1, min(landmarks, most_landmarks // len(languages)))
    marks = [i for name in languages for i in of_language[name][:each]]
    seen: Counter = Counter()
    share = max(1, min(alphabet_size, most_ngrams // len(languages)))
    for name in languages:
        seen += _alphabet([texts[i] for i in of_language[name][:landmarks]], longest, characters, share)
    alphabet = {g: i for i, g in enumerate(sorted(seen, key=lambda g: (-seen[g], g)))}
    marks = [marks[i] for i in np.linspace(0, len(marks) - 1, min(len(marks), most_landmarks)).astype(int)]
    presence = Presence(alphabet, longest)
    rows = presence.rows(texts)
    base = rows[marks]
    # Nyström map: kernel values times the inverse square root of the landmark kernel.
    size, axes = np.linalg.eigh((base @ base.T).astype(np.float64))
    keep = size > 1e-6 * size.max()
    half = axes[:, keep] / np.sqrt(size[keep])
    mapped = (rows @ base.T).astype(np.float64) @ half
    counts = Counter(langs)
    weight = np.array([len(langs) / len(languages) / counts[name] for name in langs])
    # One column per language, 1 for its own texts and -1 for the others.
    number = {name: i for i, name in enumerate(languages)}
    own = np.zeros((mapped.shape[1], len(languages)))
    weighted = mapped * weight[:, None]
    np.add.at(own.T, [number[name] for name in langs], weighted)
    target = 2 * own - weighted.sum(axis=0)[:, None]
    left = weighted.T @ mapped + ridge * len(langs) * np.eye(mapped.shape[1]) / mapped.shape[1]
    solved = half @ np.linalg.solve(left, target)
    return LanguageModel(languages, alphabet, longest, base, solved.astype(np.float32))


def training_sample(
    docs: DataFrame, text: str, lang: str, shares: dict[str, float], per_language: int, longest_text: int
) -> DataFrame:
    """At most ``per_language`` texts of each language, chosen by a hash of the text.

    The scan keeps a share of each language's texts that gives about three times that
    many, so the shuffle gets as much from a large table as from a small one, whichever
    language holds most rows; copies of a text are one.
    """
    share = F.element_at(F.create_map(*[F.lit(x) for pair in shares.items() for x in pair]), F.col("lang"))
    rows = docs.select(F.col(text).alias("text"), F.col(lang).alias("lang"), F.xxhash64(text).alias("h"))
    rows = rows.where(F.col("lang").isin(*shares) & (F.pmod("h", F.lit(_PARTS)) < share * _PARTS))
    rows = rows.where(F.length("text").between(1, longest_text) & F.col("text").rlike(r"\p{L}"))
    few = rows.groupBy("lang", "h").agg(F.min("text").alias("text"))
    order = Window.partitionBy("lang").orderBy("h")
    return few.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= per_language)


def fit_on(
    docs: DataFrame, text: str = "text", lang: str = "lang", keep: Column | None = None,
    per_language: int = 300, longest_text: int = 20_000, rows: int = 20_000, **options,
) -> LanguageModel:
    """Fit on a bounded sample of labelled rows that fulfil ``keep``.

    Bounds: ``per_language`` texts of at most ``longest_text`` characters for each label, and
    ``rows`` texts in all, of which many labels get fewer each, one at least. Rows with a null label or no letters teach nothing;
    without any labelled row the model answers ``und`` to everything.
    """
    known = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull())
    known = known if keep is None else known.where(keep)
    kinds = F.approx_count_distinct(F.xxhash64(text)).alias("kinds")
    named = known.groupBy(F.col(lang).alias("lang")).agg(F.count(F.lit(1)).alias("n"), kinds)
    found = named.orderBy(F.desc("n"), "lang").limit(rows).collect()
    per_language = max(1, min(per_language, rows // max(len(found), 1)))
    shares = {r["lang"]: min(1.0, 3 * per_language / max(r["kinds"], 1)) for r in found}
    if not shares:
        return fit([], [], **options)
    sample = training_sample(known, text, lang, shares, per_language, longest_text)
    pairs = sorted((r["lang"], r["text"]) for r in sample.collect())
    return fit([t for _, t in pairs], [name for name, _ in pairs], **options)


def predict(
    docs: DataFrame, model: LanguageModel, text: str, out_lang: str, out_score: str, out_known: str | None = None
) -> DataFrame:
    """``docs`` with the predicted language and its score between 0 and 1.

    A text that is null or has no letters is ``und`` with score 0. The whole text counts,
    however long. ``out_known`` names a column that tells whether the model knows any n-gram
    of the text; if not, its score says nothing. Other columns are passed on; repeated rows
    get equal answers.
    """

    @F.pandas_udf("struct<lang: string, score: double, known: boolean>")
    def identify(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        presence = Presence(model.alphabet, model.longest)
        together = max(8, min(256, (1 << 22) // max(len(model.alphabet), 1)))
        for batch in batches:
            texts = ["" if t is None else t for t in batch]
            names, scores, known = [], [], []
            for i in range(0, len(texts), together):
                found, values, seen = model.predict(presence, texts[i : i + together])
                names += found
                scores += values.tolist()
                known += seen.tolist()
            yield pd.DataFrame({"lang": names, "score": scores, "known": known}, columns=["lang", "score", "known"])

    found = free_name(docs, "found", out_lang, out_score, out_known)
    columns = {out_lang: F.col(f"{found}.lang"), out_score: F.col(f"{found}.score")}
    if out_known is not None:
        columns[out_known] = F.col(f"{found}.known")
    return docs.withColumn(found, identify(F.col(text))).withColumns(columns).drop(found)
