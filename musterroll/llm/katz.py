"""Language-model scoring with Katz backoff.

Word counts cover every word, and pair counts every pair. Counts are discounted by
Good-Turing, and the weight of backing off is normalised exactly: for every history the
probabilities of all words and of one unseen word sum to one.

The most frequent words (the vocabulary) and pairs are known to every task; what is known
there changes no result. Of all other words, counts and backoff weights lie in buckets by
their hash. A pair with such a word is rare: it is counted in the bucket of its second
word, whose count it takes along, and ends in that of its first word, whose backoff weight
it makes up; a rare pair after a vocabulary word stays. Documents are read in blocks;
a block asks each bucket once for the distinct keys that it holds, with the documents they
occur in, and gets sums per document back. As frequent words and pairs are not asked for,
no key that is asked for is in a large share of documents.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from musterroll.llm.common import raw, word_runs
from musterroll.session import written

KEPT = 5  # counts up to this are discounted
END = xxhash.xxh64_intdigest(b" end ")  # no word holds a space
BLOCK_TOKENS = 2_000_000
BLOCK_DOCS = 8192
_COUNTED = "bucket int, keys binary, counts binary"
_TOTALS = ["total", "kinds", *[f"n{r}" for r in range(1, KEPT + 2)]]


def squeeze(values: np.ndarray) -> bytes:
    """Compressed bytes, the first byte of every value first, then the second and so on."""
    planes = np.ascontiguousarray(values).view(np.uint8).reshape(len(values), values.itemsize).T
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def loosen(data: bytes, kind: str) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), dtype=np.uint8)
    return np.ascontiguousarray(planes.reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()


def word_hashes(text: str | None) -> np.ndarray:
    """64-bit hashes of the words of a text (A-Z in lower case), and of its end."""
    parts = [np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words)) for words in word_runs(raw(text).lower())]
    return np.concatenate([*parts, np.array([END], dtype=np.uint64)])


def bucket_of(keys: np.ndarray, buckets: int) -> np.ndarray:
    mixed = keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return ((mixed >> np.uint64(33)) % np.uint64(buckets)).astype(np.int64)


def by_bucket(keys: np.ndarray, buckets: int) -> Iterator[tuple[int, np.ndarray]]:
    """Each bucket with the positions of its keys, in the order given."""
    own = bucket_of(keys, buckets)
    order = np.argsort(own, kind="stable")
    cuts = np.flatnonzero(np.diff(own[order])) + 1
    for part in np.split(order, cuts) if len(order) else []:
        yield int(own[part[0]]), part


def discounts(n: list[int]) -> np.ndarray:
    """Good-Turing factors for counts 1 to ``KEPT`` (index 0 is unused), Katz's form.

    Where the counts of counts do not give factors between 0 and 1 (small or odd corpora),
    half an occurrence is taken off instead.
    """
    factors = np.ones(KEPT + 1)
    fallback = np.array([1.0, *((r - 0.5) / r for r in range(1, KEPT + 1))])
    if min(n) <= 0:
        return fallback
    cut = (KEPT + 1) * n[KEPT] / n[0]
    for r in range(1, KEPT + 1):
        factors[r] = ((r + 1) * n[r] / n[r - 1] / r - cut) / (1 - cut) if cut < 1 else 0
    good = (factors[1:] > 0) & (factors[1:] < 1)
    return factors if good.all() else fallback


def discounted(counts: np.ndarray, factors: np.ndarray) -> np.ndarray:
    return counts * np.where(counts <= KEPT, factors[np.minimum(counts, KEPT)], 1.0)


@dataclass
class Katz:
    """What every task knows: the vocabulary, its word probabilities and backoff weights.

    A word's name is its number in the vocabulary, or its hash if it has none; the start of
    a text has the number ``len(words) + 1``, and ``len(words)`` stands for no word.
    """

    words: np.ndarray
    counts: np.ndarray
    total: int
    kinds: int
    word_factors: np.ndarray
    unseen: float
    per_token: float
    buckets: int = 1
    pair_factors: np.ndarray = field(default_factory=lambda: np.ones(KEPT + 1))
    seen_after: np.ndarray = field(default_factory=lambda: np.zeros(0))
    backoff: np.ndarray = field(default_factory=lambda: np.zeros(0))
    hot_pairs: np.ndarray = field(default_factory=lambda: np.zeros(0, dtype=np.uint32))
    hot_counts: np.ndarray = field(default_factory=lambda: np.zeros(0, dtype=np.int64))

    def numbers(self, hashes: np.ndarray) -> np.ndarray:
        if not len(self.words):
            return np.zeros(len(hashes), dtype=np.int64)
        at = np.minimum(np.searchsorted(self.words, hashes), len(self.words) - 1)
        return np.where(self.words[at] == hashes, at, len(self.words))

    def rare(self, names: np.ndarray) -> np.ndarray:
        """Whether these are names of words beyond the vocabulary."""
        return names > np.uint64(len(self.words) + 1)

    def word_probability(self, counts: np.ndarray) -> np.ndarray:
        """Of a word with this count; all unseen words share what is left."""
        return np.where(counts > 0, discounted(counts, self.word_factors) * self.per_token, self.unseen)

    def pair_gain(self, pairs: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """By how much a counted pair's log10 probability differs from backing off."""
        history, word = (pairs >> np.uint32(16)).astype(np.int64), (pairs & np.uint32(0xFFFF)).astype(np.int64)
        direct = np.log10(discounted(counts, self.pair_factors) / self.seen_after[history])
        return direct - self.backoff[history] - np.log10(self.word_probability(self.counts[word]))


def word_model(totals: dict[str, int], top: list[tuple[int, int]]) -> Katz:
    """Unigram level: discounted shares of the tokens, the rest for unseen words."""
    total, kinds = totals["total"], totals["kinds"]
    counts_of_counts = [totals[f"n{r}"] for r in range(1, KEPT + 2)]
    factors = discounts(counts_of_counts)
    kept_back = sum(r * counts_of_counts[r - 1] * (1 - factors[r]) for r in range(1, KEPT + 1))
    room = total if kept_back > 0 else total + 1
    words = np.array([k for k, _ in top], dtype=np.int64).view(np.uint64)
    order = np.argsort(words)
    counts = np.array([c for _, c in top], dtype=np.int64)[order]
    return Katz(words[order], counts, total, kinds, factors, (kept_back or 1) / room, 1 / room)


def _text_blocks(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[int, pd.DataFrame, list[np.ndarray]]]:
    """Rows of a partition in blocks of bounded size, numbered alike in every attempt."""
    number = TaskContext.get().partitionId() << 24
    rows, hashes, size = [], [], 0
    for batch in batches:
        for row in batch.itertuples(index=False):
            rows.append(row[:-1])
            hashes.append(word_hashes(row[-1]))
            size += len(hashes[-1])
            if size >= BLOCK_TOKENS or len(rows) >= BLOCK_DOCS:
                yield number, pd.DataFrame(rows, columns=batch.columns[:-1]), hashes
                number, rows, hashes, size = number + 1, [], [], 0
        columns = batch.columns[:-1]
    if rows:
        yield number, pd.DataFrame(rows, columns=columns), hashes


def _counted(keys: np.ndarray, buckets: int) -> pd.DataFrame:
    keys, counts = np.unique(keys, return_counts=True)
    rows = [(b, squeeze(keys[own]), squeeze(counts[own].astype(np.uint64))) for b, own in by_bucket(keys, buckets)]
    return pd.DataFrame(rows, columns=["bucket", "keys", "counts"])


def _distinct(keys: np.ndarray, others: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct pairs in order, and the sums of their counts."""
    order = np.lexsort((others, keys))
    keys, others = keys[order], others[order]
    new = np.ones(len(keys), dtype=bool)
    new[1:] = (keys[1:] != keys[:-1]) | (others[1:] != others[:-1])
    at = np.flatnonzero(new)
    sums = np.add.reduceat(counts[order], at) if len(at) else counts[:0]
    return keys[at], others[at], sums


def _counted_rare(kind: str, keys: np.ndarray, others: np.ndarray, buckets: int) -> pd.DataFrame:
    """Rare pairs with their counts in a block, for the buckets of ``keys``."""
    keys, others, counts = _distinct(keys, others, np.ones(len(keys), dtype=np.int64))
    rows = [(kind, b, squeeze(keys[own]), squeeze(others[own]), squeeze(counts[own])) for b, own in by_bucket(keys, buckets)]
    return pd.DataFrame(rows, columns=["kind", "bucket", "keys", "others", "counts"])


def _sizes(counts: np.ndarray) -> dict[str, int]:
    few = np.bincount(np.minimum(counts, KEPT + 2), minlength=KEPT + 3)[1 : KEPT + 2].tolist()
    return dict(zip(_TOTALS, [int(counts.sum()), len(counts), *few], strict=True))


def _summed(kind: str, top: int):
    """Add up the counts of a bucket; with totals, and its ``top`` most frequent keys."""

    def summed(block: pd.DataFrame) -> pd.DataFrame:
        keys = np.concatenate([loosen(k, kind) for k in block["keys"]])
        counts = np.concatenate([loosen(c, "u8") for c in block["counts"]])
        keys, place = np.unique(keys, return_inverse=True)
        sums = np.zeros(len(keys), dtype=np.int64)
        np.add.at(sums, place, counts.astype(np.int64))
        counts = sums
        best = np.lexsort((keys, -counts))[:top]
        first = {"bucket": int(block["bucket"].iloc[0]), "keys": squeeze(keys), "counts": squeeze(counts.astype(np.uint64))}
        first["top_keys"] = keys[best].astype(np.uint64).view(np.int64)
        first["top_counts"] = counts[best]
        return pd.DataFrame([first | _sizes(counts)])

    return summed


def _joined(blobs: pd.Series, kind: str) -> np.ndarray:
    return np.concatenate([np.zeros(0, kind), *[loosen(b, kind) for b in blobs]])


def _summed_pairs(model: Katz, top: int):
    """Add up the pairs of a bucket, by their kind.

    ``pair``: both words in the vocabulary; ``first``: only the history is rare. ``second``,
    by the rare second word, comes with the bucket's words (without ``others``), and the
    second word's count goes along. It becomes ``own`` if the history is in the vocabulary,
    else ``met``, turned round and for the bucket of the history.
    """
    plain = _summed("u4", top)

    def summed(block: pd.DataFrame) -> pd.DataFrame:
        kind, bucket = block["kind"].iloc[0], int(block["bucket"].iloc[0])
        if kind == "pair":
            return plain(block).assign(kind=kind, others=None, words=None)
        known, block = block[block["others"].isna()], block[block["others"].notna()]
        keys, others, counts = _distinct(_joined(block["keys"], "u8"), _joined(block["others"], "u8"), _joined(block["counts"], "i8"))
        if kind == "first":
            rows = [(kind, bucket, squeeze(keys), squeeze(others), squeeze(counts), None)]
        else:
            words = _joined(known["counts"], "i8")[np.searchsorted(_joined(known["keys"], "u8"), keys)]
            rare, rows = model.rare(others), []
            rows.append(("own", bucket, *[squeeze(v[~rare]) for v in (keys, others, counts, words)]))
            order = np.flatnonzero(rare)[np.lexsort((keys[rare], others[rare]))]
            for target, part in by_bucket(others[order], model.buckets):
                rows.append(("met", target, *[squeeze(v[order[part]]) for v in (others, keys, counts, words)]))
        found = pd.DataFrame(rows, columns=["kind", "bucket", "keys", "others", "counts", "words"]).assign(top_keys=None, top_counts=None)
        # All that is counted here counts in the first row.
        return found.assign(**{t: [n] + [0] * (len(found) - 1) for t, n in _sizes(counts).items()})

    return summed


_SUMMED = f"{_COUNTED}, top_keys array<bigint>, top_counts array<bigint>, " + ", ".join(f"{t} bigint" for t in _TOTALS)


def _share(keys: int, buckets: int) -> int:
    """How many of the most frequent keys to look for in one bucket: twice its even share."""
    return min(keys, 2 * keys // buckets + 256)


def _totals(counted: DataFrame) -> dict[str, int]:
    return {k: v or 0 for k, v in counted.agg(*[F.sum(t).alias(t) for t in _TOTALS]).first().asDict().items()}


def _most_frequent(counted: DataFrame, n: int) -> list[tuple[int, int]]:
    pairs = counted.select(F.explode(F.arrays_zip("top_keys", "top_counts")).alias("x")).select("x.*")
    return [tuple(r) for r in pairs.orderBy(F.desc("top_counts"), "top_keys").limit(n).collect()]


def _pairs(model: Katz, hashes: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of all tokens of a block: name, name of the history, and document."""
    tokens = np.concatenate(hashes)
    numbers = model.numbers(tokens)
    names = np.where(numbers < len(model.words), numbers.astype(np.uint64), tokens)
    sizes = np.array([len(h) for h in hashes])
    history = np.empty_like(names)
    history[1:] = names[:-1]
    history[np.cumsum(sizes) - sizes] = len(model.words) + 1
    return names, history, np.repeat(np.arange(len(sizes)), sizes)


def _pair_keys(history: np.ndarray, numbers: np.ndarray) -> np.ndarray:
    return (history.astype(np.uint32) << np.uint32(16)) | numbers.astype(np.uint32)


def _rare_keys(history: np.ndarray, names: np.ndarray) -> np.ndarray:
    """64-bit hashes of rare pairs; one history's words never clash."""
    mixed = (history ^ (history >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    mixed = (mixed ^ (mixed >> np.uint64(29))) + names
    mixed = (mixed ^ (mixed >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15)
    return mixed ^ (mixed >> np.uint64(29))


def fit(docs: DataFrame, vocabulary: int = 65_000, hot_pairs: int = 65_536, bucket_tokens: int = 4_000_000):
    """Count ``docs`` (a column ``text``): the model, and the tables of word and pair counts.

    ``vocabulary`` (65,000 at most) and ``hot_pairs`` bound what tasks hold in memory; the
    model is the same whatever they are.
    """
    docs = docs.select("text")
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = 1 + size // (bucket_tokens * 6)
    vocabulary = min(vocabulary, 65_000)  # two numbers are one key of 32 bits

    def count_words(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for _, _, hashes in _text_blocks(batches):
            yield _counted(np.concatenate(hashes), buckets)

    words = docs.mapInPandas(count_words, _COUNTED).groupBy("bucket").applyInPandas(_summed("u8", _share(vocabulary, buckets)), _SUMMED)
    words = written(words, "words")
    model = word_model(_totals(words), _most_frequent(words, vocabulary))
    model.buckets = buckets

    def count_pairs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for _, _, hashes in _text_blocks(batches):
            names, history, _ = _pairs(model, hashes)
            second, first = model.rare(names), model.rare(history)
            plain, first = ~(first | second), first & ~second
            yield _counted(_pair_keys(history[plain], names[plain]), buckets).assign(kind="pair", others=None)
            yield _counted_rare("second", names[second], history[second], buckets)
            yield _counted_rare("first", history[first], names[first], buckets)

    pairs = docs.mapInPandas(count_pairs, f"{_COUNTED}, kind string, others binary").unionByName(words.select(
        F.lit("second").alias("kind"), "bucket", "keys", F.lit(None).cast("binary").alias("others"), "counts"))
    pairs = pairs.groupBy("kind", "bucket").applyInPandas(
        _summed_pairs(model, _share(hot_pairs, buckets)), f"{_SUMMED}, kind string, others binary, words binary")
    pairs = written(pairs, "pairs")
    totals = _totals(pairs)
    model.pair_factors = discounts([totals[f"n{r}"] for r in range(1, KEPT + 2)])
    model.hot_pairs, model.hot_counts = _hot(_most_frequent(pairs, hot_pairs))
    _normalise(model, pairs, docs.count())
    return model, words, pairs


def _mass(model: Katz, history: np.ndarray, counts: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per history: discounted counts of its pairs, and the probabilities of their words by the words' counts."""
    own, place = np.unique(history, return_inverse=True)
    direct = np.bincount(place, discounted(counts, model.pair_factors), len(own))
    return own, direct, np.bincount(place, model.word_probability(words), len(own))


def _rest(model: Katz, table: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of a bucket: words, counts and backoff weights; hashes of rare pairs and what they add to a score."""
    kept = {k: table[table["kind"] == k] for k in ("words", "own", "first", "met")}
    keys, of_words = _joined(kept["words"]["keys"], "u8"), _joined(kept["words"]["counts"], "i8")
    numbers = _joined(kept["first"]["others"], "u8")

    def joined(kind: str, column: str, dtype: str = "u8") -> np.ndarray:
        return _joined(kept[kind][column], dtype)

    history = np.concatenate([joined("first", "keys"), joined("met", "keys"), joined("own", "others")])
    names = np.concatenate([numbers, joined("met", "others"), joined("own", "keys")])
    counts = np.concatenate([joined(k, "counts", "i8") for k in ("first", "met", "own")])
    words = np.concatenate([model.counts[numbers.astype(np.int64)], joined("met", "words", "i8"), joined("own", "words", "i8")])
    rare, level = model.rare(history), np.empty(len(history))
    place = np.searchsorted(keys, history[rare])
    direct = np.bincount(place, discounted(counts[rare], model.pair_factors), len(keys))
    lower = np.bincount(place, model.word_probability(words[rare]), len(keys))
    seen, backoff = _weights(of_words.astype(float), direct, lower)
    level[rare] = (np.log10(seen) + backoff)[place]
    own = history[~rare].astype(np.int64)
    level[~rare] = np.log10(model.seen_after[own]) + model.backoff[own]
    gains = np.log10(discounted(counts, model.pair_factors)) - np.log10(model.word_probability(words)) - level
    named = _rare_keys(history, names)
    order = np.argsort(named)
    return keys, of_words, backoff, named[order], gains[order]


def _hot(top: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
    keys = np.array([k for k, _ in top], dtype=np.uint32)
    order = np.argsort(keys)
    return keys[order], np.array([c for _, c in top], dtype=np.int64)[order]


def _normalise(model: Katz, pairs: DataFrame, n_docs: int) -> None:
    """Backoff weights of the vocabulary: what the counted pairs leave, over what their words leave."""

    def mass(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples(index=False):
                counts = loosen(row.counts, "i8")
                if row.kind == "pair":
                    keys = loosen(row.keys, "u4")
                    history, words = (keys >> np.uint32(16)).astype(np.int64), model.counts[(keys & np.uint32(0xFFFF)).astype(np.int64)]
                else:
                    history, words = loosen(row.others, "i8"), loosen(row.words, "i8")
                own, direct, lower = _mass(model, history, counts, words)
                yield pd.DataFrame({"history": own, "direct": direct, "lower": lower})

    found = pairs.where("kind in ('pair', 'own')").select("kind", "keys", "others", "counts", "words")
    found = found.mapInPandas(mass, "history bigint, direct double, lower double")
    rows = found.groupBy("history").agg(F.sum("direct"), F.sum("lower")).collect()  # one per vocabulary word
    n = len(model.words)
    seen = np.concatenate([model.counts, [0, n_docs]]).astype(float)
    direct, lower = np.zeros(n + 2), np.zeros(n + 2)
    for history, own, words in rows:
        direct[history], lower[history] = own, words
    model.seen_after, model.backoff = _weights(seen, direct, lower)


def _weights(seen: np.ndarray, direct: np.ndarray, lower: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per history: the occurrences that its pairs share, and the log10 weight of backing off."""
    # A history that leaves nothing gets one occurrence more.
    seen = np.where(seen - direct < 1e-6 * np.maximum(seen, 1), seen + 1, seen)
    seen = np.maximum(seen, 1)
    left = np.maximum(1 - lower, 1e-12)
    return seen, np.where(direct > 0, np.log10((1 - direct / seen) / left), 0.0)


_ASKED = "kind string, target bigint, block bigint, keys binary, counts binary, docs binary, ids array<{}>, flags array<boolean>"
_FIELDS = ["kind", "target", "block", "keys", "counts", "docs", "ids", "flags"]


def _asks(kind: str, block: int, keys: np.ndarray, docs: np.ndarray, buckets: int, places: np.ndarray | None = None) -> Iterator[tuple]:
    """The distinct keys of a block for each bucket (of ``places``, else of the keys), with the documents they occur in."""
    order = np.argsort(keys, kind="stable")
    places = keys[order] if places is None else places[order]
    keys, docs = keys[order], docs[order]
    for bucket, own in by_bucket(places, buckets):
        distinct, counts = np.unique(keys[own], return_counts=True)
        yield (kind, bucket, block, squeeze(distinct), squeeze(counts.astype(np.uint32)),
               squeeze(docs[own].astype(np.uint16)), None, None)


def _ask(model: Katz):
    """What a block knows by itself, and what it asks of the buckets."""

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for block, rows, hashes in _text_blocks(batches):
            names, history, docs = _pairs(model, hashes)
            known, led, n = ~model.rare(names), ~model.rare(history), len(rows)
            plain = known & led
            counts = model.counts[names[known].astype(np.int64)]
            base = np.bincount(docs[known], np.log10(counts + 1.0), n)
            score = np.bincount(docs[led], model.backoff[history[led].astype(np.int64)], n)
            score += np.bincount(docs[known], np.log10(model.word_probability(counts)), n)
            pairs, owners = _pair_keys(history[plain], names[plain]), docs[plain]
            if len(model.hot_pairs):
                at = np.minimum(np.searchsorted(model.hot_pairs, pairs), len(model.hot_pairs) - 1)
                hot = model.hot_pairs[at] == pairs
                gain = model.pair_gain(model.hot_pairs, model.hot_counts)
                score += np.bincount(owners[hot], gain[at[hot]], n)
                pairs, owners = pairs[~hot], owners[~hot]
            own = np.column_stack([np.bincount(docs, minlength=n), np.bincount(docs[known], minlength=n), base, score])
            out = [("own", block, block, squeeze(own.ravel()), None, None, list(rows.iloc[:, 0]), list(rows.iloc[:, 1]))]
            out += _asks("word", block, names[~known], docs[~known], model.buckets)
            out += _asks("pair", block, pairs, owners, model.buckets)
            places = np.where(led, names, history)[~plain]
            out += _asks("rare", block, _rare_keys(history[~plain], names[~plain]), docs[~plain], model.buckets, places)
            yield pd.DataFrame(out, columns=_FIELDS)

    return ask


def _answer(model: Katz):
    """Per asking block: sums per document of known words, base and model terms."""

    def answer(rows: pd.DataFrame) -> pd.DataFrame:
        asks, table = rows[rows["block"] != -1], rows[rows["block"] == -1]
        if rows["held"].iloc[0] == "block":
            return rows[["block", "keys", "docs", "ids", "flags"]].rename(columns={"keys": "sums"})
        if rows["held"].iloc[0] == "pair":
            keys, counts = _joined(table["keys"], "u4"), _joined(table["counts"], "i8")
            held = {"pair": (keys, counts, model.pair_gain(keys, counts))}
        else:
            words, counts, backoff, pairs, gains = _rest(model, table)
            held = {"word": (words, counts, backoff), "rare": (pairs, None, gains)}
        out = []
        for row in asks.itertuples(index=False):
            keys, counts, gains = held[row.kind]
            asked, times, docs = loosen(row.keys, keys.dtype.str), loosen(row.counts, "u4"), loosen(row.docs, "u2")
            found, gain, none = np.zeros(len(asked), dtype=np.int64), np.zeros(len(asked)), np.zeros(len(asked))
            if len(keys):
                at = np.minimum(np.searchsorted(keys, asked), len(keys) - 1)
                there = keys[at] == asked
                gain[there] = gains[at[there]]
                if row.kind == "word":
                    found[there] = counts[at[there]]
            terms = [none, none, gain]
            if row.kind == "word":
                # Every word leads to another, so its weight of backing off counts as often as itself.
                terms = [found > 0, np.log10(found + 1.0), np.log10(model.word_probability(found)) + gain]
            present, place = np.unique(docs, return_inverse=True)
            sums = [np.bincount(place, np.repeat(t.astype(float), times), len(present)) for t in terms]
            out.append((row.block, squeeze(np.column_stack(sums).ravel()), squeeze(present), None, None))
        return pd.DataFrame(out, columns=["block", "sums", "docs", "ids", "flags"])

    return answer


def _add_up(model: Katz):
    def add_up(rows: pd.DataFrame) -> pd.DataFrame:
        own = rows[rows["docs"].isna()].iloc[0]
        sums = loosen(own["sums"], "f8").reshape(-1, 4).copy()
        for row in rows[rows["docs"].notna()].itertuples(index=False):
            sums[loosen(row.docs, "u2").astype(np.int64), 1:] += loosen(row.sums, "f8").reshape(-1, 3)
        tokens = sums[:, 0]
        return pd.DataFrame({
            "doc": list(own["ids"]), "held_out": list(own["flags"]), "n_tokens": tokens.astype(np.int64),
            "n_known": np.rint(sums[:, 1]).astype(np.int64),
            "base_score": sums[:, 2] - tokens * np.log10(model.total + model.kinds + 1), "score": sums[:, 3],
        })

    return add_up


def score(docs: DataFrame, held_out: Column, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` of each row.

    Learns from the rows that are not held out and scores all. ``score`` is the log10
    probability of the words and the end of the text; ``base_score`` that of add-one
    smoothed words. A null text is empty and has only its end. Without training rows every
    word is unseen. Repeated rows count and score as often as they occur; null ids are
    passed on; other columns play no part. Words are told apart by 64-bit hashes.
    """
    rows = docs.select(F.col(doc_id).alias("doc"), F.coalesce(held_out, F.lit(False)).alias("held"), F.col(text).alias("text"))
    model, words, pairs = fit(rows.where(~F.col("held")), **options)
    kind = rows.schema["doc"].dataType.simpleString()
    asked = rows.mapInPandas(_ask(model), _ASKED.format(kind))
    none = F.lit(None).cast("binary")
    held = F.when(F.col("kind") == "own", "block").when(F.col("kind") == "pair", "pair").otherwise("rest")
    asked = asked.withColumns({"held": held, "others": none, "words": none})
    counts = words.select(F.lit("words").alias("kind"), "bucket", "keys", "counts", none.alias("others"), none.alias("words"))
    counts = counts.unionByName(pairs.select("kind", "bucket", "keys", "counts", "others", "words"))
    asked = asked.unionByName(counts.select(
        "kind", F.when(F.col("kind") == "pair", "pair").otherwise("rest").alias("held"), F.col("bucket").cast("bigint").alias("target"),
        F.lit(-1).cast("bigint").alias("block"), "keys", "counts", "others", "words", none.alias("docs"),
        *[F.lit(None).cast(t).alias(c) for c, t in (("ids", f"array<{kind}>"), ("flags", "array<boolean>"))]))
    answers = asked.groupBy("held", "target").applyInPandas(
        _answer(model), f"block bigint, sums binary, docs binary, ids array<{kind}>, flags array<boolean>")
    done = answers.groupBy("block").applyInPandas(
        _add_up(model), f"doc {kind}, held_out boolean, n_tokens bigint, n_known bigint, base_score double, score double")
    return done.select(
        F.col("doc").alias(doc_id), "held_out", "n_tokens", "n_known", F.lit(model.total).cast("bigint").alias("train_tokens"),
        "base_score", "score")
