"""Substring dedup by super-k-mer partitioning.

A window is ``size`` consecutive words; its minimiser is the smallest hash of the shorter
grams inside it. Consecutive windows that share a minimiser form a super-k-mer, one string
that holds all of them. Equal windows have equal minimisers, so every bucket of a minimiser
can be counted on its own: the packed strings of the bucket are cut into windows, and
sorting these exactly tells which window occurs in which first document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from musterroll.llm.common import free_name, raw
from musterroll.session import written

GRAM_WORDS = 8
#: Windows in one string at most; longer runs, as of one repeated word, are several strings.
MOST_WINDOWS = 1024
#: Different strings of one bucket that are sorted in one task; a bucket with more is cut by window.
HOT_STRINGS = 2_000
_CHUNK_WORDS = 400_000
_P = np.uint64(0x9E3779B97F4A7C15)
STRING = ["minimiser", "id"]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def minimisers(hashes: np.ndarray, size: int, gram: int) -> np.ndarray:
    """The smallest gram hash of every run of ``size`` words."""
    grams = np.zeros(max(len(hashes) - gram + 1, 0), dtype=np.uint64)
    for i in range(gram):
        grams = grams * _P + hashes[i : i + len(grams)]
    least, width, wanted = _mixed(grams), 1, size - gram + 1
    while width < wanted:
        step = min(width, wanted - width)
        least = np.minimum(least[: max(len(least) - step, 0)], least[step:])
        width += step
    return least


def super_kmers(bounds: np.ndarray, hashes: np.ndarray, size: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, windows and minimiser of the super-k-mers of texts laid end to end.

    ``bounds`` has the start of each text and the end of the last one.
    """
    least = minimisers(hashes, size, gram)
    text = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))[: len(least)]
    whole = np.arange(len(least)) + size <= bounds[text + 1]
    starts = np.flatnonzero(whole)
    if not len(starts):
        return starts, starts, least[:0]
    fresh = np.ones(len(starts), dtype=bool)
    fresh[1:] = (np.diff(starts) != 1) | (text[starts[1:]] != text[starts[:-1]]) | (least[starts[1:]] != least[starts[:-1]])
    first = np.flatnonzero(fresh)
    within = np.arange(len(starts)) - np.repeat(first, np.diff([*first, len(starts)]))
    first = np.flatnonzero(within % MOST_WINDOWS == 0)
    return starts[first], np.diff([*first, len(starts)]), least[starts[first]]


def _signed(values: np.ndarray) -> np.ndarray:
    return values.view(np.int64)


def _occurrences(docs: DataFrame, size: int, gram: int) -> DataFrame:
    """Every super-k-mer of every text: where it starts, and two hashes instead of its words."""

    def found_in(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh64_intdigest
        for batch in batches:
            words = [raw(t).split() for t in batch["text"].to_pylist()]
            bounds = np.cumsum([0, *map(len, words)])
            hashes = np.fromiter((digest(w) for own in words for w in own), dtype=np.uint64, count=bounds[-1])
            starts, windows, least = super_kmers(bounds, hashes, size, gram)
            flat, ends = hashes.tobytes(), starts + windows + size - 1
            ids = [digest(flat[8 * a : 8 * b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
            text = np.searchsorted(bounds, starts, side="right") - 1
            rows = pa.array(text)
            yield pa.RecordBatch.from_arrays([
                batch["doc"].take(rows), batch["body"].take(rows), pa.array((starts - bounds[text]).astype(np.int32)),
                pa.array(windows.astype(np.int32)), pa.array(_signed(least)), pa.array(_signed(np.array(ids, dtype=np.uint64))),
            ], ["doc", "body", "start", "windows", *STRING])

    kind = docs.schema["doc"].dataType.simpleString()
    return docs.mapInArrow(found_in, f"doc {kind}, body bigint, start int, windows int, minimiser bigint, id bigint")


def _packed(wanted: DataFrame, size: int) -> DataFrame:
    """The words of the wanted strings, one packed string each, or digests of their windows."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.binary())
        for batch in batches:
            for text, strings in zip(batch["text"].to_pylist(), batch["strings"], strict=True):
                words, strings = raw(text).split(), strings.values
                packed, digests = [], []
                for start, windows, hot in zip(*(strings.field(c).to_pylist() for c in ("start", "windows", "hot")), strict=True):
                    own = words[start : start + windows + size - 1]
                    packed.append(None if hot else b" ".join(own))
                    digests.append(
                        [xxhash.xxh3_128_digest(b" ".join(own[i : i + size])) for i in range(windows)] if hot else None
                    )
                yield pa.RecordBatch.from_arrays([
                    *(strings.field(c) for c in [*STRING, "first", "last"]), pa.array(packed, pa.binary()), pa.array(digests, kind),
                ], [*STRING, "first", "last", "packed", "digests"])

    kind = wanted.schema["doc"].dataType.simpleString()
    return wanted.select("text", "strings").mapInArrow(
        cut, f"minimiser bigint, id bigint, first {kind}, last {kind}, packed binary, digests array<binary>"
    )


def window_ranks(codes: np.ndarray, size: int) -> np.ndarray:
    """A number for each run of ``size`` codes, equal if and only if the runs are equal.

    Runs of twice the length are pairs of runs, numbered by sorting.
    """
    ranks, width = np.unique(codes, return_inverse=True)[1], 1
    while width < size:
        step = min(width, size - width)
        pairs = ranks[: len(ranks) - step] * np.int64(len(codes) + 1) + ranks[step:]
        ranks, width = np.unique(pairs, return_inverse=True)[1], width + step
    return ranks


def first_places(packed: list[bytes], first: np.ndarray, size: int) -> list[np.ndarray]:
    """For each string the smallest ``first`` of all strings that hold its windows, in order."""
    number: dict[bytes, int] = {}
    words = [p.split(b" ") for p in packed]
    codes = np.fromiter((number.setdefault(w, len(number)) for own in words for w in own), dtype=np.int64)
    bounds = np.cumsum([0, *map(len, words)])
    ranks = window_ranks(codes, size)
    windows = np.diff(bounds) - size + 1
    owner = np.repeat(np.arange(len(packed)), windows)
    inside = np.arange(len(owner)) - np.repeat(np.cumsum(windows) - windows, windows)
    ranks = ranks[bounds[owner] + inside]
    least = np.full(ranks.max() + 1, len(packed) * 2, dtype=np.int64)
    np.minimum.at(least, ranks, first[owner])
    return np.split(least[ranks], np.cumsum(windows)[:-1])


def _bucket_runs(strings: DataFrame, size: int) -> DataFrame:
    """Runs of windows with their first document, counted bucket by bucket."""

    def counted(rows: list[tuple]) -> list[tuple]:
        places = sorted({r[2] for r in rows} | {r[3] for r in rows})
        at = {d: i for i, d in enumerate(places)}
        least = first_places([r[4] for r in rows], np.array([at[r[2]] for r in rows]), size)
        out = []
        for (minimiser, own, _, last, _), own_least in zip(rows, least, strict=True):
            cuts = [0, *(np.flatnonzero(np.diff(own_least)) + 1).tolist(), len(own_least)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if own_least[a] < at[last]:
                    out.append((minimiser, own, a, b, places[own_least[a]]))
        return out

    def runs_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, words, kind = [], 0, pa.null()

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), kind]
            columns = zip(*counted(rows), strict=True) if rows else [[]] * 5
            columns = list(columns) or [[]] * 5
            return pa.RecordBatch.from_arrays(
                [pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], [*STRING, "from", "to", "least"]
            )

        for batch in batches:
            kind = batch.schema.field("first").type
            for row in zip(*(batch[c].to_pylist() for c in [*STRING, "first", "last", "packed"]), strict=True):
                if words >= _CHUNK_WORDS and row[0] != held[-1][0]:
                    yield batch_of(held)
                    held, words = [], 0
                held.append(row)
                words += row[4].count(b" ") + 1
        if held:
            yield batch_of(held)

    kind = strings.schema["first"].dataType.simpleString()
    sorted_strings = strings.repartition("minimiser").sortWithinPartitions(*STRING)
    return sorted_strings.mapInArrow(runs_of, f"minimiser bigint, id bigint, from int, to int, least {kind}")


def repeated_ranges(docs: DataFrame, size: int, gram: int, hot_strings: int = HOT_STRINGS) -> DataFrame:
    """``doc, body, ranges``: word ranges (from, to) covered by windows of a smaller document.

    ``docs`` has ``doc``, ``body`` (hash of the text) and ``text``; rows without id or text
    play no part.
    """
    docs = docs.where(F.col("doc").isNotNull() & F.col("text").isNotNull())
    places = written(_occurrences(docs, size, gram), "places")
    strings = places.groupBy(*STRING).agg(
        F.min("doc").alias("first"), F.max("doc").alias("last"), F.min("windows").alias("windows"),
        F.min(F.struct("doc", "body", "start")).alias("place"),
    )
    strings = written(strings, "strings")
    # A bucket needs its words only if it holds several strings, of more than one document.
    buckets = strings.groupBy("minimiser").agg(
        F.count(F.lit(1)).alias("strings"), F.min("first").alias("least"), F.max("last").alias("most")
    ).where("strings > 1 AND least < most").select("minimiser", (F.col("strings") > hot_strings).alias("hot"))
    buckets = written(buckets, "buckets")
    wanted = strings.join(buckets, "minimiser")
    wanted = wanted.groupBy("place.doc", "place.body").agg(
        F.collect_list(F.struct("place.start", "windows", *STRING, "first", "last", "hot")).alias("strings")
    )
    texts = docs.groupBy("doc", "body").agg(F.first("text").alias("text"))
    packed = written(_packed(texts.join(wanted, ["doc", "body"]), size), "packed")
    alone = strings.where("first < last").join(buckets, "minimiser", "left_anti")
    runs = alone.select(*STRING, F.lit(0).alias("from"), F.col("windows").alias("to"), F.col("first").alias("least"))
    runs = runs.unionByName(_bucket_runs(packed.where("packed IS NOT NULL").drop("digests"), size))
    windows = packed.where("digests IS NOT NULL").select(*STRING, "first", "last", F.posexplode("digests").alias("from", "digest"))
    least = windows.groupBy("digest").agg(F.min("first").alias("least"))
    hot = windows.join(least, "digest").where("least < last")
    runs = runs.unionByName(hot.select(*STRING, "from", (F.col("from") + 1).alias("to"), "least"))
    covered = places.join(runs, STRING).where(F.col("doc") > F.col("least"))
    ends = F.struct((F.col("start") + F.col("from")).alias("from"), (F.col("start") + F.col("to") + size - 1).alias("to"))
    return covered.groupBy("doc", "body").agg(F.collect_set(ends).alias("ranges"))


def _kept(texts: list[str | None], ranges: list[list | None]) -> list[tuple]:
    rows = []
    for text, found in zip(texts, ranges, strict=True):
        words = raw(text).split()
        kept, at = [], 0
        for start, end in sorted((r["from"], r["to"]) for r in found or []):
            if start > at:
                kept += words[at:start]
            at = max(at, end)
        kept += words[at:]
        rows.append((None if text is None else b" ".join(kept).decode("utf-8", "replace"), len(words), len(words) - len(kept)))
    return rows


def drop_repeated_windows(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = 50, gram: int = GRAM_WORDS,
    n_words: str | None = None, n_removed: str | None = None, hot_strings: int = HOT_STRINGS,
) -> DataFrame:
    """``docs`` with ``text`` reduced to the words that no earlier document's window covers.

    Words are what stands between white space, compared as they are. A word goes if a
    window of ``size`` words that covers it also starts in a document with a smaller id;
    windows are judged on the input. The words left are joined by one blank, also where
    nothing was removed. The first document with a window keeps it, repeats inside a
    document stay, and so does every row: a full copy keeps an empty text. A null text stays
    null; texts with fewer words than ``size`` and rows with a null id lose nothing and
    remove nothing. Rows that agree in id and text are treated alike, and of rows that share
    an id none comes first. Other columns are passed on; ``n_words`` and ``n_removed`` name
    columns to add with the counts (0 for a null text).

    Thin rows (two hashes for a string) find buckets that hold different strings; only their
    strings are packed and shuffled, each once. The words of a bucket with more than
    ``hot_strings`` strings do not travel to one task: its windows are counted by their
    128-bit digests, with sums before the shuffle.
    """
    body = F.xxhash64(F.col(text))
    source = docs.select(F.col(doc_id).alias("doc"), body.alias("body"), F.col(text).alias("text"))
    own_doc, own_body, own_ranges, cut = (free_name(docs, c) for c in ("cut_doc", "cut_body", "cut_ranges", "cut"))
    ranges = repeated_ranges(source, size, gram, hot_strings).select(
        F.col("doc").alias(own_doc), F.col("body").alias(own_body), F.col("ranges").alias(own_ranges)
    )

    @F.arrow_udf("struct<kept: string, words: bigint, removed: bigint>")
    def reduced(texts: pa.Array, found: pa.Array) -> pa.Array:
        rows = _kept(texts.to_pylist(), found.to_pylist())
        kept, words, removed = zip(*rows, strict=True) if rows else ([], [], [])
        return pa.StructArray.from_arrays(
            [pa.array(kept, pa.string()), pa.array(words, pa.int64()), pa.array(removed, pa.int64())], ["kept", "words", "removed"]
        )

    joined = docs.join(ranges, (F.col(doc_id) == F.col(own_doc)) & (body == F.col(own_body)), "left")
    joined = joined.withColumn(cut, reduced(F.col(text), F.col(own_ranges)))
    columns = [F.col(f"{cut}.kept").alias(c) if c == text else F.col(f"`{c}`") for c in docs.columns]
    added = [F.col(f"{cut}.{f}").alias(c) for f, c in (("words", n_words), ("removed", n_removed)) if c]
    return joined.select(*columns, *added)
