"""Importance resampling towards a target collection.

Words come from a byte table that lower-cases and blanks separators, and from
``bytes.split``. Runs of words are numbered by chained checksums, counted in hashed
buckets, and every bucket's gain is the log ratio of its shares in target and corpus. A
document weighs the sum of its gains; with a Gumbel variable of its id added, the highest
scores are a sample without replacement whose odds follow the weights.
"""

from __future__ import annotations

import hashlib
import math
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from musterroll.llm.common import free_name, plain_words
from musterroll.session import written

#: ``monotonically_increasing_id`` has the partition above this bit and the row below.
_ROW_BITS = 33
_ORDER = ("drawable", "score", "doc", "n_features", "n_words", "weight", "body")


def feature_checksums(text: str | None, longest: int) -> Iterator[tuple[int, list[int]]]:
    """(new words, checksums of all runs of 1 to ``longest`` words that end in them).

    The checksum of a run goes on from that of the run without its last word, so no run is
    ever joined. A long text comes in several parts.
    """
    held: list[bytes] = []
    for new in plain_words(text):
        sums = running = list(map(crc32, new))
        if longest > 1:
            words = held + new
            running = list(map(crc32, words))
            for n in range(2, longest + 1):
                running = [crc32(b" " + word, start) for start, word in zip(running, words[n - 1 :], strict=False)]
                sums = sums + running[max(0, len(held) - n + 1) :]
            held = words[-(longest - 1) :]
        yield len(new), sums


def bucket_counts(docs: DataFrame, text: str, longest: int, buckets: int) -> np.ndarray:
    """Features of all texts per bucket: ``buckets`` sums, whatever the number of texts."""

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        totals = np.zeros(buckets, dtype=np.int64)
        for batch in batches:
            seen: Counter[int] = Counter()
            for value in batch["text"]:
                for _, sums in feature_checksums(value, longest):
                    seen.update(sums)
            keys = np.fromiter(seen.keys(), dtype=np.int64, count=len(seen))
            np.add.at(totals, keys % buckets, np.fromiter(seen.values(), dtype=np.int64, count=len(seen)))
        found = np.flatnonzero(totals)
        yield pd.DataFrame({"bucket": found, "n": totals[found]})

    parts = docs.select(F.col(text).alias("text")).mapInPandas(counted, "bucket bigint, n bigint")
    totals = np.zeros(buckets, dtype=np.int64)
    for row in parts.groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        totals[row["bucket"]] = row["n"]
    return totals


def bucket_gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the log ratio of the shares, smoothed by one, rounded down."""
    buckets, all_corpus, all_target = len(corpus), int(corpus.sum()), int(target.sum())
    return np.array([
        math.floor(1000 * math.log(float((t + 1) * (all_corpus + buckets)) / float((s + 1) * (all_target + buckets))))
        for s, t in zip(corpus.tolist(), target.tolist(), strict=True)
    ], dtype=np.int64)


def gumbel(seed: int, doc_id: str | None) -> int:
    """A Gumbel variable in thousandths, the same for an id in every run; a null id is empty."""
    h = int(hashlib.sha256(f"{seed}:{doc_id or ''}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def weighed(
    docs: DataFrame, gains: np.ndarray, doc_id: str = "doc_id", text: str = "text", longest: int = 1,
    seed: int = 2024, out: str = "weighed",
) -> DataFrame:
    """``docs`` with a struct of ``n_words``, ``n_features``, ``weight`` and ``score``.

    A null text has no words and weighs nothing. All columns are passed on.
    """
    buckets = len(gains)

    @F.pandas_udf("struct<n_words: bigint, n_features: bigint, weight: bigint, score: bigint>")
    def weigh(ids: pd.Series, texts: pd.Series) -> pd.DataFrame:
        rows = []
        for own, value in zip(ids, texts, strict=True):
            n_words = n_features = weight = 0
            for new, sums in feature_checksums(value, longest):
                n_words += new
                n_features += len(sums)
                weight += int(gains[np.array(sums, dtype=np.int64) % buckets].sum())
            rows.append((n_words, n_features, weight, weight + gumbel(seed, own)))
        return pd.DataFrame(rows, columns=["n_words", "n_features", "weight", "score"])

    return docs.withColumn(out, weigh(F.col(doc_id).cast("string"), F.col(text)))


def numbered(rows: DataFrame, order: list[Column], out: str) -> DataFrame:
    """``rows`` with their place (from 1) in ``order``, without one task that sorts them all.

    Range partitions are sorted and numbered on their own; the driver adds up one count per
    partition. ``rows`` should be cheap to read twice, since the ranges come from a sample.
    """
    place = free_name(rows, "place")
    inside = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    inside = written(inside.withColumn(place, F.monotonically_increasing_id()), "places")
    part = F.shiftright(place, _ROW_BITS)
    counts = sorted((r["part"], r["n"]) for r in inside.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n")).collect())
    before = accumulate([n for _, n in counts], initial=0)
    starts = [(p, n) for (p, _), n in zip(counts, before, strict=False)]
    own, first = free_name(rows, "own_part"), free_name(rows, "first_place")
    starts = rows.sparkSession.createDataFrame(starts, f"{own} bigint, {first} bigint")
    row = F.col(place) - F.shiftleft(part, _ROW_BITS)
    joined = inside.join(F.broadcast(starts), part == F.col(own))
    return joined.withColumn(out, F.col(first) + row + 1).select(*[F.col(f"`{c}`") for c in rows.columns], out)


def importance_ranks(
    docs: DataFrame, target: DataFrame, doc_id: str = "doc_id", text: str = "text", target_text: str = "text",
    longest: int = 1, buckets: int = 10_000, least_words: int = 20, percent: int = 10, seed: int = 2024,
) -> DataFrame:
    """``doc_id, body, n_words, n_features, weight, score, rank``: one row per row of ``docs``.

    Features are the runs of 1 to ``longest`` words, repeats included, in ``buckets`` hashed
    buckets; counts cover all texts of both tables. Of the N documents with ``least_words``
    words or more, the floor(``percent`` * N / 100) highest scores are drawn and ranked from
    1, ties to the smaller id (nulls last); ``rank`` is null for all others. ``body`` is a
    hash of the text. A null or empty text has no words, weighs 0 and is never drawn unless
    ``least_words`` is 0; repeated rows count and rank each on their own; a target without
    rows leaves the corpus shares to decide; an empty ``docs`` gives no rows. Other columns,
    whatever their names, play no part.

    Both passes over the texts are narrow. Counts are added up per task before they are
    shuffled, the gains are ``buckets`` numbers for every task, and ranks come from a range
    partitioning of thin rows.
    """
    source = docs.select(F.col(doc_id).alias("doc"), F.col(text).alias("text"))
    wanted = bucket_counts(target, target_text, longest, buckets)
    gains = bucket_gains(bucket_counts(source, "text", longest, buckets), wanted)
    scored = weighed(source, gains, "doc", "text", longest, seed)
    scored = scored.select("doc", F.xxhash64("text").alias("body"), "weighed.*")
    scored = written(scored.withColumn("drawable", F.col("n_words") >= least_words), "scored")
    draws = scored.where("drawable").count() * percent // 100
    falling = {"drawable", "score"}
    order = [F.desc(c) if c in falling else F.asc_nulls_last(c) for c in _ORDER]
    ranked = numbered(scored, order, "place")
    rank = F.when(F.col("place") <= draws, F.col("place"))
    return ranked.select(F.col("doc").alias(doc_id), "body", "n_words", "n_features", "weight", "score", rank.alias("rank"))


def resampled(
    docs: DataFrame, target: DataFrame, doc_id: str = "doc_id", text: str = "text", target_text: str = "text", **options
) -> DataFrame:
    """The rows of ``docs`` that are drawn, with all their columns and texts.

    Of rows that agree in id and text as many stay as were drawn. ``options`` are those of
    ``importance_ranks``.
    """
    drawn = importance_ranks(docs, target, doc_id, text, target_text, **options).where("rank IS NOT NULL")
    own, body, times, nth = (free_name(docs, c) for c in ("drawn_doc", "drawn_body", "drawn_times", "drawn_nth"))
    drawn = drawn.groupBy(F.col(doc_id).alias(own), F.col("body").alias(body)).agg(F.count(F.lit(1)).alias(times))
    hashed = F.xxhash64(docs[text])
    kept = docs.join(drawn, docs[doc_id].eqNullSafe(drawn[own]) & (hashed == drawn[body]))
    order = Window.partitionBy(own, body).orderBy(F.lit(0))
    kept = kept.withColumn(nth, F.row_number().over(order)).where(F.col(nth) <= F.col(times))
    return kept.select(*[F.col(f"`{c}`") for c in docs.columns])
