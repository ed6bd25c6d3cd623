"""SimHash near-dedup by meet-in-the-middle ball hashing.

Every distinct fingerprint emits all variants within half the radius. Two fingerprints
link if and only if they share a variant, so one shuffle on variants finds all links.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from musterroll.llm.common import free_name, raw, word_runs
from musterroll.llm.components import components
from musterroll.session import written

BITS = 64
SEED = 42


def simhash(text: str | None, width: int) -> int:
    """Signed 64-bit fingerprint of the ``width``-word shingles, repeats included."""
    ones, total, held = np.zeros(BITS, dtype=np.int64), 0, []
    digest = xxhash.xxh64_intdigest

    def take(hashes: list[int]) -> None:
        nonlocal ones, total
        bits = np.array(hashes, dtype="<u8").view(np.uint8).reshape(-1, 8)
        ones = ones + np.unpackbits(bits, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        total += len(hashes)

    for words in word_runs(raw(text).lower()):
        words = held + words
        if len(words) >= width:
            line = b" ".join(words)
            sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
            ends = np.cumsum(sizes + 1) - 1
            starts = (ends - sizes)[: len(words) - width + 1].tolist()
            spans = zip(starts, ends[width - 1 :].tolist(), strict=True)
            take([digest(line[a:b], SEED) for a, b in spans])
        held = words[len(words) - min(len(words), width - 1) :]
    if not total and held:
        take([digest(b" ".join(held), SEED)])
    packed = np.packbits(2 * ones > total, bitorder="little") if total else np.zeros(8, np.uint8)
    return int(packed.view("<i8")[0])


def fingerprints(docs: DataFrame, text: str, out: str, width: int = 3) -> DataFrame:
    """``docs`` with the fingerprint of ``text`` as a long; no words (or null): zero."""

    @F.pandas_udf("long")
    def fingerprint(texts: pd.Series) -> pd.Series:
        return pd.Series([simhash(t, width) for t in texts], dtype="int64")

    return docs.withColumn(out, fingerprint(F.col(text)))


def ball_masks(reach: int) -> list[int]:
    """Signed masks of all fingerprints that differ from zero in at most ``reach`` bits."""
    masks = [sum(1 << b for b in bits) for n in range(reach + 1) for bits in combinations(range(BITS), n)]
    return [m - (1 << BITS) if m >> (BITS - 1) else m for m in masks]


def ball_links(prints: DataFrame, fingerprint: str, radius: int = 2) -> DataFrame:
    """Links ``a < b`` of distinct fingerprints that join all pairs within ``radius`` bits.

    ``radius`` is even. All fingerprints that share a variant lie within the radius of
    each other, so each is linked to the smallest only: a bucket of n gives n - 1 links,
    and its size is bounded by the volume of the ball, whatever the number of documents.
    """
    if radius % 2:
        raise ValueError("the radius must be even")
    masks = F.array(*[F.lit(m).cast("long") for m in ball_masks(radius // 2)])
    variants = prints.select(F.col(fingerprint).alias("b")).distinct().select("b", F.explode(masks).alias("m"))
    variants = variants.select("b", F.col("b").bitwiseXOR(F.col("m")).alias("variant"))
    met = variants.select("b", F.min("b").over(Window.partitionBy("variant")).alias("a"))
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius
    return met.where((F.col("a") != F.col("b")) & near).select("a", "b").distinct()


def near_groups(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = 3, radius: int = 2
) -> DataFrame:
    """``doc_id``, ``fingerprint`` (hex) and ``component_id``, one row per input row.

    Documents link if their fingerprints differ in at most ``radius`` bits;
    ``component_id`` is the smallest id reachable. Equal fingerprints are one node, so
    copies never meet as pairs. A text without words (null, empty, white space) has the
    fingerprint zero and links like any other. Rows with a null id take part in linking
    and get their component's smallest id (null if all its ids are null). An empty table
    gives no rows; other columns of ``docs``, whatever their names, play no part.
    """
    prints = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    prints = written(fingerprints(prints, "text", "fp", width).drop("text"), "prints")
    classes = prints.groupBy("fp").agg(F.min("doc_id").alias("least"))
    roots = components(ball_links(classes, "fp", radius), "a", "b")
    # Only classes with a link need a look-up; the others are components of their own.
    rooted = classes.join(roots.withColumnRenamed("node", "fp"), "fp", "left")
    rooted = rooted.select("fp", "least", F.coalesce("root", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = rooted.select("fp", "root").join(least, "root").select("fp", "component_id")
    return prints.join(named, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def one_of_each(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that stand for their group: those with its smallest id.

    Repeats of the same row all carry that id; one of them stays. Rows with a null id
    cannot be told apart and stay. Columns are those of ``docs``.
    """
    head, nth = free_name(docs, "head_doc"), free_name(docs, "nth_of_doc")
    groups = near_groups(docs, doc_id, text)
    heads = groups.where(F.col("doc_id") == F.col("component_id")).select(F.col("doc_id").alias(head)).distinct()
    kept = docs.join(heads, docs[doc_id] == F.col(head), "left_semi")
    order = Window.partitionBy(doc_id).orderBy(F.length(text).desc_nulls_last(), text)
    kept = kept.withColumn(nth, F.row_number().over(order)).where(F.col(nth) == 1).drop(nth)
    return kept.unionByName(docs.where(F.col(doc_id).isNull()))
