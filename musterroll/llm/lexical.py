"""Ranked lexical search with the Best Position Algorithm.

Documents are searched in blocks that a task builds as it reads: impact lists of the block
for all terms asked for, then one Best Position run per query, which carries the kth score
from block to block. A task gives its best rows only, and those are ranked once more.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from musterroll.llm.bestposition import Best, ImpactLists
from musterroll.llm.common import plain_words

#: Postings of a block.
BLOCK_POSTINGS = 1_000_000
#: Bytes of query texts that are searched for in one pass over the documents.
QUERY_BYTES = 8 << 20
_SALTS = 256


@dataclass(frozen=True)
class Weights:
    """Integer weights: ``w * ((10^9 tf) div (1000 tf + saturation * m))`` with
    ``m = 100 - slope + slope * n * N div L``."""

    slope: int = 90
    saturation: int = 8

    def of_term(self, n_docs: int, df: int) -> int:
        return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))

    def of_length(self, n: int, n_docs: int, all_terms: int) -> int:
        return 100 - self.slope + self.slope * n * n_docs // all_terms


def _known(text: str | None, number: dict[bytes, int]) -> tuple[int, dict[int, int]]:
    """Length of a text in terms, and how often it holds each term that is asked for."""
    length, counts = 0, Counter()
    for words in plain_words(text):
        length += len(words)
        counts.update(words)
    return length, {number[w]: counts[w] for w in counts.keys() & number.keys()}


def collection_counts(docs: DataFrame, number: dict[bytes, int]) -> tuple[int, int, np.ndarray]:
    """Documents with a term, all their terms, and documents per term asked for."""

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n_docs = n_terms = 0
        held = np.zeros(len(number), dtype=np.int64)
        for batch in batches:
            for text in batch["text"]:
                length, counts = _known(text, number)
                n_docs += length > 0
                n_terms += length
                held[list(counts)] += 1
        found = np.flatnonzero(held)
        yield pd.DataFrame({"term": [-2, -1, *found], "n": [n_docs, n_terms, *held[found]]})

    parts = docs.select("text").mapInPandas(counted, "term bigint, n bigint")
    totals = {r["term"]: r["n"] for r in parts.groupBy("term").agg(F.sum("n").alias("n")).collect()}
    held = np.array([totals.get(i, 0) for i in range(len(number))], dtype=np.int64)
    return totals.get(-2, 0), totals.get(-1, 0), held


def _query_chunks(items: DataFrame, text: str, most_bytes: int) -> list[list[tuple]]:
    """Queries with a text, in lists of bounded size, read partition by partition."""
    chunks, held = [[]], 0
    for row in items.where(F.length(text) > 0).toLocalIterator():
        size = len(row["text"])
        if held and held + size > most_bytes:
            chunks.append([])
            held = 0
        chunks[-1].append((row["item"], row["text"]))
        held += size
    return chunks


def _search_chunk(docs: DataFrame, queries: list[tuple], item_type: str, k: int, weights: Weights) -> DataFrame:
    number: dict[bytes, int] = {}
    asked = []
    for _, text in queries:
        words = {w for block in plain_words(text) for w in block}
        asked.append(np.array(sorted(number.setdefault(w, len(number)) for w in words), dtype=np.int64))
    n_docs, all_terms, held = collection_counts(docs, number)
    term_weights = np.array([weights.of_term(n_docs, df) if df else 0 for df in held.tolist()], dtype=np.int64)

    def searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [Best.none(k) for _ in asked]
        keys, owners, terms, counts, norms = [], [], [], [], []
        key_kind = pa.null()

        def search() -> None:
            tf, norm = np.array(counts, dtype=np.int64), np.array(norms, dtype=np.int64)
            doc, term = np.array(owners, dtype=np.int64), np.array(terms, dtype=np.int64)
            impacts = term_weights[term] * (1_000_000_000 * tf // (1000 * tf + weights.saturation * norm))
            good = impacts > 0
            ids = np.empty(len(keys), dtype=object)
            ids[:] = keys
            lists = ImpactLists(doc[good], term[good], impacts[good], ids, len(number))
            for query, own in zip(asked, best, strict=True):
                lists.search(query, own)
            for column in (keys, owners, terms, counts, norms):
                column.clear()

        for batch in batches:
            key_kind = batch.schema.field("doc").type
            for key, text in zip(batch["doc"].to_pylist(), batch["text"].to_pylist(), strict=True):
                length, found = _known(text, number)
                if found:
                    owners += [len(keys)] * len(found)
                    terms += found.keys()
                    counts += found.values()
                    norms += [weights.of_length(length, n_docs, all_terms)] * len(found)
                    keys.append(key)
                if len(terms) >= BLOCK_POSTINGS:
                    search()
        if keys:
            search()
        found = [i for i, own in enumerate(best) for _ in own.keys]
        part = [TaskContext.get().partitionId() % _SALTS] * len(found)
        if found:
            yield pa.RecordBatch.from_arrays([
                pa.array(found, pa.int64()), pa.array([key for own in best for key in own.keys], key_kind),
                pa.array(np.concatenate([own.scores for own in best])), pa.array(part, pa.int32()),
            ], ["query", "doc", "score", "part"])

    key_type = docs.schema["doc"].dataType.simpleString()
    rows = docs.mapInArrow(searched, f"query bigint, doc {key_type}, score bigint, part int")
    # Two steps, so that no task gets the rows of all blocks for a query.
    order = [F.desc("score"), F.asc_nulls_last("doc")]
    some = rows.withColumn("nth", F.row_number().over(Window.partitionBy("query", "part").orderBy(*order)))
    nth = F.row_number().over(Window.partitionBy("query").orderBy(*order))
    best_rows = some.where(F.col("nth") <= k).withColumn("rank", nth).where(F.col("rank") <= k)
    names = docs.sparkSession.createDataFrame([(i, item) for i, (item, _) in enumerate(queries)], f"own bigint, item {item_type}")
    named = best_rows.join(F.broadcast(names), F.col("query") == F.col("own"))
    return named.select("item", F.col("rank").cast("int").alias("rank"), "doc", "score")


def search(
    docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id",
    item_text: str = "text", k: int = 10, weights: Weights = Weights(), most_bytes: int = QUERY_BYTES,
) -> DataFrame:
    """``item_id, rank, doc_id, score``: the ``k`` best documents for every row of ``items``.

    Terms are runs of ASCII letters and digits and of all characters beyond ASCII, with only
    A-Z lower-cased. A document scores the sum of its weights over the query's terms, each
    once; only scores above 0 count, equal ones go by id (nulls last). A document or query
    without terms (null, empty) gets and gives nothing. Repeated rows on either side are
    documents and queries of their own; empty tables give no rows. Other columns, whatever
    their names, play no part.

    Statistics cover all documents. A pass over the documents is narrow and serves as many
    queries as fit in ``most_bytes`` of text, which every task gets; more queries take
    further passes, one per ``most_bytes``. Memory of a task: the postings of a block, and
    ``k`` rows per query. Its rows are ``k`` per query at most, which are what is shuffled.
    """
    source = docs.select(F.col(doc_id).alias("doc"), F.col(text).alias("text"))
    asked = items.select(F.col(item_id).alias("item"), F.col(item_text).alias("text"))
    item_type = asked.schema["item"].dataType.simpleString()
    found = None
    for queries in _query_chunks(asked, "text", most_bytes):
        part = _search_chunk(source, queries, item_type, k, weights)
        found = part if found is None else found.unionByName(part)
    return found.select(F.col("item").alias(item_id), "rank", F.col("doc").alias(doc_id), "score")
