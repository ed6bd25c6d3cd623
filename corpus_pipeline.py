"""From raw documents to packed training sequences, in five stages.

Each stage gets all that its predecessor kept and decides on that alone; what it rejects
or removes is gone. Between stages the documents are written as Parquet and read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from musterroll.llm import langid, linededup, nearcopies, packing, pii, queries
from musterroll.llm.common import free_name, small_batches, table
from musterroll.session import scratch_path

LEAST_LANGUAGE_SCORE = 0.3


def _resized(docs: DataFrame) -> DataFrame:
    """``n_chars`` follows the text."""
    if "n_chars" not in docs.columns:
        return docs
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop texts without letters, and those that no language learnt from ``docs`` fits.

    A text with letters of which the model knows nothing is no misfit and stays.
    """
    small_batches(spark)
    lang, score, known = (free_name(docs, c) for c in ("found_language", "found_score", "found_known"))
    found = langid.predict(docs, langid.fit_on(docs), "text", lang, score, known)
    fits = ~F.col(known) | (F.col(score) >= LEAST_LANGUAGE_SCORE)
    return found.where((F.col(lang) != langid.UNDETERMINED) & fits).select(*[F.col(f"`{c}`") for c in docs.columns])


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Delete runs of lines that occurred earlier; every document stays."""
    small_batches(spark)
    return _resized(linededup.drop_repeated_lines(docs))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: the one with the smallest id."""
    small_batches(spark)
    return nearcopies.one_of_each(docs)


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace personal data by its kind; every document stays."""
    return _resized(pii.redact(docs, pii.fit(docs)))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences, with their place among the packed ones."""
    small_batches(spark)
    return packing.pack(docs, queries.word_bpe())


STAGES = [
    ("language_id", keep_known_languages),
    ("line_dedup", drop_repeated_lines),
    ("simhash_near_dedup", drop_near_copies),
    ("pii", redact_personal_data),
    ("packing", pack_sequences),
]

#: Learnt models, winnowing and packing have no form in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn over the whole table of documents; the rows of the last."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch_path(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
