"""Writing cluster manifests."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from musterroll.functions.manifests import Vocabulary, cluster_documents


def spec_lines(params: DataFrame, words: Vocabulary) -> DataFrame:
    """Each parameter row with its manifest as one JSON line in ``line``."""
    documents = cluster_documents(params, words)
    return documents.withColumn("line", F.to_json("document")).drop("document")


def write_specs(params: DataFrame, words: Vocabulary, path: str) -> None:
    """One JSON line per cluster, in as many files as there are partitions."""
    spec_lines(params, words).select("line").write.mode("errorifexists").text(path)
