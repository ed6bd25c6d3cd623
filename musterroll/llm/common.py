"""Small helpers of the training-data operators."""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

BLOCK_BYTES = 1 << 20
BATCH_ROWS = 512
_SPACE = re.compile(rb"[\x20\x09-\x0D]")
#: Per byte of UTF-8: A-Z in lower case, other ASCII letters and digits, and all bytes beyond
#: ASCII as they are; every other ASCII character is a blank.
WORD_BYTES = bytes(b if b > 127 else ord(chr(b).lower()) if chr(b).isalnum() else 32 for b in range(256))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Hand at most ``rows`` texts to Python at once, since one text may be very long."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key)) > rows or int(spark.conf.get(key)) <= 0:
        spark.conf.set(key, str(rows))


def free_name(df: DataFrame, wanted: str, *also: str | None) -> str:
    """``wanted``, with underscores in front until no column of ``df`` nor one of ``also`` has that name."""
    taken = {c.lower() for c in [*df.columns, *also] if c}
    while wanted.lower() in taken:
        wanted = f"_{wanted}"
    return wanted


def plain_words(text: str | None) -> Iterator[list[bytes]]:
    """Lower-cased words of ASCII letters, digits and all that is beyond ASCII, in lists."""
    return word_runs(raw(text).translate(WORD_BYTES))


def raw(text: str | None) -> bytes:
    """UTF-8 bytes; a null is an empty text, lone surrogates become question marks."""
    return b"" if text is None else text.encode("utf-8", "replace")


def word_runs(data: bytes, size: int = BLOCK_BYTES) -> Iterator[list[bytes]]:
    """White-space separated words in lists, each of about ``size`` bytes of text.

    White space is ``[\\x20\\x09-\\x0D]``, which is what ``bytes.split`` takes.
    """
    start = 0
    while len(data) - start > size:
        cut = _SPACE.search(data, start + size)
        if cut is None:
            break
        if words := data[start : cut.start()].split():
            yield words
        start = cut.end()
    if words := (data[start:] if start else data).split():
        yield words
