"""Packing of token sequences as a cutting-stock problem.

Every document is cut into full sequences and one rest. Rests are counted by length class,
column generation finds patterns of classes that fill a sequence, and the rounded patterns
are handed out by the rank of a piece within its class.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from musterroll.llm.bpe import WORD, text_pieces
from musterroll.llm.cuttingstock import plan
from musterroll.session import written

ID_BYTES = 4
_TOGETHER = 1 << 21
#: Beyond Latin letters, libraries may differ in classes and cases of letters.
_ODD = re.compile("<\\||[\x1c-\x1f\u0250-\U0010ffff]")
_MAYBE_ODD = re.compile("[<\x1c-\x1f\u0250-\U0010ffff]")
#: A sign that stands alone between a letter or digit and white space is a word of its own.
_MARK = re.compile(r"[.,;:!?](?<=[^\W_].)(?=\s|\Z)")


class _Known(dict):
    """Ids by piece; what is not known is encoded on its own, and kept up to a size."""

    def __init__(self, encode: Callable[[str], bytes], size: int):
        super().__init__()
        self.encode, self.size = encode, size

    def __missing__(self, piece: str) -> bytes:
        ids = self.encode(piece)
        if len(self) <= self.size and len(piece) <= 64:
            self[piece] = ids
        return ids


class IdBytes:
    """Ids of texts as little-endian unsigned 32-bit bytes.

    For BPE tokenizers in lower case with word ends that drop white space. What stands
    between white space is encoded once; a cache starts anew when it holds ``cached``
    entries. Words that were not met before go to the tokenizer in one text, whose ids the
    word ends divide again.
    """

    def __init__(self, path: str, end_id: int, cached: int = 1_000_000):
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        self.end, self.cached = end_id.to_bytes(ID_BYTES, "little"), cached
        vocabulary = self.tokenizer.get_vocab()
        self.closing = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.closing[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self.words, self.odd = (_Known(self._encode, cached) for _ in range(2))

    def _encode(self, piece: str) -> bytes:
        return np.array(self.tokenizer.encode(piece, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def _learn(self, pieces: set[str]) -> None:
        """Encode new pieces in lower case, made of Latin letters and ASCII signs."""
        words = self.words
        if len(words) > self.cached:
            words.clear()
        new = pieces.difference(words)
        wanted = list(filter(str.isalpha, new))
        for at in range(0, len(wanted), 4000):
            some = wanted[at : at + 4000]
            ids = np.array(self.tokenizer.encode(" ".join(some), add_special_tokens=False).ids, dtype="<u4")
            ends = np.flatnonzero(self.closing[ids]) + 1
            if len(ends) == len(some):
                flat, stops = ids.tobytes(), (ends * ID_BYTES).tolist()
                words.update(zip(some, [flat[i:j] for i, j in zip([0, *stops[:-1]], stops, strict=True)], strict=True))
        for piece in new.difference(wanted):
            words[piece] = b"".join([words[w] for w in WORD.findall(piece)])

    def of(self, texts: list[str]) -> list[bytes]:
        """The ids of each text and the end; texts are taken together up to a bounded size."""
        out, held, size = [], [], 0
        for text in texts:
            held.append(text)
            size += len(text)
            if size >= _TOGETHER:
                out += self._of_some(held)
                held, size = [], 0
        return out + self._of_some(held)

    def _of_some(self, texts: list[str]) -> list[bytes]:
        if len(texts) == 1 and len(texts[0]) >= _TOGETHER:
            blocks = (b"".join(map(self.odd.__getitem__, pieces)) for pieces in text_pieces(texts[0]))
            return [b"".join([*blocks, self.end])]
        plain = [None if _MAYBE_ODD.search(t) and _ODD.search(t) else _MARK.sub(r" \g<0>", t.lower()).split() for t in texts]
        self._learn(set().union(*(pieces for pieces in plain if pieces)))
        out = []
        for text, pieces in zip(texts, plain, strict=True):
            if pieces is None:
                own = [self.odd[p] for block in text_pieces(text) for p in block]
            else:
                own = map(self.words.__getitem__, pieces)
            out.append(b"".join([*own, self.end]))
        return out


@cache
def worker_id_bytes(path: str, end_id: int) -> IdBytes:
    """One per worker process, so that later tasks find its words."""
    return IdBytes(path, end_id)


def token_pieces(
    docs: DataFrame, ids_of: Callable[[], Callable[[list[str]], list[bytes]]], room: int, grain: int, with_ids: bool
) -> DataFrame:
    """Pieces of at most ``room`` ids, with their rank among the same class in the partition."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids_of_texts = ids_of()
        part, ranks = TaskContext.get().partitionId(), {}
        for batch in batches:
            rows = []
            coded = ids_of_texts(["" if t is None else t for t in batch["text"]])
            for doc, ids in zip(batch["doc"], coded, strict=True):
                total = len(ids) // ID_BYTES
                for start in range(0, total, room):
                    length = min(room, total - start)
                    size = -(-length // grain)
                    ranks[size] = ranks.get(size, -1) + 1
                    own = ids[ID_BYTES * start : ID_BYTES * (start + length)]
                    rows.append((doc, start, length, zlib.crc32(own), total, size, part, ranks[size], own if with_ids else None))
            yield pd.DataFrame(rows, columns=["doc", "start", "length", "ids_crc32", "doc_tokens", "size", "part", "nth", "ids"])

    kind = docs.schema["doc"].dataType.simpleString()
    return docs.mapInPandas(cut, (
        f"doc {kind}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, "
        "size int, part int, nth bigint, ids binary"
    ))


def pack(
    docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text", room: int = 4096, end_id: int = 2,
    grain: int = 8, with_ids: bool = False,
) -> DataFrame:
    """Pieces of all documents with their place: ``sequence_id`` and ``offset``.

    Ids are those of the tokenizer file ``path`` (the same on every node; it has to drop
    white space), followed by ``end_id``; a null or empty text is that id alone. Columns:
    ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset``, and ``ids``
    (little-endian unsigned 32-bit) with ``with_ids``. Every id lies in one piece, every
    sequence holds at most ``room`` ids from offset 0 on without gaps. Rests compare by
    classes of ``grain`` ids, which bounds padding to ``grain - 1`` a piece plus what the
    last, rounded patterns leave open. Repeated rows and null ids are packed like others;
    further columns play no part; an empty table gives no rows.

    The driver sees the histogram of classes (``room / grain`` rows) and the patterns: at
    most one per class after rounding, and the rest of one sequence each. Ranks come from
    counts per class and partition, so no class is sorted or gathered as a whole.
    """
    source = docs.select(F.col(doc_id).alias("doc"), F.col(text).alias("text"))
    pieces = token_pieces(source, lambda: worker_id_bytes(path, end_id).of, room, grain, with_ids)
    pieces = written(pieces, "pieces")
    counts = written(pieces.groupBy("size", "part").agg(F.count(F.lit(1)).alias("n")), "counts")
    histogram = {r["size"]: r["n"] for r in counts.groupBy("size").agg(F.sum("n").alias("n")).collect()}
    rows, sequence, ranks = [], 0, dict.fromkeys(histogram, 0)
    for pattern in plan(histogram, room // grain):
        for size, copies in pattern.copies.items():
            first, ranks[size] = ranks[size], ranks[size] + copies * pattern.bins
            rows.append((size, first, ranks[size], copies, sequence))
        sequence += pattern.bins
    places = docs.sparkSession.createDataFrame(
        rows, "at_size int, first_rank bigint, end_rank bigint, copies bigint, first_sequence bigint"
    )
    earlier = Window.partitionBy("size").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select("size", "part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    ranked = pieces.join(before, ["size", "part"]).withColumn("rank", F.col("before") + F.col("nth"))
    own = (F.col("size") == F.col("at_size")) & (F.col("rank") >= F.col("first_rank")) & (F.col("rank") < F.col("end_rank"))
    placed = ranked.join(F.broadcast(places), own)
    place = F.col("rank") - F.col("first_rank")
    placed = placed.withColumn("sequence_id", F.col("first_sequence") + F.floor(place / F.col("copies")).cast("long"))
    inside = Window.partitionBy("sequence_id").orderBy(F.desc("size"), "rank")
    offset = F.sum("length").over(inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("length")
    columns = [F.col("doc").alias(doc_id), "start", "length", "ids_crc32", "doc_tokens", "sequence_id", offset.alias("offset")]
    return placed.select(*columns, *["ids"] * with_ids)
