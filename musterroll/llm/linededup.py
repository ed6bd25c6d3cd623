"""Line dedup by winnowing over line hashes.

A gram is the shortest run of lines from some line on that holds ``gram_words`` words; a
window is the shortest run that holds ``window_words``. Every window selects the smallest
gram hash inside it, so any repeated run of ``window_words`` words shares a selected gram
with its earlier occurrence. Equal grams are joined by position, each match is extended
line by line in both directions, and the later of both runs is deleted. Where a gram occurs
more than twice, whole windows are joined as well, by their hashes.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from musterroll.llm.common import free_name, raw
from musterroll.operators.heat import with_previous
from musterroll.session import written

KEY = ["doc", "body"]
_ENDLESS = 1 << 62


def line_hashes(text: str | None) -> tuple[list[int], list[int], list[int]]:
    """Line number, signed hash and word count of each line that has words."""
    numbers, hashes, counts = [], [], []
    for number, line in enumerate(raw(text).split(b"\n")):
        if words := line.split():
            numbers.append(number)
            hashes.append(xxhash.xxh64_intdigest(b" ".join(words)) - (1 << 63))
            counts.append(len(words))
    return numbers, hashes, counts


def _run_ends(counts: list[int], least: int) -> list[int]:
    """For each start the last line of the shortest run with ``least`` words."""
    ends, total, end = [], 0, -1
    for start, count in enumerate(counts):
        while total < least and end + 1 < len(counts):
            end += 1
            total += counts[end]
        ends.append(end if total >= least else _ENDLESS)
        total -= count
    return ends


def selected(hashes: list[int], counts: list[int], gram_words: int, window_words: int) -> list[tuple[int, int]]:
    """(gram hash, first line) of the window minima; equal minima select the later one.

    A text that is shorter than one window is one window.
    """
    if not hashes:
        return []
    flat = np.array(hashes, dtype="<i8").tobytes()
    gram_ends = _run_ends(counts, gram_words)
    window_ends = _run_ends(counts, window_words)
    if window_ends[0] == _ENDLESS:
        window_ends = [len(counts) - 1]
    least: deque[tuple[int, int]] = deque()
    picks, entering = {}, 0
    for start, window_end in enumerate(window_ends):
        if window_end == _ENDLESS:
            break
        while entering < len(counts) and gram_ends[entering] <= window_end:
            value = xxhash.xxh64_intdigest(flat[8 * entering : 8 * gram_ends[entering] + 8]) - (1 << 63)
            while least and least[-1][0] >= value:
                least.pop()
            least.append((value, entering))
            entering += 1
        while least and least[0][1] < start:
            least.popleft()
        if least:
            picks[least[0][1]] = least[0][0]
    return [(value, line) for line, value in picks.items()]


def windows(hashes: list[int], counts: list[int], gram_words: int, window_words: int) -> list[tuple[int, int]]:
    """(window hash, line of the gram it selects) of the runs that any long repeat is made of.

    From each line on, these are the shortest run of ``window_words`` words and the longer
    ones that hold fewer without that line: a run of that many words has its first lines in
    the former and its last ones in one of the latter. All select by the shortest run.
    """
    gram_ends, window_ends = _run_ends(counts, gram_words), _run_ends(counts, window_words)
    if not hashes or window_ends[0] == _ENDLESS:
        return []
    flat = np.array(hashes, dtype="<i8").tobytes()
    least: deque[tuple[int, int]] = deque()
    found, entering = [], 0
    for start, end in enumerate(window_ends):
        if end == _ENDLESS:
            break
        while entering < len(counts) and gram_ends[entering] <= end:
            value = xxhash.xxh64_intdigest(flat[8 * entering : 8 * gram_ends[entering] + 8])
            while least and least[-1][0] >= value:
                least.pop()
            least.append((value, entering))
            entering += 1
        while least and least[0][1] < start:
            least.popleft()
        after = min(window_ends[start + 1], len(counts)) if start + 1 < len(counts) else len(counts)
        digest = xxhash.xxh64(flat[8 * start : 8 * end + 8])
        for last in range(end, max(after, end + 1)):
            if last > end:
                digest.update(flat[8 * last : 8 * last + 8])
            if least:
                found.append((digest.intdigest() - (1 << 63), least[0][1]))
    return found


def extended(later: np.ndarray, earlier: np.ndarray, at: int, to: int) -> tuple[int, int]:
    """First and last line of the maximal run in ``later`` that runs through the match."""
    back = min(at, to)
    differs = np.flatnonzero(later[at - back : at] != earlier[to - back : to])
    first = at - back + (differs[-1] + 1 if len(differs) else 0)
    ahead = min(len(later) - at, len(earlier) - to)
    differs = np.flatnonzero(later[at : at + ahead] != earlier[to : to + ahead])
    return int(first), int(at + (differs[0] if len(differs) else ahead) - 1)


def _line_table(docs: DataFrame, gram_words: int, window_words: int) -> DataFrame:
    def lines_of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for doc, body, text in zip(batch["doc"], batch["body"], batch["text"], strict=True):
                numbers, hashes, counts = line_hashes(text)
                picks = selected(hashes, counts, gram_words, window_words)
                by_line = {line: [] for _, line in picks}
                for window, line in windows(hashes, counts, gram_words, window_words):
                    by_line[line].append(window)
                picked = [{"gram": g, "line": p} for g, p in picks]
                rows.append((doc, body, numbers, hashes, picked, [by_line[p] for _, p in picks]))
            yield pd.DataFrame(rows, columns=["doc", "body", "numbers", "hashes", "picks", "windows"])

    key_type = docs.schema["doc"].dataType.simpleString()
    return docs.mapInPandas(
        lines_of,
        f"doc {key_type}, body bigint, numbers array<int>, hashes array<bigint>, "
        "picks array<struct<gram: bigint, line: int>>, windows array<array<bigint>>",
    )


def _cut_runs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        runs = []
        for row in batch.itertuples(index=False):
            later, earlier, numbers = np.asarray(row.hashes), np.asarray(row.hashes_e), row.numbers
            covered: dict[int, int] = {}
            found = []
            for match in sorted(row.matches, key=lambda m: m["line"]):
                at, to = match["line"], match["line_e"]
                if covered.get(at - to, -1) < at:
                    first, last = extended(later, earlier, at, to)
                    covered[at - to] = last
                    found.append({"first": int(numbers[first]), "last": int(numbers[last])})
            runs.append(found)
        yield pd.DataFrame({"doc": batch["doc"], "body": batch["body"], "runs": runs})


def repeated_runs(docs: DataFrame, gram_words: int, window_words: int) -> DataFrame:
    """``doc``, ``body`` and the runs (first and last line number) that occurred earlier.

    ``docs`` has ``doc``, ``body`` (hash of the text) and ``text``. Order is by id, body and
    line; rows that agree in id and text are one document. Each selected gram is matched
    with its first and with its previous occurrence, never with all of them. Where it has
    more, every window that selects it is matched with the first occurrence of that window.
    """
    lines = written(_line_table(docs, gram_words, window_words).dropDuplicates(KEY), "lines")
    places = lines.select(*KEY, F.explode("picks").alias("pick")).select(*KEY, "pick.gram", "pick.line")
    place = ["doc", "body", "line"]
    counted = places.groupBy("gram").agg(
        F.count(F.lit(1)).alias("n"), F.min(F.struct(*place)).alias("first")
    ).where("n > 1")
    first = places.join(counted, "gram").where(F.struct(*place) != F.col("first"))
    first = first.select(*place, *[F.col(f"first.{c}").alias(f"{c}_e") for c in place])
    previous = with_previous(
        places.join(counted.select("gram"), "gram", "left_semi"), ["gram"], place, {f"{c}_e": c for c in place}
    )
    previous = previous.where("line_e IS NOT NULL").select(first.columns)
    of_windows = lines.select(*KEY, F.explode(F.arrays_zip("picks", "windows")).alias("pick"))
    of_windows = of_windows.select(*KEY, "pick.picks.gram", "pick.picks.line", "pick.windows")
    of_windows = of_windows.join(counted.where("n > 2").select("gram"), "gram", "left_semi")
    of_windows = of_windows.select(*place, F.explode("windows").alias("window"))
    repeated = of_windows.groupBy("window").agg(
        F.count(F.lit(1)).alias("n"), F.min(F.struct(*place)).alias("first")
    ).where("n > 1")
    whole = of_windows.join(repeated, "window").where(F.struct(*place) != F.col("first"))
    whole = whole.select(*place, *[F.col(f"first.{c}").alias(f"{c}_e") for c in place])
    pairs = first.union(previous).union(whole).groupBy(*KEY, "doc_e", "body_e").agg(
        F.collect_set(F.struct("line", "line_e")).alias("matches")
    )
    earlier = lines.select(*[F.col(c).alias(f"{c}_e") for c in [*KEY, "hashes"]])
    both = pairs.join(earlier, ["doc_e", "body_e"]).join(lines.select(*KEY, "hashes", "numbers"), KEY)
    key_type = docs.schema["doc"].dataType.simpleString()
    runs = both.select(*KEY, "matches", "hashes", "hashes_e", "numbers").mapInPandas(
        _cut_runs, f"doc {key_type}, body bigint, runs array<struct<first: int, last: int>>"
    )
    return runs.groupBy(*KEY).agg(F.flatten(F.collect_list("runs")).alias("runs"))


def _without(texts: pd.Series, runs: pd.Series) -> pd.DataFrame:
    out = []
    for text, found in zip(texts, runs, strict=True):
        lines = (text or "").split("\n")
        if found is None or len(found) == 0:
            out.append((text, len(lines), 0))
            continue
        kept, at = [], 0
        for first, last in sorted((r["first"], r["last"]) for r in found):
            kept += lines[at:first] if first > at else []
            at = max(at, last + 1)
        kept += lines[at:]
        out.append(("\n".join(kept), len(lines), len(lines) - len(kept)))
    return pd.DataFrame(out, columns=["kept", "lines", "removed"])


def drop_repeated_lines(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", gram_words: int = 10, window_words: int = 50,
    n_lines: str | None = None, n_removed: str | None = None,
) -> DataFrame:
    """``docs`` with ``text`` freed of runs of lines that occurred earlier.

    Earlier means: in a document with a smaller id (null first), or higher up in the same
    one. Lines compare by their words; lines without words never match, but go if both
    neighbours in a run go. A run of at least ``window_words`` words that repeats whole
    lines of an earlier one is always found; shorter ones down to ``gram_words`` words
    where they are selected. The first occurrence stays, and so does every row: a full
    copy keeps an empty text. A null text stays null and an empty one empty. Rows that
    agree in id and text are treated alike. Other columns are passed on; ``n_lines`` and
    ``n_removed`` name columns to add with the counts.
    """
    body = F.xxhash64(F.col(text))
    source = docs.select(F.col(doc_id).alias("doc"), body.alias("body"), F.col(text).alias("text"))
    runs = repeated_runs(source, gram_words, window_words)
    own_doc, own_body, own_runs, cut_text = (free_name(docs, c) for c in ("cut_doc", "cut_body", "cut_runs", "cut_text"))
    runs = runs.select(F.col("doc").alias(own_doc), F.col("body").alias(own_body), F.col("runs").alias(own_runs))
    same = docs[doc_id].eqNullSafe(runs[own_doc]) & (body == runs[own_body])
    without = F.pandas_udf(_without, "struct<kept: string, lines: bigint, removed: bigint>")
    cut = docs.join(runs, same, "left").withColumn(cut_text, without(F.col(text), F.col(own_runs)))
    columns = [F.col(f"{cut_text}.kept").alias(c) if c == text else F.col(f"`{c}`") for c in docs.columns]
    added = [F.col(f"{cut_text}.{f}").alias(c) for f, c in (("lines", n_lines), ("removed", n_removed)) if c]
    return cut.select(*columns, *added)
