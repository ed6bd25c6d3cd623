"""Embedding near-dedup by iterative quantisation and multi-index Hamming tables.

Rotations learnt for balanced binary codes turn vectors into bits. Codes are cut into
strings of about log2(n) bits, one Hamming table for each; vectors that agree in a string
meet in its bucket and are compared with their original components. Longer strings agree
more rarely, so there are as many tables as pairs planted at the threshold need to meet.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from musterroll.llm.components import components
from musterroll.llm.topk import usable
from musterroll.session import written

_GROUP = ["nth", "string", "low", "high"]
_MET = "a bigint, b bigint, weight bigint"


def learn_rotation(sample: np.ndarray, seed: int, rounds: int = 30) -> np.ndarray:
    """Rotation that brings the (principal) axes of ``sample`` close to the binary cube.

    Alternates between the codes of the rotated sample and the rotation that fits them
    best (an orthogonal Procrustes problem).
    """
    size = sample.shape[1]
    _, _, axes = np.linalg.svd(sample, full_matrices=len(sample) < size)
    projected = sample @ axes.T
    rotation, _ = np.linalg.qr(np.random.default_rng(seed).normal(size=(size, size)))
    for _ in range(rounds):
        left, _, right = np.linalg.svd(projected.T @ np.sign(projected @ rotation))
        rotation = left @ right
    return axes.T @ rotation


def unit_rows(vectors: list) -> np.ndarray:
    """Rows of length one in double precision; scaled first, so that squares stay finite."""
    rows = np.vstack(vectors).astype(float)
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


class Tables:
    """Strings of the binary code of a vector: one per Hamming table."""

    def __init__(self, turn: np.ndarray, center: np.ndarray, bits: int, tables: int):
        self.turn, self.center, self.bits, self.tables = turn[:, : bits * tables], center, bits, tables
        self.powers = 1 << np.arange(bits, dtype=np.int64)

    def strings(self, units: np.ndarray) -> np.ndarray:
        # Above zero by more than rounding, so that a row gets the same bits in any batch.
        codes = (units - self.center) @ self.turn > 1e-9
        return codes.reshape(len(units), self.tables, self.bits) @ self.powers


def planted(units: np.ndarray, cosine: float, rows: int, seed: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Pairs of unit rows with this cosine, in two sets of ``rows``.

    The rows of ``units`` in turn, moved in any direction, and moved towards other rows.
    """
    rng = np.random.default_rng(seed)
    left = units[np.arange(rows) % len(units)]
    out = []
    for aside in (rng.normal(size=left.shape), units[rng.integers(0, len(units), rows)]):
        aside = aside - (aside * left).sum(axis=1, keepdims=True) * left
        length = np.linalg.norm(aside, axis=1, keepdims=True)
        aside = np.where(length > 1e-6, aside / np.maximum(length, 1e-6), 0)
        right = cosine * left + np.sqrt(1 - cosine**2) * aside
        whole = np.abs((left * right).sum(axis=1) / np.maximum(np.linalg.norm(right, axis=1), 1e-9) - cosine) < 1e-6
        if whole.any():
            out.append((left[whole], right[whole]))
    return out


def fit(units: np.ndarray, count: int, threshold: float, recall: float, least: int, most: int, seed: int) -> Tables:
    """Tables in which ``recall`` of the pairs planted at the threshold meet.

    A string has log2 of the number of vectors as bits (12 to 30), so that the buckets of
    unrelated vectors keep their size as the table grows. If ``most`` tables are too few,
    strings are shortened until they do; without bits all vectors meet.
    """
    size = units.shape[1]
    # Rotations fit the rows they are learnt from better than others: plant on other rows.
    apart = np.arange(len(units)) % 4 == 3 if len(units) >= 64 else np.zeros(len(units), dtype=bool)
    sets = planted(units[apart] if apart.any() else units, float(np.clip(threshold, -1, 1)), 2048, seed)
    units = units[~apart]
    center = units.mean(axis=0)
    turn, codes = np.zeros((size, 0)), [(np.zeros((len(x), 0), bool),) * 2 for x, _ in sets]
    rotations = 0
    for bits in range(int(np.clip(round(np.log2(max(count, 2))), 12, 30)), 0, -1):
        met, tables = [np.zeros(len(x), dtype=bool) for x, _ in sets], 0
        while tables < most:
            while turn.shape[1] < bits * (tables + 1):
                more = learn_rotation(units - center, seed + rotations)
                rotations, turn = rotations + 1, np.hstack([turn, more])
                codes = [tuple(np.hstack([c, (v - center) @ more > 1e-9]) for c, v in zip(cs, vs, strict=True))
                         for cs, vs in zip(codes, sets, strict=True)]
            own = slice(bits * tables, bits * (tables + 1))
            for m, (a, b) in zip(met, codes, strict=True):
                m |= (a[:, own] == b[:, own]).all(axis=1)
            tables += 1
            if tables >= least and all(m.mean() >= recall for m in met):
                return Tables(turn, center, bits, tables)
    return Tables(turn, center, 0, 1)


def learn(vectors: DataFrame, count: int, threshold: float, recall: float, least: int, most: int, sample_rows: int, seed: int) -> Tables:
    """Tables from at most ``sample_rows`` distinct vectors, chosen by a hash."""
    rows = vectors.orderBy(F.xxhash64("h"), "node").limit(sample_rows).select("v").collect()
    return fit(unit_rows([r["v"] for r in rows]), count, threshold, recall, least, most, seed)


def _strings_of(tables: Tables):
    def strings(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            found = tables.strings(unit_rows(list(batch))) if len(batch) else np.zeros((0, tables.tables))
            yield pd.Series(list(found), dtype=object)

    return F.pandas_udf(strings, "array<int>")


def _spanning(left: np.ndarray, right: np.ndarray, n: int) -> list[tuple[int, int]]:
    """Pairs that keep all rows connected which the given pairs connect: fewer than ``n``."""
    root = list(range(n))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    kept = []
    for a, b in zip(left.tolist(), right.tolist(), strict=True):
        u, v = find(a), find(b)
        if u != v:
            root[max(u, v)] = min(u, v)
            kept.append((a, b))
    return kept


def _pair_up(x, y, index: Tables, nth: int, same: bool, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers of the pairs within the threshold that meet in no table before ``nth``."""
    found = []
    for at in range(0, len(x), 512):
        near = x[at : at + 512] @ y.T >= threshold
        if same:
            near &= np.arange(at, at + len(near))[:, None] < np.arange(len(y))
        i, j = np.nonzero(near)
        i += at
        if nth and len(i):
            i, j = _first_met(x, y, i, j, index, nth)
        found.append((i, j))
    return tuple(np.concatenate(f) for f in zip(*found, strict=True))


def _first_met(x, y, i, j, index: Tables, nth: int) -> tuple[np.ndarray, np.ndarray]:
    """Those of the pairs whose first common string is the ``nth``; strings are made anew."""
    (left, a), (right, b) = (np.unique(k, return_inverse=True) for k in (i, j))
    xs, ys = index.strings(x[left])[:, :nth], index.strings(y[right])[:, :nth]
    first = np.concatenate([
        ~(xs[a[at : at + 65536]] == ys[b[at : at + 65536]]).any(axis=1) for at in range(0, len(i), 65536)])
    return i[first], j[first]


def _meet(index: Tables, threshold: float):
    """Compare the rows of each bucket (or pair of its parts) among a group of buckets."""

    def meet(block: pd.DataFrame) -> pd.DataFrame:
        block = block.sort_values(_GROUP + ["part"], kind="stable")
        keys = block[_GROUP].to_numpy(np.int64)
        units = unit_rows(list(block["v"]))
        node, copies, part = (block[c].to_numpy(np.int64) for c in ("node", "copies", "part"))
        cuts = np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1
        out = []
        for start, end in zip([0, *cuts], [*cuts, len(keys)], strict=True):
            nth, _, low, high = keys[start].tolist()
            middle = start + int(np.searchsorted(part[start:end], high)) if low < high else start
            left = slice(start, middle if low < high else end)
            right = slice(middle, end)
            if left.stop - left.start == 0 or end - middle == 0:
                continue
            i, j = _pair_up(units[left], units[right], index, nth, low == high, threshold)
            if len(i):
                i, j = i + left.start, j + right.start
                rows, place = np.unique(np.concatenate([i, j]), return_inverse=True)
                others = np.bincount(place, np.concatenate([copies[j], copies[i]]))
                out.append(np.column_stack([node[rows], node[rows], others.astype(np.int64)]))
                kept = np.array(_spanning(place[: len(i)], place[len(i) :], len(rows)))
                out.append(np.column_stack([node[rows[kept]], np.zeros(len(kept), dtype=np.int64)]))
        found = np.vstack(out) if out else np.zeros((0, 3), dtype=np.int64)
        return pd.DataFrame(found, columns=["a", "b", "weight"])

    return meet


def near_vectors(
    vectors: DataFrame, threshold: float = 0.9, vec_id: str = "vec_id", vector: str = "embedding",
    tables: int = 16, sample_rows: int = 4096, block_rows: int = 1024, seed: int = 5,
    recall: float = 0.95, most_tables: int = 384,
) -> DataFrame:
    """``vec_id, n_links, component_id, kept``, one row per input row.

    Two vectors link if they meet in a table and their cosine in double precision is at
    least ``threshold``; every row is indexed. There are at least ``tables`` tables, and as
    many as let ``recall`` of pairs planted at the threshold meet, whatever the size of the
    table; strings get shorter where ``most_tables`` are too few for that.
    ``n_links`` counts the other rows linked directly, ``component_id`` is the smallest id
    reachable, ``kept`` marks the row with that id. Vectors that are null, empty, zero or
    hold a null or a non-finite component, and rows with a null id, link with nothing and
    stand for themselves (a null id: null component, kept). Vectors of different lengths
    do not link. Other columns play no part.

    Equal vectors are one node with a weight and never meet. A bucket is cut in parts of
    about ``block_rows`` by a hash, and every pair of parts is compared on its own; it
    returns link counts and a spanning forest, never all pairs.
    """
    rows = vectors.select(F.col(vec_id).alias("vec_id"), F.col(vector).alias("v"))
    linked = F.col("vec_id").isNotNull() & usable(F.col("v"))
    linked = linked & F.exists("v", lambda x: x != 0)
    plain = F.transform("v", lambda x: F.when(x == 0, F.abs(x)).otherwise(x))  # one zero only
    rows = rows.withColumn("v", F.when(linked, plain)).withColumn("h", F.xxhash64("v"))
    rows = written(rows, "vectors")
    nodes = rows.where("v IS NOT NULL").groupBy("h", "v").agg(
        F.min("vec_id").alias("node"), F.count(F.lit(1)).alias("copies"))
    nodes = written(nodes.withColumn("size", F.size("v")), "nodes")
    sizes = nodes.groupBy("size").agg(F.count(F.lit(1)).alias("n")).collect()
    met = None
    for size, count in sorted((r["size"], r["n"]) for r in sizes):
        found = _meetings(nodes.where(F.col("size") == size), count, threshold, recall, tables, most_tables, sample_rows, block_rows, seed)
        met = found if met is None else met.union(found)
    if met is None:
        met = vectors.sparkSession.createDataFrame([], _MET)
    met = written(met, "met")
    roots = components(met.where("weight = 0"), "a", "b")
    counts = met.where("weight > 0").groupBy(F.col("a").alias("node")).agg(F.sum("weight").alias("others"))
    named = nodes.join(counts, "node", "left").join(roots, "node", "left").select(
        F.col("h").alias("_h"), F.col("v").alias("_v"),
        (F.coalesce("others", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("root", "node").alias("root"))
    done = rows.join(named, (F.col("h") == F.col("_h")) & (F.col("v") == F.col("_v")), "left")
    component = F.coalesce("root", "vec_id")
    return done.select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), component.alias("component_id"),
        F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))


def _meetings(nodes, count, threshold, recall, tables, most_tables, sample_rows, block_rows, seed) -> DataFrame:
    """Link counts (``a`` = ``b``, weight above 0) and spanning links (weight 0)."""
    index = learn(nodes, count, threshold, recall, tables, most_tables, sample_rows, seed)
    coded = written(nodes.select("node", _strings_of(index)(F.col("v")).alias("strings")), "codes")
    places = coded.select("node", F.posexplode("strings").alias("nth", "string"))
    buckets = places.groupBy("nth", "string").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    buckets = written(buckets.withColumn("parts", F.ceil(F.col("n") / block_rows)), "buckets")
    entered = buckets.agg(F.sum(F.col("n") * F.col("parts"))).first()[0] or 0
    entries = places.join(buckets, ["nth", "string"])
    # Block (low, high) of a bucket holds the rows of both parts.
    entries = entries.withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")))
    entries = entries.withColumn("other", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("parts") - 1)))
    pairs = entries.withColumns({"low": F.least("part", "other"), "high": F.greatest("part", "other")})
    # Buckets are small: many of them share one call. Vectors join last and move once.
    lot = F.pmod(F.xxhash64(*_GROUP), F.lit(1 + entered // (4 * block_rows)))
    pairs = pairs.select(lot.alias("lot"), *_GROUP, "node", "part").join(nodes.select("node", "copies", "v"), "node")
    pairs = pairs.select("lot", *_GROUP, "node", "copies", "v", "part")
    return pairs.groupBy("lot").applyInPandas(_meet(index, threshold), _MET)
