"""Exact top-k search by inner product with dual cover trees.

Pivots from a bounded sample divide queries and data; a pivot with many rows is divided
further by a hash, so that a cell of queries and data has a bounded size. Cells of equal
pivots are searched first. They give every query a score that its worst kth cannot fall
below, and with the covering radii of the pivots these prune most other pairs of pivots.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from musterroll.llm.covertree import DualSearch
from musterroll.session import written

_CELL = ["size", "data_pivot", "data_part", "query_pivot", "query_part"]
_FOUND = "query_id bigint, vec_id bigint, score bigint"


def usable(vector: Column) -> Column:
    """Neither null nor empty, and all components finite."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(vector.isNotNull() & (F.size(vector) > 0) & finite, F.lit(False))


def _pivot_of(pivots: list[list[int]]):
    """Number of the nearest pivot of the same length, and the distance to it."""

    def nearest(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        by_size = {n: [i for i, p in enumerate(pivots) if len(p) == n] for n in {len(p) for p in pivots}}
        arrays = {n: np.array([pivots[i] for i in rows], dtype=float) for n, rows in by_size.items()}
        for batch in batches:
            found = np.zeros((len(batch), 2))
            sizes = batch.map(len).to_numpy()
            for n in np.unique(sizes):
                mine = np.flatnonzero(sizes == n)
                if n not in arrays:
                    found[mine] = -1, 0
                    continue
                points = np.vstack(batch.iloc[mine].to_numpy()).astype(float)
                squares = (points**2).sum(1)[:, None] - 2 * points @ arrays[n].T + (arrays[n] ** 2).sum(1)
                best = squares.argmin(axis=1)
                found[mine, 0] = np.array(by_size[n])[best]
                found[mine, 1] = np.linalg.norm(points - arrays[n][best], axis=1)
            yield pd.DataFrame({"pivot": found[:, 0].astype(int), "away": found[:, 1]})

    return F.pandas_udf(nearest, "struct<pivot: int, away: double>")


def _search(k: int):
    def search(queries: pd.DataFrame, data: pd.DataFrame) -> pd.DataFrame:
        if not len(queries) or not len(data):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype("int64")
        found = DualSearch(
            np.vstack(queries["v"].to_numpy()).astype(float), queries["vec_id"].to_numpy(np.int64),
            np.vstack(data["v"].to_numpy()).astype(float), data["vec_id"].to_numpy(np.int64),
            k, queries["worst"].to_numpy(float),
        )
        found.run()
        at, nth = np.nonzero(np.isfinite(found.scores) & (found.scores >= queries["worst"].to_numpy(float)[:, None]))
        return pd.DataFrame({
            "query_id": found.query_ids[at], "vec_id": found.ids[at, nth], "score": found.scores[at, nth].astype(np.int64),
        })

    return search


def _numbers_below(count: Column) -> Column:
    return F.explode(F.sequence(F.lit(0).cast("bigint"), count.cast("bigint") - 1))


def _best(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def top_k(
    vectors: DataFrame, is_query: Column, k: int = 20, vec_id: str = "vec_id", vector: str = "embedding",
    scale: float = 64.0, cell_rows: int = 8192, query_rows: int = 2048, most_pivots: int = 512,
) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` best other rows of each query.

    A component x becomes ``floor(scale * x)``; the score is the inner product of these
    integers, ties go to the smaller id. Fewer than ``k`` rows are returned if there are
    fewer. Vectors that are null, empty, or hold a null or a non-finite component take no
    part, nor do rows with a null id; vectors of different lengths do not compare; an id
    that occurs more than once is never its own result, and its rows count as they are.
    Other columns play no part.

    Of equal vectors only the ``k + 1`` smallest ids can be results, so the others are
    only queries: a group of copies is cut, part by part, before it meets. The driver sees
    ``most_pivots`` sampled vectors and one row of statistics for each.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(vec_id).cast("bigint").alias("vec_id"), F.col(vector).alias("v"), is_query.alias("q"))
    rows = rows.where(F.col("vec_id").isNotNull() & usable(F.col("v")))
    rows = rows.select(
        "vec_id", F.transform("v", lambda x: F.floor(F.lit(scale) * x.cast("double"))).alias("v"),
        F.coalesce("q", F.lit(False)).alias("q"),
    ).select("*", F.size("v").alias("size"), F.xxhash64("v").alias("h"))
    rows = written(rows, "vectors")
    for parts in (64, 1):  # copies are cut in 64 parts first
        part = F.pmod(F.xxhash64("vec_id"), F.lit(parts))
        order = Window.partitionBy("h", "v", part).orderBy("vec_id")
        data = (rows if parts > 1 else data).withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= k + 1)
    total = rows.count()
    n_pivots = max(1, min(most_pivots, total // cell_rows))
    sample = rows.select("size", "v", "h").distinct().orderBy(F.xxhash64("h"), "v").limit(n_pivots).collect()
    sizes = [r["size"] for r in rows.select("size").distinct().orderBy("size").limit(most_pivots).collect()]
    pivots = [list(r["v"]) for r in sample]
    pivots += [list(rows.where(F.col("size") == n).first()["v"]) for n in sizes if n not in {len(p) for p in pivots}]
    if not pivots:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score bigint")
    near = _pivot_of(pivots)

    def placed(frame: DataFrame, label: str) -> DataFrame:
        frame = frame.withColumn("near", near(F.col("v"))).select("vec_id", "v", "size", "h", "near.*")
        return written(frame, label)

    data, queries = placed(data, "data"), placed(rows.where("q"), "queries")

    def summary(frame: DataFrame) -> dict[int, tuple]:
        counted = frame.groupBy("pivot").agg(F.count(F.lit(1)).alias("n"), F.max("away").alias("away"))
        return {r["pivot"]: (r["n"], r["away"]) for r in counted.collect()}

    of_data, of_queries = summary(data), summary(queries)

    def searched(pairs: list[tuple[int, int]], worst: DataFrame | None) -> DataFrame:
        """Search the given pairs of pivots (of queries, of data)."""
        listed = [(q, d, -(-of_queries[q][0] // query_rows), -(-of_data[d][0] // cell_rows)) for q, d in pairs]
        columns = "query_pivot int, data_pivot int, query_parts int, data_parts int"
        cells, same_cells = (F.broadcast(spark.createDataFrame(listed, columns)) for _ in range(2))
        left = queries if worst is None else queries.join(worst, queries.vec_id == worst.query_id, "left").drop("query_id")
        left = left.withColumn("worst", F.lit(float("-inf")) if worst is None else F.coalesce("worst", F.lit(float("-inf"))))
        left = left.join(cells, F.col("pivot") == F.col("query_pivot"))
        left = left.withColumn("query_part", F.pmod(F.xxhash64("vec_id"), F.col("query_parts")))
        left = left.withColumn("data_part", _numbers_below(F.col("data_parts")))
        right = data.join(same_cells, F.col("pivot") == F.col("data_pivot"))
        right = right.withColumn("data_part", F.pmod(F.xxhash64("vec_id"), F.col("data_parts")))
        right = right.withColumn("query_part", _numbers_below(F.col("query_parts")))
        left = left.select(*_CELL, "vec_id", "v", "worst").groupBy(*_CELL)
        return left.cogroup(right.select(*_CELL, "vec_id", "v").groupBy(*_CELL)).applyInPandas(_search(k), _FOUND)

    home = written(_best(searched([(p, p) for p in of_queries if p in of_data], None), k).drop("rank"), "home")
    worst = home.groupBy("query_id").agg(F.when(F.count(F.lit(1)) >= k, F.min("score")).cast("double").alias("worst"))
    worst = written(worst, "worst")
    least = queries.join(worst, queries.vec_id == worst.query_id, "left").groupBy("pivot").agg(
        F.min(F.coalesce("worst", F.lit(float("-inf")))).alias("least"))
    least = {r["pivot"]: r["least"] for r in least.collect()}
    pairs = []
    for q, (_, q_radius) in of_queries.items():
        center, norm = np.array(pivots[q], dtype=float), np.linalg.norm(pivots[q])
        for d, (_, d_radius) in of_data.items():
            if d != q and len(pivots[d]) == len(pivots[q]):
                other, far = np.array(pivots[d], dtype=float), np.linalg.norm(pivots[d])
                bound = center @ other + norm * d_radius + far * q_radius + q_radius * d_radius
                if bound * (1 + 1e-9) + 1e-6 >= least[q]:
                    pairs.append((q, d))
    found = home
    if pairs:
        found = home.union(searched(pairs, worst).select(home.columns))
    return _best(found, k).select("query_id", "rank", "vec_id", "score")
