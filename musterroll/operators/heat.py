"""Ordered per-key operators that stay balanced when one key holds much of the data.

A window partitioned by key puts a whole key into one task. Keys with at most
``hot_rows`` rows take that plain route: one shuffle, all native. The rows of the
other keys are range-partitioned on (key, order), so a hot key is cut into many
consecutive pieces. Each operator then works inside a piece and adds what the
earlier pieces of the key carry over, which is one summary row per piece.
"""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from musterroll.session import pinned, written

HOT_ROWS = 5_000_000
BROADCAST_ROWS = 200_000
PIECE = "_piece"


def same_values(left: DataFrame, right: DataFrame, pairs: dict[str, str]) -> Column:
    """Null-safe equality of ``left`` columns with the ``right`` columns they map to."""
    return reduce(
        lambda a, b: a & b, [left[a].eqNullSafe(right[b]) for a, b in pairs.items()]
    )


def small_side(df: DataFrame, rows: int) -> DataFrame:
    """Hint a broadcast only when the known row count is within the bound."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def checked_broadcast(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcast ``df`` if it has at most ``max_rows`` rows, else leave the join to AQE."""
    return small_side(df, 0 if df.limit(max_rows + 1).count() <= max_rows else max_rows + 1)


@dataclass(frozen=True)
class HeatSplit:
    """Rows of the ordinary keys, and those of the hot ones (None if no key is hot)."""

    cold: DataFrame
    hot: DataFrame | None
    key: list[str]
    hot_keys: DataFrame | None = None
    n_keys: int = 0
    n_rows: int = 0

    def joined(self, per_key: DataFrame) -> HeatSplit:
        """Inner join with a narrow frame of at most one row per key.

        The ordinary keys take an equi join. The few rows that belong to hot keys are
        broadcast, so no hot key is ever shuffled to one task.
        """
        cold = self.cold.join(per_key, self.key)
        if self.hot is None:
            return replace(self, cold=cold)
        few = per_key.join(
            small_side(self.hot_keys, self.n_keys),
            same_values(per_key, self.hot_keys, {k: f"_hot_{k}" for k in self.key}), "left_semi",
        )
        return replace(self, cold=cold, hot=self.hot.join(small_side(few, self.n_keys), self.key))


def split_hot(df: DataFrame, key: list[str], hot_rows: int | None = HOT_ROWS) -> HeatSplit:
    """Separate the keys with more than ``hot_rows`` rows.

    The check counts rows per key: it reads the key columns only and combines before
    its shuffle. At most ``rows / hot_rows`` keys can be hot, which bounds the broadcast.
    """
    if hot_rows is None:
        return HeatSplit(df, None, key)
    counts = df.groupBy(*key).agg(F.count(F.lit(1)).alias("_rows"))
    found = counts.where(F.col("_rows") > hot_rows)
    if found.isEmpty():
        return HeatSplit(df, None, key)
    renamed = {k: f"_hot_{k}" for k in key}
    keys = pinned(found.select(*[F.col(k).alias(r) for k, r in renamed.items()], "_rows"))
    n_keys, n_rows = keys.agg(F.count(F.lit(1)), F.sum("_rows")).first()
    side = small_side(keys, n_keys)
    match = same_values(df, keys, renamed)
    return HeatSplit(
        df.join(side, match, "left_anti"), df.join(side, match, "left_semi"), key, keys,
        n_keys, n_rows,
    )


def unless_cold(df: DataFrame, key: list[str], hot_rows: int | None) -> int | None:
    """``hot_rows`` if some key of ``df`` holds more rows, else None.

    For steps on frames that are derived from ``df`` and have no more rows of any key: they
    need not be counted then, which would compute each of them twice.
    """
    if hot_rows is None:
        return None
    counts = df.groupBy(*key).agg(F.count(F.lit(1)).alias("_rows"))
    return None if counts.where(F.col("_rows") > hot_rows).isEmpty() else hot_rows


def _sorting(order: list[str], descending: bool) -> list[Column]:
    return [F.col(c).desc() if descending else F.col(c).asc() for c in order]


def cut_pieces(
    hot: DataFrame, key: list[str], order: list[str], n_pieces: int, descending: bool = False
) -> DataFrame:
    """Number consecutive ranges of (key, order); written, so every use sees the same cut."""
    ranged = hot.repartitionByRange(n_pieces, *key, *_sorting(order, descending))
    return written(ranged.withColumn(PIECE, F.spark_partition_id()), "pieces")


class _Cut:
    """One frame split into cold rows and, if any key is hot, pieces."""

    def __init__(self, df, key, order, descending, hot_rows, per_key=None):
        split = split_hot(df, key, hot_rows)
        if per_key is not None:
            split = split.joined(per_key)
        self.cold, self.columns = split.cold, split.cold.columns
        self.key, self.order, self.descending = key, order, descending
        self.pieces = None
        if split.hot is not None:
            n_pieces = max(2, -(-split.n_rows // hot_rows))
            self.pieces = cut_pieces(split.hot, key, order, n_pieces, descending)

    def window(self, *extra: str):
        return Window.partitionBy(*self.key, *extra).orderBy(
            *_sorting(self.order, self.descending)
        )

    def last_by_order(self, value: Column, where: Column | None = None) -> Column:
        position = F.struct(*self.order)
        if where is not None:
            position = F.when(where, position)
        return (F.min_by if self.descending else F.max_by)(value, position)

    def summary(self, *aggregates: Column) -> DataFrame:
        return self.pieces.groupBy(*self.key, PIECE).agg(*aggregates)

    def across(self):
        return Window.partitionBy(*self.key).orderBy(PIECE)

    def attach(self, carried: DataFrame) -> DataFrame:
        """Pieces with what the earlier pieces of their key carry.

        Joined on (key, piece), which is also how the window that follows is partitioned.
        """
        pairs = {k: f"_of_{k}" for k in [*self.key, PIECE]}
        carried = carried.withColumnsRenamed(pairs)
        joined = self.pieces.join(carried, same_values(self.pieces, carried, pairs))
        return joined.drop(*pairs.values())

    def both(self, cold: DataFrame, hot: DataFrame, added: list[str]) -> DataFrame:
        columns = self.columns + added
        return cold.select(*columns).unionByName(hot.select(*columns))


def numbered(
    df: DataFrame,
    key: list[str],
    order: list[str],
    out: str,
    descending: bool = False,
    hot_rows: int | None = HOT_ROWS,
    per_key: DataFrame | None = None,
) -> DataFrame:
    """``row_number`` per key; ``per_key`` is joined on the way (see ``HeatSplit``)."""
    cut = _Cut(df, key, order, descending, hot_rows, per_key)
    cold = cut.cold.withColumn(out, F.row_number().over(cut.window()).cast("long"))
    if cut.pieces is None:
        return cold
    earlier = cut.across().rowsBetween(Window.unboundedPreceding, -1)
    carried = cut.summary(F.count(F.lit(1)).alias("_rows")).select(
        *key, PIECE, F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_before")
    )
    hot = cut.attach(carried).withColumn(
        out, F.col("_before") + F.row_number().over(cut.window(PIECE))
    )
    return cut.both(cold, hot, [out])


def with_previous(
    df: DataFrame,
    key: list[str],
    order: list[str],
    columns: dict[str, str],
    descending: bool = False,
    hot_rows: int | None = HOT_ROWS,
    per_key: DataFrame | None = None,
) -> DataFrame:
    """Add, for each ``out: source``, the source value one row earlier in the order.

    ``descending=True`` looks at the next row instead (the order is reversed);
    ``per_key`` is joined on the way (see ``HeatSplit``).
    """
    cut = _Cut(df, key, order, descending, hot_rows, per_key)
    window = cut.window()
    cold = cut.cold.withColumns({o: F.lag(s).over(window) for o, s in columns.items()})
    if cut.pieces is None:
        return cold
    tail = F.struct(*[F.col(s).alias(o) for o, s in columns.items()])
    carried = cut.summary(cut.last_by_order(tail).alias("_tail")).select(
        *key, PIECE, F.lag("_tail").over(cut.across()).alias("_carry")
    )
    window = cut.window(PIECE)
    first = F.row_number().over(window) == 1
    hot = cut.attach(carried).withColumns(
        {
            o: F.when(first, F.col("_carry")[o]).otherwise(F.lag(s).over(window))
            for o, s in columns.items()
        }
    )
    return cut.both(cold, hot, list(columns))


def with_latest(
    df: DataFrame,
    key: list[str],
    order: list[str],
    columns: dict[str, str],
    descending: bool = False,
    hot_rows: int | None = HOT_ROWS,
) -> DataFrame:
    """Add, for each ``out: source``, the last non-null source value up to this row.

    ``descending=True`` gives the first non-null value from this row on.
    """
    cut = _Cut(df, key, order, descending, hot_rows)
    upto = cut.window().rowsBetween(Window.unboundedPreceding, Window.currentRow)
    cold = cut.cold.withColumns(
        {o: F.last(s, ignorenulls=True).over(upto) for o, s in columns.items()}
    )
    if cut.pieces is None:
        return cold
    earlier = cut.across().rowsBetween(Window.unboundedPreceding, -1)
    carried = cut.summary(
        *[cut.last_by_order(F.col(s), F.col(s).isNotNull()).alias(f"_tail_{o}")
          for o, s in columns.items()]
    ).select(
        *key, PIECE,
        *[F.last(f"_tail_{o}", ignorenulls=True).over(earlier).alias(f"_carry_{o}")
          for o in columns],
    )
    upto = cut.window(PIECE).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    hot = cut.attach(carried).withColumns(
        {
            o: F.coalesce(F.last(s, ignorenulls=True).over(upto), F.col(f"_carry_{o}"))
            for o, s in columns.items()
        }
    )
    return cut.both(cold, hot, list(columns))
