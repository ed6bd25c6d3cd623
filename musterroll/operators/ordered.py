"""Per-key order: newest members, field changes and time spent in a phase."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from musterroll.functions.clock import seconds_between
from musterroll.operators.heat import (
    HOT_ROWS,
    checked_broadcast,
    numbered,
    unless_cold,
    with_previous,
)


def lifo_victims(
    members: DataFrame,
    n_per_group: DataFrame,
    key: list[str],
    order: list[str],
    n: str = "n",
    hot_rows: int | None = HOT_ROWS,
) -> DataFrame:
    """The newest ``n`` members of each group, ``n`` differing per group.

    The reference order is whatever the API lists; here it is the given order, creation
    time first. ``n <= 0`` retires none, ``n`` beyond the group retires all of it.
    Groups that retire nothing leave before members are ranked. The rows come with
    ``rank``, 1 for the newest; sort by it descending to get them oldest first.
    """
    wanted = n_per_group.where(F.col(n) > 0).select(*key, F.col(n).alias("_n"))
    ranked = numbered(
        members, key, order, "rank", descending=True, hot_rows=hot_rows, per_key=wanted
    )
    return ranked.where(F.col("rank") <= F.col("_n")).drop("_n")


def field_changes(
    events: DataFrame,
    key: list[str],
    order: list[str],
    field: str,
    new=None,
    skip_first: bool = False,
    hot_rows: int | None = HOT_ROWS,
) -> DataFrame:
    """Rows whose field differs from the row before, with ``old``.

    The first row of a key counts as a change from null unless ``skip_first``; ``new``
    keeps only changes to that value.
    """
    marked = events.withColumn("_seen", F.lit(True))
    before = with_previous(
        marked, key, order, {"old": field, "_before": "_seen"}, hot_rows=hot_rows
    )
    changed = ~F.col("old").eqNullSafe(F.col(field))
    if new is not None:
        changed = changed & F.col(field).eqNullSafe(F.lit(new))
    if skip_first:
        changed = changed & F.col("_before").isNotNull()
    return before.where(changed).drop("_seen", "_before")


def stuck_in_phase(
    events: DataFrame,
    key: list[str],
    order: list[str],
    ts: str,
    phase: str,
    limits: DataFrame,
    as_of: Column,
    hot_rows: int | None = HOT_ROWS,
) -> DataFrame:
    """Stays in a phase longer than its limit; the open stay ends at ``as_of``.

    ``limits`` has ``phase`` and ``limit_s``; phases without a positive limit never
    count as stuck. Consecutive events of one phase are one stay.
    """
    hot_rows = unless_cold(events, key, hot_rows)
    starts = field_changes(events, key, order, phase, hot_rows=hot_rows).select(
        *key, *dict.fromkeys([*order, ts, phase])
    )
    ahead = with_previous(
        starts, key, order, {"_until": ts}, descending=True, hot_rows=hot_rows
    )
    stays = ahead.withColumn("until", F.coalesce("_until", as_of)).withColumn(
        "stay_s", seconds_between(ts, "until")
    )
    bounded = stays.join(checked_broadcast(limits), phase)
    stuck = (F.col("limit_s") > 0) & (F.col("stay_s") > F.col("limit_s"))
    return bounded.where(stuck).select(*key, phase, F.col(ts).alias("since"), "until", "stay_s")
