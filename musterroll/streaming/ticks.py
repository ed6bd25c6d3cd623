"""Regular sampling of event histories, and idle shutdowns found on that grid."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from musterroll.functions.clock import epoch_seconds, from_epoch, grid_after, shifted
from musterroll.functions.counting import numbered_rows
from musterroll.operators.heat import HOT_ROWS, unless_cold, with_latest, with_previous

# Fixed value: seconds between two idle checks.
IDLE_CHECK_PERIOD = 5


def tick_samples(events: DataFrame, key: list[str], ts: str, period: int) -> DataFrame:
    """Ticks at multiples of ``period`` since 1970, from a key's first to its last event."""
    span = events.groupBy(*key).agg(F.min(ts).alias("_first"), F.max(ts).alias("_last"))
    first = F.ceil(epoch_seconds("_first") / period)
    last = F.floor(epoch_seconds("_last") / period)
    grid = span.select(*key, first.alias("_from"), last.alias("_to"))
    ticks = numbered_rows(grid, key, F.col("_to") - F.col("_from") + 1, "_i")
    return ticks.select(*key, from_epoch((F.col("_from") + F.col("_i")) * period).alias(ts))


def state_on_grid(
    changes: DataFrame, key: list[str], ts: str, tie: str, columns: list[str], period: int,
    hot_rows: int | None = HOT_ROWS,
) -> DataFrame:
    """``state_at`` for the regular grid of ``tick_samples``, without shuffling the ticks.

    Each change lasts until the next one and emits the ticks in between. Only changes are
    shuffled, however fine the grid.
    """
    hot_rows = unless_cold(changes, key, hot_rows)
    known = with_latest(
        changes.select(*key, ts, tie, *columns), key, [ts, tie],
        {f"_at_{c}": c for c in columns}, hot_rows=hot_rows,
    )
    ahead = with_previous(
        known, key, [ts, tie], {"_next": ts}, descending=True, hot_rows=hot_rows
    )
    first = F.ceil(epoch_seconds(ts) / period)
    last = F.coalesce(
        F.ceil(epoch_seconds("_next") / period) - 1, F.floor(epoch_seconds(ts) / period)
    )
    lasting = ahead.withColumns({"_from": first, "_to": last})
    ticks = numbered_rows(
        lasting, [*key, ts, tie], F.col("_to") - F.col("_from") + 1, "_i"
    )
    return ticks.select(
        *key, from_epoch((F.col("_from") + F.col("_i")) * period).alias(ts),
        *[F.col(f"_at_{c}").alias(c) for c in columns],
    )


def idle_gaps(
    activity: DataFrame, timeouts: DataFrame, key: list[str], ts: str, seq: str, timeout: str,
    as_of: Column, period: int = IDLE_CHECK_PERIOD, hot_rows: int | None = HOT_ROWS,
) -> DataFrame:
    """Every activity after which the cluster stays idle past its timeout."""
    watched = timeouts.where(F.col(timeout) > 0).select(*key, F.col(timeout).alias("_timeout"))
    ahead = with_previous(
        activity.where(F.col(ts) <= as_of).select(*key, ts, seq), key, [ts, seq], {"_next": ts},
        descending=True, hot_rows=hot_rows, per_key=watched,
    ).withColumn("shutdown_at", grid_after(shifted(ts, "_timeout"), period))
    due = F.when(F.col("_next").isNotNull(), F.col("shutdown_at") < F.col("_next")).otherwise(
        F.col("shutdown_at") <= as_of
    )
    return ahead.where(due).select(*key, F.col(ts).alias("idle_since"), "shutdown_at")


def idle_shutdowns(
    activity: DataFrame, timeouts: DataFrame, key: list[str], ts: str, seq: str, timeout: str,
    as_of: Column, period: int = IDLE_CHECK_PERIOD, hot_rows: int | None = HOT_ROWS,
) -> DataFrame:
    """When each cluster is first shut down for being idle.

    A cluster goes idle at an activity, and the first check strictly after the timeout
    shuts it down unless a new activity came at or before that check. Timeout 0 or null
    means never.
    """
    gaps = idle_gaps(activity, timeouts, key, ts, seq, timeout, as_of, period, hot_rows)
    first = F.min(F.struct("idle_since", "shutdown_at")).alias("_first")
    return gaps.groupBy(*key).agg(first).select(*key, "_first.*")
