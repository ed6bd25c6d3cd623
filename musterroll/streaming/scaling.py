"""The autoscaler from end to end: what it saw at every tick, what it did, what is left to do."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from musterroll.operators.relate import reconcile
from musterroll.operators.rollup import latest_state
from musterroll.streaming.replay import replay_autoscaler
from musterroll.streaming.ticks import state_on_grid

#: What a source reports while it cannot be reached.
UNREACHABLE = -1


def targets_at_ticks(
    changes: DataFrame, key: list[str], ts: str, tie: str, ready: str, sources: list[str], period: int
) -> DataFrame:
    """``key, ts, target`` for every tick at which a scheduler could be asked.

    ``changes`` has a row per change of readiness or of what a source answers, null where a
    column did not change. A tick counts while ``ready`` is true. The sources are asked in
    order: one that has said nothing yet, or is ``UNREACHABLE``, leaves it to the next; if
    none answers, the tick has no target and is left out.
    """
    seen = state_on_grid(changes, key, ts, tie, [ready, *sources], period)
    target = F.coalesce(*[F.nullif(F.col(s), F.lit(UNREACHABLE)) for s in sources])
    return seen.where(ready).select(*key, ts, target.alias("target")).where("target IS NOT NULL")


def autoscaler_moves(
    changes: DataFrame, bounds: DataFrame, key: list[str], ts: str, tie: str, ready: str, sources: list[str],
    period: int, cooldown: int, minimum: str = "minimum", maximum: str = "maximum", initial: str = "minimum",
) -> DataFrame:
    """Replica changes of every cluster that has bounds: ``key, ts, old, new``."""
    asked = targets_at_ticks(changes, key, ts, tie, ready, sources, period).withColumn("_n", F.lit(0).cast("long"))
    moves = replay_autoscaler(asked, bounds, key, ts, "_n", "target", minimum, maximum, initial, cooldown)
    return moves.drop("_n")


def scaling_plan(
    changes: DataFrame, bounds: DataFrame, members: DataFrame, key: list[str], ts: str, tie: str, ready: str,
    sources: list[str], period: int, cooldown: int, minimum: str = "minimum", maximum: str = "maximum",
    initial: str = "minimum",
) -> DataFrame:
    """What each cluster with bounds wants after all ticks, has, and needs.

    ``key, desired, moves, current, needed, action``. A cluster that never moved wants its
    initial replicas (else its minimum, else 0).
    """
    moves = autoscaler_moves(changes, bounds, key, ts, tie, ready, sources, period, cooldown, minimum, maximum, initial)
    counted = moves.groupBy(*key).agg(F.count(F.lit(1)).alias("moves"), F.max_by("new", ts).alias("_new"))
    start = F.coalesce(initial, minimum, F.lit(0)).cast("int")
    wanted = latest_state(bounds.select(*key, start.alias("_start")), key, ["_start"]).join(counted, key, "left")
    wanted = wanted.select(*key, F.coalesce("_new", "_start").alias("desired"), F.coalesce("moves", F.lit(0).cast("long")).alias("moves"))
    return reconcile(wanted, members, key)
