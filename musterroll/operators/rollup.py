"""Aggregates over members, statuses, patches and job events.

All are plain grouped aggregates, combined on the map side before the shuffle, so a hot
key arrives as one partial row per task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from musterroll.functions.names import runner_name
from musterroll.functions.phases import ISO_FORMAT, JOB_STATUS, lookup
from musterroll.operators.heat import HOT_ROWS, with_previous

# The phases that end a job.
FINAL_PHASES = ("Succeeded", "Failed")


def count_members(children: DataFrame, key: list[str], out: str = "members") -> DataFrame:
    """Live members per group."""
    return children.groupBy(*key).agg(F.count(F.lit(1)).alias(out))


def component_board(
    statuses: DataFrame, key: list[str], component: str, status: str, order: list[str],
    components: dict[str, str],
) -> DataFrame:
    """One row per cluster with the latest status of each component, ``-`` if none.

    ``components`` maps output columns to component values.
    """

    def latest(value: str) -> Column:
        position = F.when(F.col(component) == value, F.struct(*order))
        return F.coalesce(F.max_by(status, position), F.lit("-"))

    return statuses.groupBy(*key).agg(*[latest(v).alias(c) for c, v in components.items()])


def latest_state(events: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The last event of each key, whole."""
    row = F.struct(*[c for c in events.columns if c not in key])
    last = events.groupBy(*key).agg(F.max_by(row, F.struct(*order)).alias("_last"))
    return last.select(*key, "_last.*")


def replay_patches(
    patches: DataFrame, key: list[str], order: list[str], fields: list[str]
) -> DataFrame:
    """Partial patches merged in order: the last non-null value of every field."""

    def last(field: str) -> Column:
        return F.max_by(field, F.when(F.col(field).isNotNull(), F.struct(*order)))

    return patches.groupBy(*key).agg(*[last(f).alias(f) for f in fields])


def job_fields(runs: DataFrame, key: str) -> DataFrame:
    """The five status fields of a job and its duration, from status, start and end."""
    name = F.col(key).cast("string")
    took = (F.col("ended") - F.col("started")).cast("interval second").cast("decimal(18,6)")
    return runs.select(
        key,
        name.alias("clusterName"),
        runner_name(name).alias("jobRunnerPodName"),
        "jobStatus",
        F.date_format("started", ISO_FORMAT).alias("startTime"),
        F.date_format("ended", ISO_FORMAT).alias("endTime"),
        F.when(F.col("ended") >= F.col("started"), took.cast("long")).alias("duration_s"),
    )


def job_runs(
    events: DataFrame, key: str, ts: str, phase: str, order: list[str],
    hot_rows: int | None = HOT_ROWS,
) -> DataFrame:
    """One row per job with its final status fields.

    A job starts when its phase changes to running and ends when it changes to a final
    phase; seeing the same phase again moves neither. Each change overwrites, so a job that
    ran again reports its last start and end; the duration is null while the last end lies
    before the last start.
    """
    before = with_previous(
        events.select(*dict.fromkeys([key, ts, phase, *order])), [key], order, {"_before": phase},
        hot_rows=hot_rows,
    )
    changed = ~F.col(phase).eqNullSafe(F.col("_before"))
    runs = before.groupBy(key).agg(
        F.max_by(lookup(F.col(phase), JOB_STATUS), F.struct(*order)).alias("jobStatus"),
        F.max(F.when(changed & (F.col(phase) == "Running"), F.col(ts))).alias("started"),
        F.max(F.when(changed & F.col(phase).isin(*FINAL_PHASES), F.col(ts))).alias("ended"),
    )
    return job_fields(runs, key)


def duplicate_env(manifests: DataFrame, doc: list[str], env: str) -> DataFrame:
    """Environment names that occur more than once in a document, with their count."""
    names = manifests.select(*doc, F.explode(env).alias("_env"))
    counted = names.groupBy(*doc, F.col("_env.name").alias("name")).agg(
        F.count(F.lit(1)).alias("times")
    )
    return counted.where(F.col("times") > 1)


def preferred_source(
    observations: DataFrame, key: list[str], source: str, value: str, priority: Column,
    order: list[str],
) -> DataFrame:
    """The value of the best source that has one, and which source that was.

    A lower priority number is better; within a source the latest value counts. Keys
    for which no source has a value are skipped.
    """
    usable = observations.where(F.col(value).isNotNull()).withColumn("_priority", -priority)
    best = usable.groupBy(*key).agg(
        F.max_by(F.struct(value, source), F.struct("_priority", *order)).alias("_best")
    )
    return best.select(*key, f"_best.{value}", f"_best.{source}")
