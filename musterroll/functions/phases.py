"""Phases of services, pods and components, their severity, and replica targets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Colour of a component status, and log level numbers.
SEVERITY = {
    "green": ("Running", "Created"),
    "yellow": ("Pending", "Health Checking"),
    "red": ("CrashLoopBackOff", "Error"),
}
LEVELS = {"DEBUG": 10, "INFO": 20, "WARNING": 30, "ERROR": 40, "CRITICAL": 50}
# Job status that each runner phase stands for.
JOB_STATUS = {
    "Created": "JobCreated",
    "Pending": "ClusterCreated",
    "Running": "Running",
    "Succeeded": "Successful",
    "Failed": "Failed",
}
ISO_FORMAT = "yyyy-MM-dd'T'HH:mm:ss'Z'"
SCALE_DOWN_SHARE = 0.25


def lookup(col: Column, table: dict) -> Column:
    """The table's value for the column, null if it has none."""
    chain = F
    for key, value in table.items():
        chain = chain.when(col == key, value)
    return chain


def phase_severity(col: Column) -> Column:
    """green, yellow or red; ``none`` for a phase without colour, ``-`` when missing."""
    chain = F.when(col.isNull(), "-")
    for colour, phases in SEVERITY.items():
        chain = chain.when(col.isin(*phases), colour)
    return chain.otherwise("none")


def service_phase(service_type: Column, ingress: Column) -> Column:
    """A load balancer without an ingress is Pending, any other service Running."""
    waiting = (service_type == "LoadBalancer") & (F.coalesce(F.size(ingress), F.lit(0)) < 1)
    return F.when(waiting, "Pending").otherwise("Running")


def is_running(phase: Column) -> Column:
    return F.coalesce(phase == "Running", F.lit(False))


def pod_phase(phase: Column, ready: Column, containers: Column) -> Column:
    """A running pod that is not ready is being checked; a waiting reason overrides.

    ``containers`` is an array of structs with ``waiting_reason``; the last waiting
    container wins, and a pod that is not Running keeps its phase.
    """
    reasons = F.filter(
        F.transform(containers, lambda c: c["waiting_reason"]), lambda r: r.isNotNull()
    )
    last = F.try_element_at(reasons, F.lit(-1))
    checked = F.when(F.coalesce(ready, F.lit(False)), phase).otherwise("Health Checking")
    return F.when(phase == "Running", F.coalesce(last, checked)).otherwise(phase)


def crash_looping(
    phase: Column, ready: Column, containers: Column, running_for: Column, timeout: int | None
) -> Column:
    """Running for longer than the timeout, not ready, and a container backs off."""
    if not timeout:
        return F.lit(False)
    backing_off = F.exists(
        containers, lambda c: F.coalesce(c["waiting_reason"] == "CrashLoopBackOff", F.lit(False))
    )
    return (
        is_running(phase)
        & ~F.coalesce(ready, F.lit(False))
        & F.coalesce(backing_off, F.lit(False))
        & F.coalesce(running_for > timeout, F.lit(False))
    )


def step_target(current: Column, desired: Column, minimum: Column, maximum: Column) -> Column:
    """One autoscale step: floor, ceiling, then the limit on scaling down.

    A null bound means unbounded. The order is deliberate: the scale-down limit comes
    last, so the result may exceed the maximum. A null desired value stays null.
    """
    bounded = F.least(maximum, F.greatest(minimum, desired))
    allowed = F.greatest(F.lit(1), F.floor(current * F.lit(SCALE_DOWN_SHARE)).cast("int"))
    limited = F.when(current > 0, F.greatest(current - allowed, bounded)).otherwise(bounded)
    return F.when(desired.isNotNull(), limited).cast("int")


def min_level(df: DataFrame, col: str, level, enabled: bool = True) -> DataFrame:
    """Events at or above a named or numeric severity; nothing when disabled."""
    least = LEVELS[level] if isinstance(level, str) else int(level)
    return df.where(F.lit(enabled) & (lookup(F.col(col), LEVELS) >= least))
