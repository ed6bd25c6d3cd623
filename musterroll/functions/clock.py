"""Time arithmetic on zone-less timestamps, free of the session time zone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_EPOCH = "TIMESTAMP_NTZ'1970-01-01 00:00:00'"


def _column(value) -> Column:
    return F.col(value) if isinstance(value, str) else value


def shifted(ts, seconds) -> Column:
    """``ts`` moved by a number of seconds (a number or a column)."""
    seconds = F.lit(seconds) if isinstance(seconds, (int, float)) else _column(seconds)
    zero = F.lit(0)
    return _column(ts) + F.make_dt_interval(zero, zero, zero, seconds.cast("decimal(18,6)"))


def epoch_seconds(ts) -> Column:
    """Seconds since 1970 of a zone-less timestamp, with its microseconds."""
    since = _column(ts) - F.expr(_EPOCH)
    return since.cast("interval second").cast("decimal(18,6)")


def from_epoch(seconds) -> Column:
    return shifted(F.expr(_EPOCH), seconds)


def seconds_between(start, end) -> Column:
    """Whole seconds from ``start`` to ``end``, rounded towards zero."""
    between = (_column(end) - _column(start)).cast("interval second").cast("decimal(18,6)")
    return between.cast("long")


def grid_after(ts, period: int) -> Column:
    """First multiple of ``period`` seconds since 1970 strictly after ``ts``."""
    return from_epoch((F.floor(epoch_seconds(ts) / period) + 1) * period)
