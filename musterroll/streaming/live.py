"""The same rules on a live change feed.

``run_available`` drives any of these streams over the files present and stops; with a
closing row it also settles what the last watermark leaves open, which is how a backfill
runs. Sinks are tables in the shared folder; every one survives a
restart from its checkpoint, and a repeated batch overwrites what it wrote before.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import reduce
from operator import and_, itemgetter

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from musterroll.functions.phases import JOB_STATUS
from musterroll.operators.rollup import FINAL_PHASES, job_fields, latest_state
from musterroll.session import scratch_path
from musterroll.sources.snapshot import timed
from musterroll.streaming.buckets import BucketTable
from musterroll.streaming.replay import MICROS, next_replicas
from musterroll.streaming.ticks import IDLE_CHECK_PERIOD

STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
BUCKET_TIMEOUTS = 64
#: Groups that keys share, and with them calls and entries of state. Of every key in a group that
#: gets a row, what is kept is written anew.
GROUPS = 4096
#: Held rows of one entry.
ENTRY_ROWS = 512
#: Rows that a task collects before it adds them to the held ones, and that it gives out at once.
ADDED_ROWS = 100_000
FRAME_ROWS = 10_000
NO_SEQ = -(2**63)
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def rocksdb_state(spark: SparkSession) -> Iterator[None]:
    """Keyed state in RocksDB, which spills to disk, while a query starts and runs."""
    before = spark.conf.get(STATE_STORE, None)
    spark.conf.set(STATE_STORE, ROCKSDB)
    try:
        yield
    finally:
        spark.conf.set(STATE_STORE, before) if before else spark.conf.unset(STATE_STORE)


def run_available(
    stream: DataFrame, label: str, mode: str = "append", path: str | None = None,
    close: Callable[[], None] | None = None,
) -> DataFrame:
    """Run a stream over the files present and return the table it wrote.

    With the ``path`` of an earlier run it goes on from that run's checkpoint. ``close``
    is called when all files have been read and adds the closing row of the feed
    (``close_feed``); the stream then goes on until that row has settled the rest.
    """
    spark = stream.sparkSession
    path = path or scratch_path(spark, label)
    with rocksdb_state(spark):
        for before in [None] if close is None else [None, close]:
            if before is not None:
                before()
            query = (
                stream.writeStream.format("parquet").outputMode(mode)
                .option("checkpointLocation", f"{path}/checkpoint")
                .trigger(availableNow=True).start(f"{path}/table")
            )
            query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/table")


def _per_batch(stream: DataFrame, path: str, mode: str,
               write: Callable[[DataFrame, int], None]) -> StreamingQuery:
    return (
        stream.writeStream.outputMode(mode).foreachBatch(write)
        .option("checkpointLocation", f"{path}/checkpoint")
        .trigger(availableNow=True).start()
    )


def coalesce_updates(
    updates: DataFrame, current: DataFrame, key: list[str], order: list[str], path: str, buckets: int = 32,
) -> DataFrame:
    """Apply updates to a table of current rows, one write per touched bucket and micro-batch.

    Several updates of a key in a batch collapse before they meet the table. A null is "not
    mentioned": the last value of each field counts, in ``order``, whether it came with an
    update or stood in the table, and whichever batch brought it. Keys lie in ``buckets``
    and a batch rewrites only those it touches; see ``BucketTable`` for how a version comes
    to count. Repeating a batch is harmless.
    """
    table = BucketTable(updates.sparkSession, path, key, order, current.schema, buckets)
    table.start(current)
    columns = current.columns
    _per_batch(
        updates, path, "append", lambda batch, version: table.apply(batch.select(*columns), version)
    ).awaitTermination()
    return table.rows()


# --- keyed state in event-time order -------------------------------------------------


def micros(ts) -> Column:
    return F.unix_micros(ts)


def _frame(schema: str, rows: list[tuple]) -> Iterator[pd.DataFrame]:
    if rows:
        names = [c.split()[0] for c in schema.split(", ")]
        yield pd.DataFrame(dict(zip(names, zip(*rows, strict=True), strict=True)))


def _longs(column: pd.Series) -> list[int | None]:
    """A column of numbers, which is one of floats if it has nulls."""
    values = column.tolist()
    if column.dtype.kind == "i":
        return values
    return [None if v is None or v != v else int(v) for v in values]


def _place(row: tuple) -> tuple[int, int]:
    """Where a row stands among the held ones, those without ``seq`` first."""
    return row[0], NO_SEQ if row[1] is None else row[1]


class InOrder(StatefulProcessor):
    """Holds rows until the watermark has passed them, then steps through them in order.

    A call has the rows of one key, or those of a group of keys, which then carry the
    columns of their key (``carried``, the types of these). A group holds the rows of its
    lateness window, and what ``step`` keeps of each key. Held rows lie in entries of up to
    ``ENTRY_ROWS``, sorted, each under the place of its first row: rows that arrive rewrite
    the entries they fall into only, whatever the time these span, and due entries are read
    and stepped through one after the other. What is kept of a key goes once it says no
    more than nothing does (``expires``).
    """

    ROWS = ("t", "seq", "value", "start")
    KEPT = ("a", "b")
    #: Of what a key gives at once, only the last row counts.
    LAST_ONLY = False
    out = ""
    carried: tuple[str, ...] = ()

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        own = [f"k{i} ARRAY<{kind}>" for i, kind in enumerate(self.carried)]
        longs = lambda names: [f"{n} ARRAY<LONG>" for n in names]
        self.held = handle.getMapState("held", "t LONG, seq LONG", ", ".join([*longs(self.ROWS), *own]))
        self.kept = handle.getValueState("kept", ", ".join([*longs(self.KEPT), *own]))
        self.settled = {}

    def _held(self, place: tuple) -> list[tuple]:
        return list(zip(*self.held.getValue(place), strict=True))

    def _hold(self, rows: list[tuple]) -> None:
        """Sorted rows in entries of about one size; rows in one place share an entry."""
        size = -(-len(rows) // -(-len(rows) // ENTRY_ROWS))
        at = 0
        while at < len(rows):
            end = min(at + size, len(rows))
            while end < len(rows) and _place(rows[end]) == _place(rows[end - 1]):
                end += 1
            self.held.updateValue(_place(rows[at]), tuple(list(c) for c in zip(*rows[at:end], strict=True)))
            at = end

    def _add(self, arrived: list[tuple]) -> int:
        """Put rows into the last entry that begins at or before them, or the first; their least time."""
        arrived.sort(key=_place)
        places = sorted(tuple(p) for p in self.held.keys())
        ends = [bisect_left(arrived, p, key=_place) for p in places[1:]] + [len(arrived)]
        at = 0
        for place, end in zip(places or [None], ends, strict=True):
            rows, at = arrived[at:end], end
            if rows and place is not None:
                rows = sorted(self._held(place) + rows, key=_place)
                if _place(rows[0]) != place:
                    self.held.removeKey(place)
            if rows:
                self._hold(rows)
        return arrived[0][0]

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        self.settled.pop(key, None)
        waiting, first = [], []
        for part in rows:
            columns = [_longs(part[c]) for c in ("at_micros", "at_seq", "value", "start")]
            columns += [part[f"own{i}"].tolist() for i in range(len(self.carried))]
            waiting += [r for r in zip(*columns, strict=True) if r[0] is not None]
            if len(waiting) >= ADDED_ROWS:
                first.append(self._add(waiting))
                waiting = []
        if waiting:
            first.append(self._add(waiting))
        if first:
            self.handle.registerTimer(min(first) // 1000 + 1)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs() * 1000
        # All that is due at one time is settled by the first timer of a key.
        if self.settled.get(key) == now:
            return
        self.settled[key] = now
        width, fields = len(self.ROWS), len(self.KEPT)
        packed = self.kept.get() if self.kept.exists() else None
        before = {r[fields:]: r[:fields] for r in zip(*packed, strict=True)} if packed else {}
        states, found, last, later = dict(before), [], {}, []
        for place in sorted(tuple(p) for p in self.held.keys()):
            if place[0] >= now:
                later.append(place[0])
                break
            rows = self._held(place)
            end = bisect_left(rows, now, key=itemgetter(0))
            self.held.removeKey(place)
            if rows[end:]:
                self._hold(rows[end:])
                later.append(rows[end][0])
            due = {}
            for r in rows[:end]:
                due.setdefault(r[width:], []).append(r[:width])
            for own, mine in due.items():
                # Time has come no further than this entry's last row while later entries are due.
                states[own], some = self.step(states.get(own), mine, rows[end - 1][0])
                if self.LAST_ONLY:
                    last[own] = some[-1:] or last.get(own, [])
                else:
                    found += [(*(own or key), *r) for r in some]
            if len(found) >= FRAME_ROWS:
                yield from _frame(self.out, found)
                found = []
        # A step without rows lets a state act on the time alone.
        for own, state in list(states.items()):
            states[own], some = self.step(state, [], now)
            found += [(*(own or key), *r) for r in [*last.get(own, []), *some]]
        yield from _frame(self.out, found)
        states = {own: s for own, s in states.items() if s is not None and not self._gone(s, now)}
        if states and states != before:
            self.kept.update(tuple(list(c) for c in zip(*((*s, *own) for own, s in states.items()), strict=True)))
        elif before and not states:
            self.kept.clear()
        later += [t for s in states.values() for t in (self.acts(s), self.expires(s)) if t is not None]
        if later:
            self.handle.registerTimer(max(min(later), now) // 1000 + 1)

    def _gone(self, state, now: int) -> bool:
        gone = self.expires(state)
        return gone is not None and gone < now

    def step(self, state, due, now):
        raise NotImplementedError

    def acts(self, state) -> int | None:
        """The time at which the state acts though no row comes, None if it does not."""
        return None

    def expires(self, state) -> int | None:
        """The time from which the state can go, None if it has to stay."""
        return None


class Cooldown(InOrder):
    """Autoscaling steps, or with ``scaling=False`` a plain throttle."""

    def __init__(self, cooldown: int, scaling: bool, out: str = ""):
        self.cooldown, self.scaling, self.out = cooldown * MICROS, scaling, out

    def step(self, state, due, now):
        found = []
        for t, seq, value, start in due:
            count, wake = state or (start, None)
            if wake is not None and t < wake:
                continue
            new = next_replicas(count, value) if self.scaling else count
            if self.scaling and new == count:
                state = (count, wake)
                continue
            found.append((t, seq, count, new))
            state = (new, t + self.cooldown)
        return state, found

    def expires(self, state):
        # After its pause a throttle lets the next row pass, as if it had seen none.
        return None if self.scaling or state[1] is None else state[1]


class Idle(InOrder):
    """First check after an idle gap longer than the key's timeout, carried in ``value``.

    A key that was shut down is marked, until ``forget`` seconds have passed.
    """

    def __init__(self, period: int, forget: int | None, out: str = ""):
        self.period, self.forget, self.out = period * MICROS, forget, out

    def step(self, state, due, now):
        found = []
        for t, _, timeout, _ in due:
            last, shutdown = state or (None, None)
            if last == -1:
                break
            if last is not None and shutdown < t:
                found.append((last, shutdown))
                state = (-1, shutdown)
                break
            state = (t, ((t + timeout * MICROS) // self.period + 1) * self.period)
        if state is not None and state[0] != -1 and state[1] < now:
            found.append(state)
            state = (-1, state[1])
        return state, found

    def acts(self, state):
        return None if state[0] == -1 else state[1]

    def expires(self, state):
        return None if self.forget is None or state[0] != -1 else state[1] + self.forget * MICROS


class JobRun(InOrder):
    """Follows the phase of a job; ``value`` numbers the phases of ``JOB_STATUS``.

    An ended job goes ``forget`` seconds after its end.
    """

    KEPT = ("code", "started", "ended")
    LAST_ONLY = True

    def __init__(self, forget: int | None, out: str = ""):
        names = list(JOB_STATUS)
        self.forget, self.out, self.running = forget, out, names.index("Running") + 1
        self.final = [names.index(p) + 1 for p in FINAL_PHASES]

    def step(self, state, due, now):
        for t, _, code, _ in due:
            before, started, ended = state or (None, None, None)
            if code != before:
                started = t if code == self.running else started
                ended = t if code in self.final else ended
            state = (code, started, ended)
        return state, [(*due[-1][:2], *state)] if due else []

    def expires(self, state):
        code, _, ended = state
        return None if self.forget is None or code not in self.final or ended is None else ended + self.forget * MICROS


def _keys(key: str | list[str]) -> list[str]:
    return [key] if isinstance(key, str) else list(key)


def _carried(key: str, kind: T.DataType) -> Column:
    """A key column as a number or text, which keep their value in Python."""
    if isinstance(kind, T.IntegralType):
        return F.col(key).cast("long")
    if isinstance(kind, T.FloatType | T.DoubleType):
        return (F.col(key) + F.lit(0.0)).cast("string")  # one zero only
    if isinstance(kind, T.StructType | T.ArrayType):
        return F.to_json(key)
    return F.hex(key) if isinstance(kind, T.BinaryType) else F.col(key).cast("string")


def _restored(name: str, kind: T.DataType) -> Column:
    """The key column that ``_carried`` made a number or text of."""
    if isinstance(kind, T.StructType | T.ArrayType):
        return F.from_json(name, kind)
    return F.unhex(name) if isinstance(kind, T.BinaryType) else F.col(name).cast(kind)


def _in_order(rows: DataFrame, key: list[str], processor: InOrder, fields: str, groups: int) -> DataFrame:
    """What the processor gives for the keys of ``rows``: the key columns and ``fields``.

    The engine calls the processor per group, which costs far more than a row does, and
    gives it the rows of all keys of the group.
    """
    kinds = {k: rows.schema[k].dataType for k in key}
    own = {f"own{i}": _carried(k, kinds[k]) for i, k in enumerate(key)}
    group = F.pmod(F.xxhash64(*own.values()), F.lit(groups)).alias("_group")
    grouped = rows.select(
        group, *[c.alias(n) for n, c in own.items()], *[c for c in rows.columns if c not in key])
    processor.carried = tuple("LONG" if isinstance(kind, T.IntegralType) else "STRING" for kind in kinds.values())
    processor.out = ", ".join([*(f"{n} {kind}" for n, kind in zip(own, processor.carried, strict=True)), fields])
    found = grouped.groupBy("_group").transformWithStateInPandas(
        processor, T.StructType.fromDDL(processor.out), "append", "EventTime")
    restored = [_restored(n, kinds[k]).alias(k) for n, k in zip(own, key, strict=True)]
    return found.select(*restored, *[c for c in found.columns if c not in own])


def _timed(df: DataFrame, fields: dict[str, str], *drop: str) -> DataFrame:
    """Micros as zone-less times, under the names of the batch operator."""
    columns = [
        F.timestamp_micros(c).cast("timestamp_ntz").alias(fields[c]) if c in fields else F.col(c)
        for c in df.columns if c not in drop
    ]
    return df.select(*columns)


def replay_autoscaler_stream(
    ticks: DataFrame, bounds: DataFrame, key: str | list[str], ts: str, seq: str, target: str,
    minimum: str, maximum: str, initial: str, cooldown: int, groups: int = GROUPS,
) -> DataFrame:
    """``replay_autoscaler`` on a watermarked stream; a change appears once it is final."""
    key = _keys(key)
    limits = bounds.select(
        *key, F.lit(True).alias("_known"), F.col(minimum).cast("int").alias("_min"),
        F.col(maximum).cast("int").alias("_max"),
        F.coalesce(F.col(initial), F.col(minimum), F.lit(0)).cast("long").alias("start"),
    )
    joined = ticks.join(limits, key, "left")
    rows = joined.where(timed(F.col("_known") & F.col(target).isNotNull(), ts)).select(
        *key, ts, micros(ts).alias("at_micros"), F.col(seq).cast("long").alias("at_seq"),
        F.least("_max", F.greatest("_min", F.col(target).cast("int"))).cast("long").alias("value"),
        "start",
    )
    changes = _in_order(
        rows, key, Cooldown(cooldown, True), f"at_micros LONG, {seq} LONG, old INT, new INT", groups)
    return _timed(changes, {"at_micros": ts})


def throttle_stream(
    events: DataFrame, key: str | list[str], ts: str, seq: str, cooldown: int, groups: int = GROUPS,
) -> DataFrame:
    """``throttle`` on a watermarked stream."""
    key = _keys(key)
    zero = F.lit(0).cast("long")
    known = reduce(and_, [F.col(k).isNotNull() for k in key])
    rows = events.where(timed(known, ts)).select(
        *key, ts, micros(ts).alias("at_micros"), F.col(seq).cast("long").alias("at_seq"),
        zero.alias("value"), zero.alias("start"),
    )
    kept = _in_order(
        rows, key, Cooldown(cooldown, False), f"at_micros LONG, {seq} LONG, old INT, new INT", groups)
    return _timed(kept, {"at_micros": ts}, "old", "new")


def idle_shutdowns_stream(
    activity: DataFrame, timeouts: DataFrame, key: str | list[str], ts: str, seq: str,
    timeout: str, period: int = IDLE_CHECK_PERIOD, forget: int | None = None, groups: int = GROUPS,
) -> DataFrame:
    """``idle_shutdowns`` on a watermarked stream; the watermark is the current time.

    With ``forget``, a cluster that shows activity more than that many seconds after its
    shutdown counts as created anew; with a generation among the keys, it does at once.
    """
    key = _keys(key)
    watched = timeouts.where(F.col(timeout) > 0).select(
        *key, F.col(timeout).cast("long").alias("_timeout")
    )
    zero = F.lit(0).cast("long")
    joined = activity.join(watched, key, "left")
    rows = joined.where(timed(F.col("_timeout").isNotNull(), ts)).select(
        *key, ts, micros(ts).alias("at_micros"), F.col(seq).cast("long").alias("at_seq"),
        F.col("_timeout").alias("value"), zero.alias("start"),
    )
    found = _in_order(rows, key, Idle(period, forget), "idle_since LONG, shutdown_at LONG", groups)
    return _timed(found, {c: c for c in ("idle_since", "shutdown_at")})


def job_runs_stream(
    events: DataFrame, key: str, ts: str, seq: str, phase: str, forget: int | None = None,
    groups: int = GROUPS,
) -> DataFrame:
    """Runs of jobs on a watermarked stream: a row whenever events of a job became final.

    The state holds phase, start and end, of an ended job for ``forget`` seconds more, after
    which an event of it is that of a new job. ``job_runs_table`` makes status fields of it.
    """
    code = F.array_position(F.array(*[F.lit(p) for p in JOB_STATUS]), F.col(phase))
    rows = events.where(timed(F.col(key).isNotNull(), ts)).select(
        key, ts, micros(ts).alias("at_micros"), F.col(seq).cast("long").alias("at_seq"),
        F.coalesce(code, F.lit(0)).cast("long").alias("value"), F.lit(0).cast("long").alias("start"),
    )
    followed = _in_order(
        rows, [key], JobRun(forget), "at_micros LONG, at_seq LONG, code LONG, started LONG, ended LONG", groups)
    status = F.element_at(F.array(*[F.lit(s) for s in JOB_STATUS.values()]), F.col("code").cast("int"))
    times = {c: F.timestamp_micros(c).cast("timestamp_ntz") for c in ("started", "ended")}
    return followed.withColumns(
        {"jobStatus": F.when(F.col("code") > 0, status), **times}).drop("code")


def job_runs_table(written: DataFrame, key: str) -> DataFrame:
    """``job_runs`` from the rows that ``job_runs_stream`` has written so far."""
    return job_fields(latest_state(written, [key], ["at_micros", "at_seq"]), key)


def ready_within_stream(
    events: DataFrame, key: str | list[str], ts: str, seq: str, created: Column, ready: Column,
    timeout: int, bucket_timeouts: int = BUCKET_TIMEOUTS,
) -> DataFrame:
    """``ready_within`` on a watermarked stream: an interval join, of which the first match counts.

    Both sides are kept and dropped by the engine as the watermark passes their interval.
    Time is cut into buckets of some timeouts, so a creation's answer lies in its own
    bucket or early in the next one; such a ready event also goes to the bucket before.
    The bucket is part of the join key, so a long history of one key spreads over many
    tasks. A creation's matches are those of one timeout.
    """
    key = _keys(key)
    width = timeout * bucket_timeouts * MICROS
    at = micros(ts)
    bucket = F.floor(at / width)
    early = at - bucket * width < timeout * MICROS
    left = events.where(timed(created, ts)).select(
        *key, F.col(ts).alias("_created"), F.col(seq).cast("long").alias(seq), bucket.alias("_bucket"))
    buckets = F.when(early, F.array(bucket, bucket - 1)).otherwise(F.array(bucket))
    right = events.where(timed(ready, ts)).select(
        *[F.col(k).alias(f"_ready_{k}") for k in key], F.col(ts).alias("_ready"), F.explode(buckets).alias("_ready_bucket"))
    same = [left[k] == right[f"_ready_{k}"] for k in key]
    within = (right["_ready"] >= left["_created"]) & (
        right["_ready"] < left["_created"] + F.expr(f"INTERVAL {timeout} SECONDS"))
    both = left.join(right, reduce(and_, same) & (left["_bucket"] == right["_ready_bucket"]) & within, "left_outer")
    settled = both.groupBy(*key, seq, "_created").agg(F.min("_ready").alias("_first"))
    return settled.select(
        *key, seq, F.col("_created").cast("timestamp_ntz").alias(ts), F.col("_first").cast("timestamp_ntz").alias("ready_ts"),
        F.when(F.col("_first").isNotNull(), "ready").otherwise("timed_out").alias("outcome"),
    )
