"""Replaying rules whose output feeds back: autoscaling with cooldown, and throttling.

The state of a key is its replica count and the time until which it sleeps. A window
cannot carry it, so sorted partitions stream through Arrow batches with the state of the
current key only.

A hot key is cut into consecutive pieces (see ``operators.heat``). What a piece does
depends on the state it starts with, so every piece is first tabulated: for each replica
count and each possible wake time, the state it ends with. Tables of neighbouring pieces
are composed level by level, the start state of every piece is read off on the way back,
and then all pieces replay at once. The result is that of one pass in order.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from musterroll.functions.phases import SCALE_DOWN_SHARE
from musterroll.operators.heat import PIECE, cut_pieces, same_values, small_side, split_hot
from musterroll.session import pinned

HOT_REPLAY_ROWS = 1_000_000
TABLE_CELLS = 4_000_000
FAN_IN = 16
AWAKE = -(2**62)
MICROS = 1_000_000


def next_replicas(current: int, bounded: int) -> int:
    """Replicas after one step towards a bounded target."""
    if current <= 0:
        return bounded
    return max(current - max(1, int(current * SCALE_DOWN_SHARE)), bounded)


# --- one pass over sorted rows -------------------------------------------------------


def _replayed(batches: Iterator[pa.RecordBatch], out: list[str], cooldown: int,
              scaling: bool) -> Iterator[pa.RecordBatch]:
    """Rows that fire, with the replica counts before and after."""
    state, wake = 0, AWAKE
    for batch in batches:
        if not batch.num_rows:
            continue
        times = batch.column("_ts").cast(pa.int64()).to_numpy().tolist()
        targets = batch.column("_target").to_numpy().tolist()
        starts, wakes = batch.column("_start"), batch.column("_wake")
        heads = np.flatnonzero(batch.column("_row").to_numpy() == 1).tolist()
        fired, before, after = [], [], []
        # What precedes the first head goes on with the key of the last batch.
        for head, end in zip([-1, *heads], [*heads, batch.num_rows]):
            row = max(head, 0)
            if head >= 0:
                state, wake = starts[head].as_py(), wakes[head].as_py()
            while row < end:
                if times[row] < wake:
                    row = bisect_left(times, wake, row, end)
                    continue
                new = next_replicas(state, targets[row]) if scaling else state
                if not scaling or new != state:
                    fired.append(row)
                    before.append(state)
                    after.append(new)
                    state, wake = new, times[row] + cooldown
                row += 1
        if fired:
            kept = [batch.column(n).take(pa.array(fired)) for n in out]
            yield pa.RecordBatch.from_arrays(
                [*kept, pa.array(before, pa.int32()), pa.array(after, pa.int32())],
                names=[*out, "old", "new"],
            )


def _replay(rows: DataFrame, keys: list[str], order: list[str], out: list[str], cooldown: int,
            scaling: bool) -> DataFrame:
    """Replay each key's rows in order.

    The row number marks where a key begins. It also is what makes Spark keep a key in
    one partition, in order: a plain ``repartition`` below ``mapInArrow`` may be dropped
    as redundant and its partitions then split by a skew join.
    """
    schema = T.StructType(
        [T.StructField(n, rows.schema[n].dataType) for n in out]
        + [T.StructField("old", T.IntegerType()), T.StructField("new", T.IntegerType())]
    )
    window = Window.partitionBy(*keys).orderBy(*order)

    def run(batches):
        return _replayed(batches, out, cooldown, scaling)

    return rows.withColumn("_row", F.row_number().over(window)).mapInArrow(run, schema)


# --- tables of what a piece does to any start state ----------------------------------


class Transition:
    """End state of a piece as a function of its start state.

    Row ``i`` holds for wake times in ``(bounds[i-1], bounds[i]]``, column ``r`` for
    ``low + r`` replicas. A wake time past the last bound passes through unchanged.
    """

    def __init__(self, bounds: np.ndarray, states: np.ndarray, wakes: np.ndarray):
        same = (states[:-1] == states[1:]).all(axis=1) & (wakes[:-1] == wakes[1:]).all(axis=1)
        keep = np.append(~same, True)
        self.bounds, self.states, self.wakes = bounds[keep], states[keep], wakes[keep]

    @classmethod
    def of_piece(cls, times: np.ndarray, targets: np.ndarray | None, width: int,
                 cooldown: int) -> Transition:
        """Tabulate backwards; ``targets`` is relative to the lowest replica count.

        Without targets every awake row fires and the state never changes.
        """
        n = len(times)
        wakes_at = np.maximum(
            np.searchsorted(times, times + cooldown, "left"), np.arange(1, n + 1)
        )
        # An end is the last row that fired (n for none) and the state, as one number.
        if targets is None:
            last = list(range(n + 1))
            for i, after in reversed(list(enumerate(wakes_at.tolist()))):
                if after < n:
                    last[i] = last[after]
            ends = np.array(last, np.int64)[:, None]
        else:
            every = np.arange(width)
            fires = targets != every
            ends = np.empty((n + 1, width), np.int64)
            ends[n] = n * width + every
            for i in range(n - 1, -1, -1):
                after = wakes_at[i]
                moved = ends[after].take(targets[i]) if after < n else i * width + targets[i]
                ends[i] = np.where(fires[i], moved, ends[i + 1])
        slept = np.append(times + cooldown, AWAKE)
        # Nothing before the piece can sleep beyond its first row plus the cooldown.
        reachable = int(np.searchsorted(times, times[0] + cooldown, "left"))
        bounds, rows = np.unique(times[: min(reachable, n - 1) + 1], return_index=True)
        return cls(bounds, (ends[rows] % width).astype(np.int32), slept[ends[rows] // width])

    def apply(self, states: np.ndarray, wakes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        rows = np.searchsorted(self.bounds, wakes, "left")
        inside = rows < len(self.bounds)
        rows = np.minimum(rows, len(self.bounds) - 1)
        return (np.where(inside, self.states[rows, states], states),
                np.where(inside, self.wakes[rows, states], wakes))

    def then(self, later: Transition) -> Transition:
        """This piece followed by a later one."""
        states, wakes = later.apply(self.states, self.wakes)
        beyond = later.bounds > self.bounds[-1]
        return Transition(
            np.append(self.bounds, later.bounds[beyond]),
            np.vstack([states, later.states[beyond]]),
            np.vstack([wakes, later.wakes[beyond]]),
        )

    def reachable(self, limit: int) -> Transition:
        """Without rows for wake times past ``limit``, which cannot occur."""
        last = min(int(np.searchsorted(self.bounds, limit, "left")), len(self.bounds) - 1)
        return Transition(self.bounds[: last + 1], self.states[: last + 1], self.wakes[: last + 1])

    def lists(self) -> list[pa.Array]:
        return [
            pa.array([self.bounds], pa.list_(pa.int64())),
            pa.array([self.states.ravel()], pa.list_(pa.int32())),
            pa.array([self.wakes.ravel()], pa.list_(pa.int64())),
        ]

    @classmethod
    def read_all(cls, table: pa.Table) -> list[Transition]:
        """The transitions of a table's rows, without making Python numbers of them."""
        columns = [table[n].combine_chunks() for n in ("bounds", "states", "wakes")]
        found = []
        for i in range(table.num_rows):
            bounds, states, wakes = (c[i].values.to_numpy() for c in columns)
            shape = (len(bounds), -1)
            found.append(cls(bounds, states.reshape(shape), wakes.reshape(shape)))
        return found


def _tables(
    pieces: DataFrame, keys: list[str], seq: str, cooldown: int, scaling: bool
) -> DataFrame:
    """One transition per piece; a piece is bounded, so a task holds little."""
    schema = T.StructType(
        [T.StructField(k, pieces.schema[k].dataType) for k in keys]
        + T.StructType.fromDDL(
            "_slot LONG, first LONG, _low INT, _start INT, bounds ARRAY<LONG>,"
            " states ARRAY<INT>, wakes ARRAY<LONG>"
        ).fields
    )

    def tabulate(table: pa.Table) -> pa.Table:
        table = table.sort_by([("_ts", "ascending"), (seq, "ascending")])
        times = table["_ts"].combine_chunks().cast(pa.int64()).to_numpy(zero_copy_only=False)
        low, width = table["_low"][0].as_py(), table["_width"][0].as_py()
        moves = None
        if scaling:
            counts = np.arange(low, low + width)
            allowed = np.maximum(1, (counts * SCALE_DOWN_SHARE).astype(np.int64))
            floor = np.where(counts > 0, counts - allowed, low)
            targets = table["_target"].to_numpy()
            moves = (np.maximum(floor[None, :], targets[:, None]) - low).astype(np.intp)
        found = Transition.of_piece(times, moves, width, cooldown)
        fixed = [table[n][:1].combine_chunks() for n in keys]
        slot = [pa.array([table[PIECE][0].as_py()], pa.int64()), pa.array([times[0]], pa.int64())]
        more = [table[n][:1].combine_chunks() for n in ("_low", "_start")]
        return pa.Table.from_arrays([*fixed, *slot, *more, *found.lists()], names=schema.names)

    return pieces.groupBy(*keys, PIECE).applyInArrow(tabulate, schema)


def _composed(tables: DataFrame, keys: list[str], fan_in: int, cooldown: int) -> DataFrame:
    """Transitions of up to ``fan_in`` neighbouring slots as one."""

    def compose(table: pa.Table) -> pa.Table:
        table = table.sort_by("_slot")
        first = table["first"][0].as_py()
        total, *others = Transition.read_all(table)
        for later in others:
            total = total.then(later).reachable(first + cooldown)
        fixed = [table[n][:1].combine_chunks() for n in keys]
        slot = [pa.array([table["_slot"][0].as_py() // fan_in], pa.int64())]
        more = [table[n][:1].combine_chunks() for n in ("first", "_low", "_start")]
        return pa.Table.from_arrays([*fixed, *slot, *more, *total.lists()], names=names)

    names = tables.schema.names
    grouped = tables.groupBy(*keys, F.floor(F.col("_slot") / fan_in).alias("_above"))
    return grouped.applyInArrow(compose, tables.schema)


def _started(tables: DataFrame, keys: list[str], fan_in: int) -> DataFrame:
    """Start state of each slot, from the start state ``_state, _wake`` of its parent."""
    schema = T.StructType(
        [T.StructField(k, tables.schema[k].dataType) for k in keys]
        + T.StructType.fromDDL("_slot LONG, _state INT, _wake LONG").fields
    )

    def walk(table: pa.Table) -> pa.Table:
        table = table.sort_by("_slot")
        low = table["_low"][0].as_py()
        state = np.array([table["_state"][0].as_py() - low])
        wake = np.array([table["_wake"][0].as_py()], np.int64)
        states, wakes = [], []
        for piece in Transition.read_all(table):
            states.append(int(state[0]) + low)
            wakes.append(int(wake[0]))
            state, wake = piece.apply(state, wake)
        fixed = [table[n].combine_chunks() for n in [*keys, "_slot"]]
        return pa.Table.from_arrays(
            [*fixed, pa.array(states, pa.int32()), pa.array(wakes, pa.int64())],
            names=schema.names,
        )

    grouped = tables.groupBy(*keys, F.floor(F.col("_slot") / fan_in).alias("_above"))
    return grouped.applyInArrow(walk, schema)


def _with_start_states(pieces: DataFrame, keys: list[str], seq: str, n_pieces: int, n_keys: int,
                       cooldown: int, scaling: bool, fan_in: int) -> DataFrame:
    """Pieces with the ``_start`` and ``_wake`` they begin with."""
    levels = [pinned(_tables(pieces, keys, seq, cooldown, scaling))]
    slots = n_pieces
    while slots > fan_in:
        levels.append(pinned(_composed(levels[-1], keys, fan_in, cooldown)))
        slots = -(-slots // fan_in)
    top = levels[-1].withColumns(
        {"_state": F.col("_start"), "_wake": F.lit(AWAKE).cast("long")}
    )
    starts = _started(top, keys, fan_in)
    for level in reversed(levels[:-1]):
        above = starts.withColumnsRenamed({k: f"_of_{k}" for k in [*keys, "_slot"]})
        match = same_values(level, above, {k: f"_of_{k}" for k in keys})
        parent = F.floor(level["_slot"] / fan_in) == above["_of__slot"]
        joined = level.join(above, match & parent).drop(*[f"_of_{k}" for k in [*keys, "_slot"]])
        starts = _started(joined, keys, fan_in)
    starts = starts.withColumnsRenamed({k: f"_of_{k}" for k in keys})
    match = same_values(pieces, starts, {k: f"_of_{k}" for k in keys})
    known = pieces.drop("_start", "_wake").join(
        small_side(starts, n_pieces + n_keys), match & (pieces[PIECE] == starts["_slot"])
    )
    return known.drop(*[f"_of_{k}" for k in keys], "_slot").withColumnRenamed("_state", "_start")


def _replay_keys(rows: DataFrame, limits: DataFrame | None, key: list[str], seq: str,
                 out: list[str], cooldown: int, scaling: bool, hot_rows: int | None,
                 fan_in: int) -> DataFrame:
    """``rows`` has ``_ts, _desired`` beside key and ``seq``; ``limits`` is per key."""
    order = ["_ts", seq]
    split = split_hot(rows, key, hot_rows)
    if limits is not None:
        split = split.joined(limits)

    def prepared(df: DataFrame) -> DataFrame:
        target = F.least("_max", F.greatest("_min", "_desired")) if scaling else F.col("_desired")
        start = F.col("_start") if scaling else F.lit(0)
        return df.select(*key, "_ts", seq, target.alias("_target"), start.alias("_start"),
                         F.lit(AWAKE).cast("long").alias("_wake"))

    passed = _replay(prepared(split.cold), key, order, out, cooldown, scaling)
    if split.hot is None:
        return passed
    hot, n_keys, n_rows = prepared(split.hot), split.n_keys, split.n_rows
    span = hot.groupBy(*key).agg(
        F.least(F.min("_target"), F.min("_start")).alias("_low"),
        (F.greatest(F.max("_target"), F.max("_start"))
         - F.least(F.min("_target"), F.min("_start")) + 1).cast("int").alias("_width"),
    )
    span = pinned(span.withColumnsRenamed({k: f"_of_{k}" for k in key}))
    width = span.agg(F.max("_width")).first()[0]
    n_pieces = max(2, -(-n_rows // max(1, min(hot_rows, TABLE_CELLS // width))))
    ranged = hot.join(
        small_side(span, n_keys), same_values(hot, span, {k: f"_of_{k}" for k in key})
    ).drop(*[f"_of_{k}" for k in key])
    pieces = cut_pieces(ranged, key, order, n_pieces)
    known = _with_start_states(pieces, key, seq, n_pieces, n_keys, cooldown, scaling, fan_in)
    return passed.unionByName(_replay(known, [*key, PIECE], order, out, cooldown, scaling))


# --- operators -----------------------------------------------------------------------


def replay_autoscaler(
    ticks: DataFrame, bounds: DataFrame, key: list[str], ts: str, seq: str, target: str,
    minimum: str, maximum: str, initial: str, cooldown: int,
    hot_rows: int | None = HOT_REPLAY_ROWS, fan_in: int = FAN_IN,
) -> DataFrame:
    """Replica changes of every cluster: ``key, ts, seq, old, new``.

    Ticks are taken in order of time and ``seq``. A tick inside the cooldown is skipped;
    otherwise one autoscale step is made from the carried replica count, and a change
    starts the cooldown. Ticks without a target, when the scheduler could not be asked,
    are skipped. A null bound means unbounded.
    """
    limits = bounds.select(
        *key, F.col(minimum).cast("int").alias("_min"), F.col(maximum).cast("int").alias("_max"),
        F.coalesce(F.col(initial), F.col(minimum), F.lit(0)).cast("int").alias("_start"),
    )
    rows = ticks.where(F.col(target).isNotNull()).select(
        *key, F.col(ts).alias("_ts"), seq, F.col(target).cast("int").alias("_desired")
    )
    changes = _replay_keys(
        rows, limits, key, seq, [*key, "_ts", seq], cooldown * MICROS, True, hot_rows, fan_in
    )
    return changes.withColumnRenamed("_ts", ts)


def throttle(
    events: DataFrame, key: list[str], ts: str, seq: str, cooldown: int,
    hot_rows: int | None = HOT_REPLAY_ROWS, fan_in: int = FAN_IN,
) -> DataFrame:
    """Events at least ``cooldown`` seconds after the last one kept of their key."""
    rows = events.select(*key, F.col(ts).alias("_ts"), seq, F.lit(0).alias("_desired"))
    kept = _replay_keys(
        rows, None, key, seq, [*key, "_ts", seq], cooldown * MICROS, False, hot_rows, fan_in
    )
    return kept.drop("old", "new").withColumnRenamed("_ts", ts)
