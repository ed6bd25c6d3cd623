"""Streams in several batches, some rows out of order, give the batch operators' rows."""

import random
from datetime import datetime, timedelta
from pathlib import Path
from types import SimpleNamespace

import pandas as pd
import pytest
from pyspark.sql import functions as F

from musterroll.operators import relate, rollup
from musterroll.session import scratch_path
from musterroll.sources.snapshot import close_feed, closing_folder, read_watch
from musterroll.streaming import live, replay, scaling, ticks
from musterroll.streaming.buckets import BucketTable

START = datetime(2024, 1, 1)
SCHEMA = "key LONG, ts TIMESTAMP_NTZ, seq LONG, phase STRING, target INT"
PHASES = ["Created", "Pending", "Running", "Succeeded", "Failed"]
LATENESS = 120


@pytest.fixture(scope="module")
def feed(spark):
    """Six files in time order, but rows may be up to two minutes late."""
    rng = random.Random(3)
    rows = []
    for seq in range(900):
        at = seq * 10 + rng.random()
        key = 1 if rng.random() < 0.4 else rng.choice([2, 3, 4])
        rows.append((key, START + timedelta(seconds=at), seq, rng.choice(PHASES), rng.randrange(12)))
    arrival = sorted(rows, key=lambda r: r[2] * 10 + rng.random() * (LATENESS - 20))
    path = scratch_path(spark, "feed")
    for i in range(6):
        part = arrival[i * 150:(i + 1) * 150]
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(path)
    return path, spark.createDataFrame(rows, SCHEMA).cache()


def stream(spark, feed, closing=None):
    schema = feed[1].schema
    return read_watch(
        spark, feed[0], schema, lateness=f"{LATENESS} seconds", files_per_batch=1, closing=closing)


def settled(spark, feed, of_feed, label):
    """All rows of a stream whose feed has come to its end."""
    schema = feed[1].schema
    closing = closing_folder(spark, schema)
    end = F.lit(START + timedelta(days=40))
    return live.run_available(
        of_feed(stream(spark, feed, closing)), label,
        close=lambda: close_feed(spark, closing, schema, "ts", end))


def rows_of(df):
    return sorted(tuple(r) for r in df.collect())


def test_autoscaler(spark, feed):
    bounds = spark.createDataFrame(
        [(1, 1, 9), (2, 0, 5), (3, 2, 20), (4, 6, 3)], "key LONG, low INT, high INT"
    )
    args = ("ts", "seq", "target", "low", "high", "low", 45)
    found = settled(
        spark, feed, lambda f: live.replay_autoscaler_stream(f, bounds, "key", *args), "autoscaler")
    batch = replay.replay_autoscaler(feed[1], bounds, ["key"], *args)
    assert rows_of(found.select(batch.columns)) == rows_of(batch) and found.count() > 100


def test_throttle(spark, feed):
    found = settled(spark, feed, lambda f: live.throttle_stream(f, "key", "ts", "seq", 45), "throttle")
    batch = replay.throttle(feed[1], ["key"], "ts", "seq", 45)
    assert rows_of(found.select(batch.columns)) == rows_of(batch)


def test_throttle_by_namespace_and_name(spark, feed):
    def named(events):
        name = F.concat(F.lit("c"), F.col("key").cast("string"))
        return events.select((F.col("key") % 2).cast("string").alias("namespace"), name.alias("name"), "ts", "seq")

    key = ["namespace", "name"]
    found = settled(
        spark, feed, lambda f: live.throttle_stream(named(f), key, "ts", "seq", 45), "named")
    batch = replay.throttle(named(feed[1]), key, "ts", "seq", 45)
    assert rows_of(found.select(batch.columns)) == rows_of(batch)


def test_idle_shutdowns(spark, feed):
    timeouts = spark.createDataFrame([(1, 60), (2, 90), (3, 100000), (4, 0)], "key LONG, idle INT")
    found = settled(spark, feed, lambda f: live.idle_shutdowns_stream(
        f, timeouts, "key", "ts", "seq", "idle"), "idle")
    as_of = F.lit(START + timedelta(days=39)).cast("timestamp_ntz")
    batch = ticks.idle_shutdowns(feed[1], timeouts, ["key"], "ts", "seq", "idle", as_of)
    assert rows_of(found.select(batch.columns)) == rows_of(batch) and found.count() == 3


def test_every_row_of_the_feed_moves_the_clock(spark):
    """Events of other kinds and clusters settle a creation and an idle cluster."""
    path = scratch_path(spark, "feed")
    others = [(2, START + timedelta(seconds=s), 10 + s, "Pending", None) for s in range(0, 5000, 100)]
    for part in ([(1, START, 1, "Created", None)], others):
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(path)
    events = spark.read.parquet(path)
    feed = read_watch(spark, path, events.schema)
    ready = live.ready_within_stream(
        feed, "key", "ts", "seq", F.col("phase") == "Created", F.col("phase") == "Running", 50)
    found = live.run_available(ready, "ready").select("key", "outcome").collect()
    assert [tuple(r) for r in found] == [(1, "timed_out")]
    timeouts = spark.createDataFrame([(1, 60)], "key LONG, idle INT")
    idle = live.idle_shutdowns_stream(feed, timeouts, "key", "ts", "seq", "idle")
    assert [r.key for r in live.run_available(idle, "idle").collect()] == [1]


@pytest.mark.parametrize("bucket_timeouts", [1, 16])
def test_ready_within(spark, feed, bucket_timeouts):
    found = settled(spark, feed, lambda f: live.ready_within_stream(
        f, "key", "ts", "seq", F.col("phase") == "Created", F.col("phase") == "Running", 50,
        bucket_timeouts), "ready")
    batch = relate.ready_within(
        feed[1].where("phase = 'Created'"), feed[1].where("phase = 'Running'"), ["key"], "ts",
        "seq", 50,
    )
    assert rows_of(found.select(batch.columns)) == rows_of(batch) and found.count() > 100


def test_job_runs(spark, feed):
    found = settled(spark, feed, lambda f: live.job_runs_stream(f, "key", "ts", "seq", "phase"), "jobs")
    batch = rollup.job_runs(feed[1], "key", "ts", "phase", ["ts", "seq"])
    assert rows_of(live.job_runs_table(found, "key")) == rows_of(batch)


def test_coalesced_updates_survive_a_restart(spark, feed):
    columns = ["key", "ts", "seq", "target"]
    start = spark.createDataFrame([(1, START, -1, 0), (9, START, -1, 5)], "key LONG, ts TIMESTAMP, seq LONG, target INT")
    path = scratch_path(spark, "replicas")
    updates = stream(spark, feed).select(*columns)
    first = rows_of(live.coalesce_updates(updates, start, ["key"], ["ts", "seq"], path))
    again = rows_of(live.coalesce_updates(updates, start, ["key"], ["ts", "seq"], path))
    batch = rollup.latest_state(feed[1].select(*columns), ["key"], ["ts", "seq"])
    assert first == again == rows_of(batch) + [(9, START, -1, 5)]


def bucket_files(path):
    return {(p.parent.parent.name, p.parent.name): p.stat().st_size for p in Path(path.removeprefix("file:")).glob("data/*/*/*.parquet")}


def test_batches_write_only_the_buckets_they_touch(spark):
    path = scratch_path(spark, "buckets")
    start = spark.createDataFrame([(k, 0, "x", None) for k in range(20_000)], "key LONG, seq LONG, a STRING, b INT")
    table = BucketTable(spark, path, ["key"], ["seq"], start.schema, 16)
    table.start(start)
    table.start(start.limit(1))
    first = bucket_files(path)
    assert len({b for _, b in first}) == 16
    table.apply(spark.createDataFrame([(5, 9, None, 7), (5, 8, "y", None), (99_999, 1, "new", 1)], start.schema), 0)
    fresh = {k: v for k, v in bucket_files(path).items() if k[0] == "version=0"}
    assert 1 <= len({b for _, b in fresh}) <= 2 and sum(fresh.values()) < sum(first.values()) / 4
    rows = {r.key: tuple(r)[1:] for r in table.rows().collect()}
    assert rows[5] == (9, "y", 7) and rows[99_999] == (1, "new", 1) and len(rows) == 20_001
    # What no commit that can still be read refers to is gone.
    for version in range(1, 6):
        table.apply(spark.createDataFrame([(5, 9 + version, None, version)], start.schema), version)
    of_key = [v for v, b in bucket_files(path) if b == next(b for v, b in bucket_files(path) if v == "version=5")]
    assert sorted(of_key) == ["version=4", "version=5"]
    assert sorted(table.commits()) == [4, 5]
    assert table.rows().where("key = 5").first().b == 5 and table.rows().count() == 20_001


def test_a_killed_batch_leaves_no_half_version(spark, monkeypatch):
    path = scratch_path(spark, "buckets")
    start = spark.createDataFrame([(k, 0, "old") for k in range(100)], "key LONG, seq LONG, a STRING")
    table = BucketTable(spark, path, ["key"], ["seq"], start.schema, 4)
    table.start(start)
    update = spark.createDataFrame([(k, 1, "new") for k in range(100)], start.schema)

    def killed(*args):
        raise RuntimeError("killed")

    with monkeypatch.context() as patch, pytest.raises(RuntimeError, match="killed"):
        patch.setattr(BucketTable, "_commit", killed)
        table.apply(update, 0)
    assert bucket_files(path) and {r.a for r in table.rows().collect()} == {"old"}
    table.apply(update.limit(30), 0)
    assert sorted(r.a for r in table.rows().collect()) == ["new"] * 30 + ["old"] * 70
    # A repeated batch that counts already changes nothing, and none ever goes back.
    table.apply(update, 0)
    table.apply(update.where("key < 0"), 1)
    assert sorted(r.a for r in table.rows().collect()) == ["new"] * 30 + ["old"] * 70


def test_late_updates_set_what_nothing_newer_has_set(spark):
    schema = "key LONG, seq LONG, a STRING, b STRING"
    updates = [(1, 5, "a5", None), (1, 9, None, "b9"), (1, 7, "a7", "b7"), (2, 1, "x", None), (1, 6, "a6", "b6")]
    path = scratch_path(spark, "buckets")
    table = BucketTable(spark, path, ["key"], ["seq"], spark.createDataFrame([], schema).schema, 4)
    table.start(spark.createDataFrame([], schema))
    for version, row in enumerate(updates):
        table.apply(spark.createDataFrame([row], schema), version)
    assert rows_of(table.rows()) == [(1, 9, "a7", "b9"), (2, 1, "x", None)]


def test_ticks_ask_sources_in_order_and_only_ready_schedulers(spark):
    at = lambda s: START + timedelta(seconds=s)
    rows = [(1, at(0), 1, None, 4, 9), (1, at(12), 2, True, None, None), (1, at(21), 3, None, -1, None), (1, at(33), 4, None, None, -1),
            (1, at(41), 5, None, 6, None), (1, at(52), 6, False, 7, None), (1, at(60), 7, None, None, None), (2, at(0), 1, True, None, None),
            (2, at(20), 2, None, None, None)]
    changes = spark.createDataFrame(rows, "key LONG, ts TIMESTAMP_NTZ, seq LONG, ready BOOLEAN, http INT, rpc INT")
    found = rows_of(scaling.targets_at_ticks(changes, ["key"], "ts", "seq", "ready", ["http", "rpc"], 10))
    assert found == [(1, at(20), 4), (1, at(30), 9), (1, at(50), 6)]
    bounds = spark.createDataFrame([(1, 1, 5), (2, 2, None), (3, None, 4)], "key LONG, minimum INT, maximum INT")
    members = spark.createDataFrame([(1,), (2,), (2,), (9,)], "key LONG")
    plan = scaling.scaling_plan(changes, bounds, members, ["key"], "ts", "seq", "ready", ["http", "rpc"], 10, 15)
    # 4 at 20 s; 30 s is within the cooldown; 6 is cut to 5 at 50 s.
    assert rows_of(plan.select("key", "desired", "moves", "current", "needed", "action")) == [
        (1, 5, 2, 1, 4, "up"), (2, 2, 0, 2, 0, "none"), (3, 0, 0, 0, 0, "none")]


class Kept:
    """The state of one key in memory, with the calls that the processors make."""

    def __init__(self, processor):
        self.maps, self.value, self.timers, self.most = {}, None, set(), 0
        self.processor = processor
        processor.init(self)

    def getMapState(self, *_):
        return SimpleNamespace(
            keys=lambda: list(self.maps), containsKey=self.maps.__contains__, getValue=self._read,
            updateValue=self.maps.__setitem__, removeKey=self.maps.pop)

    def _read(self, key):
        self.most = max(self.most, len(self.maps[key][0]))
        return self.maps[key]

    def getValueState(self, *_):
        return SimpleNamespace(
            exists=lambda: self.value is not None, get=lambda: self.value,
            update=lambda v: setattr(self, "value", v), clear=lambda: setattr(self, "value", None))

    def registerTimer(self, at):
        self.timers.add(at)

    def feed(self, rows):
        frame = pd.DataFrame(rows, columns=["at_micros", "at_seq", "value", "start"])
        list(self.processor.handleInputRows((1,), iter([frame]), None))

    def time(self, seconds):
        """Let the watermark come to a time; the rows that follow."""
        found, now = [], seconds * 1000
        while due := [t for t in self.timers if t <= now]:
            self.timers.difference_update(due)
            frames = self.processor.handleExpiredTimer((1,), SimpleNamespace(getCurrentWatermarkInMs=lambda: now), None)
            found += [tuple(r) for f in frames for r in f.itertuples(index=False)]
        return found


def test_rows_of_a_hot_key_are_stepped_through_in_chunks():
    rows = [(s * 1_000_000, s, 0, 0) for s in range(30_000)]
    kept = Kept(live.Cooldown(45, False, "key LONG, at LONG, seq LONG, old INT, new INT"))
    random.Random(1).shuffle(rows)
    for at in range(0, len(rows), 5000):
        kept.feed(rows[at : at + 5000])
    found = [r[2] for r in kept.time(29_000)]
    assert found == list(range(0, 29_000, 45)) and kept.most <= 600
    assert [r[2] for r in kept.time(40_000)] == list(range(29_025, 30_000, 45))
    assert not kept.maps and kept.value is None


def test_ended_jobs_and_pauses_expire():
    out = "key LONG, at LONG, seq LONG, code LONG, started LONG, ended LONG"
    job = Kept(live.JobRun(100, out))
    names = list(live.JOB_STATUS)
    running, ended = names.index("Running") + 1, names.index(live.FINAL_PHASES[0]) + 1
    job.feed([(10_000_000, 1, running, 0), (20_000_000, 2, ended, 0)])
    assert job.time(30)[-1][-2:] == (10_000_000, 20_000_000) and job.value is not None
    job.time(130)
    assert job.value is None and not job.timers
    kept_for_ever = Kept(live.JobRun(None, out))
    kept_for_ever.feed([(20_000_000, 2, ended, 0)])
    kept_for_ever.time(10**6)
    assert kept_for_ever.value is not None


@pytest.mark.parametrize("forget, shutdowns", [(None, 1), (1000, 2)])
def test_recreated_clusters_are_shut_down_again(forget, shutdowns):
    kept = Kept(live.Idle(5, forget, "key LONG, idle_since LONG, shutdown_at LONG"))
    kept.feed([(0, 1, 60, 0), (30_000_000, 2, 60, 0)])
    found = kept.time(500)
    assert found == [(1, 30_000_000, 95_000_000)]
    found += kept.time(1200)
    kept.feed([(1_300_000_000, 3, 60, 0)])
    found += kept.time(5000)
    assert len(found) == shutdowns

class Counted(Kept):
    """The state of a group, which counts the calls that go to the engine."""

    def __init__(self, processor):
        self.calls = 0
        processor.carried = ("LONG",)
        super().__init__(processor)

    def getMapState(self, *_):
        return self._counted(super().getMapState())

    def getValueState(self, *_):
        return self._counted(super().getValueState())

    def _counted(self, state):
        def counted(call):
            def run(*args):
                self.calls += 1
                return call(*args)
            return run
        return SimpleNamespace(**{name: counted(call) for name, call in vars(state).items()})

    def registerTimer(self, at):
        self.calls += 1
        super().registerTimer(at)

    def feed(self, rows):
        frame = pd.DataFrame(rows, columns=["at_micros", "at_seq", "value", "start", "own0"])
        list(self.processor.handleInputRows((0,), iter([frame]), None))


def month(keys, rows, rng, value=lambda key: 0):
    """Rows of some keys over 30 days, seconds apart or days, as they may arrive."""
    found = [(rng.randrange(30 * 86_400) * 1_000_000, n, value(key), key % 3, key) for key in range(keys) for n in range(rows)]
    rng.shuffle(found)
    return found


def stepped(step, rows):
    """What one pass over the sorted rows of each key gives; ``step`` starts anew for a key."""
    found = []
    for key in sorted({r[4] for r in rows}):
        found += [(key, *r) for r in step(sorted(r[:4] for r in rows if r[4] == key))]
    return sorted(found)


def passed(cooldown, scaling):
    def step(rows):
        found, count, wake = [], rows[0][3], None
        for t, seq, value, _ in rows:
            new = replay.next_replicas(count, value) if scaling else count
            if (wake is None or t >= wake) and not (scaling and new == count):
                found.append((t, seq, count, new))
                count, wake = new, t + cooldown * 1_000_000
        return found
    return step


def fed(kept, rows, parts=4):
    for at in range(parts):
        kept.feed(rows[at::parts])
    return kept


def test_keys_of_a_group_share_the_calls_of_an_autoscaler():
    rng = random.Random(5)
    rows = [(t, n, rng.randrange(12), start, key) for t, n, _, start, key in month(30, 60, rng)]
    kept = fed(Counted(live.Cooldown(21_600, True, "own0 LONG, at LONG, seq LONG, old INT, new INT")), rows)
    half = kept.time(15 * 86_400)
    assert sorted(half + kept.time(40 * 86_400)) == stepped(passed(21_600, True), rows)
    # 1,800 rows in as many entries took several calls each.
    assert kept.calls < 150 and not kept.maps and kept.value is not None


def test_one_timer_settles_the_idle_keys_of_a_group():
    rng = random.Random(6)
    rows = month(30, 60, rng, value=lambda key: 40_000 + 3_000 * key)

    def step(rows):
        for (t, _, timeout, _), after in zip(rows, [*rows[1:], (31 * 86_400 * 1_000_000, 0, 0, 0)]):
            shutdown = ((t + timeout * 1_000_000) // 5_000_000 + 1) * 5_000_000
            if shutdown < after[0]:
                return [(t, shutdown)]
        return []

    kept = fed(Counted(live.Idle(5, None, "own0 LONG, idle_since LONG, shutdown_at LONG")), rows)
    found = [r for day in range(0, 31, 3) for r in kept.time(day * 86_400)]
    expected = stepped(step, rows)
    assert sorted(found + kept.time(31 * 86_400)) == expected and 10 < len(expected) < 31
    assert kept.calls < 300 and not kept.maps


@pytest.mark.parametrize("entry_rows", [4, 512])
def test_throttled_rows_lie_in_few_entries_and_keep_their_order(monkeypatch, entry_rows):
    monkeypatch.setattr(live, "ENTRY_ROWS", entry_rows)
    rng = random.Random(7)
    rows = [r for r in month(20, 60, rng) for _ in range(1 + (r[1] % 10 == 0))]
    rows += [(t - t % 86_400_000_000, seq, 0, 0, key) for t, seq, _, _, key in rows[::3]]
    rng.shuffle(rows)
    kept = fed(Counted(live.Cooldown(21_600, False, "own0 LONG, at LONG, seq LONG, old INT, new INT")), rows, 7)
    places = sorted(kept.maps)
    held = [r for p in places for r in zip(*kept.maps[p])]
    assert sorted(held) == sorted(rows) and [r[:2] for r in held] == sorted(r[:2] for r in held)
    assert places == [min(zip(*kept.maps[p]))[:2] for p in places] and len(places) < 4 * len(rows) / entry_rows + 1
    found = [r[:3] for day in range(0, 45, 4) for r in kept.time(day * 86_400)]
    zeros = [(*r[:3], 0, r[4]) for r in rows]
    assert sorted(found) == [r[:3] for r in stepped(passed(21_600, False), zeros)]
    assert not kept.maps and kept.value is None


def test_rows_without_seq_come_first_and_those_without_time_not_at_all():
    kept = Kept(live.Cooldown(45, False, "key LONG, at LONG, seq LONG, old INT, new INT"))
    kept.feed([(10_000_000, 7.0, 0, 0), (10_000_000, None, 0, 0), (None, 1.0, 0, 0), (60_000_000, 3.0, 0, 0)])
    assert [(at, None if seq != seq else seq) for _, at, seq, *_ in kept.time(100)] == [(10_000_000, None), (60_000_000, 3)]


@pytest.mark.parametrize("groups", [1, 4096])
def test_throttle_by_keys_of_other_types(spark, feed, groups):
    def typed(events):
        key = F.col("key")
        return events.select(
            F.date_add(F.lit("2024-01-01").cast("date"), key.cast("int")).alias("day"),
            F.unhex(F.lpad(F.hex(key + 250), 4, "0")).alias("raw"), (key / 3).alias("share"),
            F.struct(key.alias("id"), F.when(key > 2, "x").alias("tag")).alias("at"),
            (key / 10).cast("decimal(9,2)").alias("price"), "ts", "seq")

    key = ["day", "raw", "share", "at", "price"]
    found = settled(
        spark, feed, lambda f: live.throttle_stream(typed(f), key, "ts", "seq", 45, groups=groups), "typed")
    batch = replay.throttle(typed(feed[1]), key, "ts", "seq", 45)
    assert found.schema[:5] == batch.schema[:5] and rows_of(found) == rows_of(batch)


def test_jobs_of_a_group_give_one_row_each_time_they_are_settled():
    rng = random.Random(8)
    rows = month(25, 60, rng)
    rows = [(t, seq, rng.randrange(len(live.JOB_STATUS) + 1), 0, key) for t, seq, _, _, key in rows]
    out = "own0 LONG, at LONG, seq LONG, code LONG, started LONG, ended LONG"
    job = live.JobRun(None, out)

    def step(rows):
        before, started, ended = None, None, None
        for t, seq, code, _ in rows:
            if code != before:
                started = t if code == job.running else started
                ended = t if code in job.final else ended
            before = code
        return [(t, seq, code, started, ended)]

    kept = fed(Counted(job), rows)
    plain = lambda found: sorted(tuple(None if v is None or v != v else int(v) for v in r) for r in found)
    early = [r for r in rows if r[0] < 20 * 86_400_000_000]
    assert plain(kept.time(20 * 86_400)) == stepped(step, early)
    # All 1,500 rows were in entries of their own, and each gave a row.
    assert plain(kept.time(40 * 86_400)) == [r for r in stepped(step, rows) if r[1] >= 20 * 86_400_000_000]
    assert kept.calls < 150 and not kept.maps and len(kept.value[0]) == 25
