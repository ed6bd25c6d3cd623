"""A hot key cut into pieces gives the rows of the plain route and of brute force."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from musterroll.operators import heat, ordered, relate
from musterroll.streaming import replay, ticks
from musterroll.streaming.replay import next_replicas

START = datetime(2024, 1, 1)


def skewed_rows(n, seed, span=4000, grid=None):
    """Key 1 holds over a third; times repeat, some values and one key are null."""
    rng = random.Random(seed)
    rows = []
    for seq in range(n):
        key = 1 if rng.random() < 0.4 else rng.choice([2, 3, 4, 5, None])
        at = rng.randrange(0, span, grid or 1)
        value = None if rng.random() < 0.4 else rng.randrange(12)
        rows.append((key, START + timedelta(seconds=at), seq, value))
    return rows


@pytest.fixture(scope="module")
def events(spark):
    rows = skewed_rows(1500, 7)
    return spark.createDataFrame(rows, "key LONG, ts TIMESTAMP_NTZ, seq LONG, value INT").cache()


def collected(df):
    return sorted((tuple(r) for r in df.select(*sorted(df.columns)).collect()), key=repr)


def test_hot_keys_are_found_and_kept_whole(events):
    split = heat.split_hot(events, ["key"], 300)
    assert split.n_keys == 1
    assert split.hot.count() == split.n_rows == events.where("key = 1").count()
    assert split.cold.count() + split.n_rows == 1500
    assert split.cold.where("key IS NULL").count() == events.where("key IS NULL").count()


def test_pieces_are_balanced_and_ordered(events):
    hot = events.where("key = 1")
    pieces = heat.cut_pieces(hot, ["key"], ["ts", "seq"], 6)
    spans = pieces.groupBy("_piece").agg(
        F.min(F.struct("ts", "seq")).alias("a"), F.max(F.struct("ts", "seq")).alias("b"),
        F.count("*").alias("n"),
    ).orderBy("_piece").collect()
    assert len(spans) > 3
    assert all(x.b < y.a for x, y in zip(spans, spans[1:]))
    assert max(s.n for s in spans) < hot.count() / 2


@pytest.mark.parametrize("descending", [False, True])
@pytest.mark.parametrize("hot_rows", [50, 200])
def test_window_operators_agree(events, descending, hot_rows):
    def run(limit):
        args = dict(descending=descending, hot_rows=limit)
        order = ["ts", "seq"]
        return [
            collected(heat.numbered(events, ["key"], order, "n", **args)),
            collected(heat.with_previous(events, ["key"], order, {"p": "value", "q": "seq"}, **args)),
            collected(heat.with_latest(events, ["key"], order, {"p": "value"}, **args)),
        ]

    assert run(hot_rows) == run(None)


def test_window_operators_against_brute_force(events):
    rows = [tuple(r) for r in events.collect()]
    by_key = {}
    for row in sorted(rows, key=lambda r: (r[1], r[2])):
        by_key.setdefault(row[0], []).append(row)
    expected = {}
    for group in by_key.values():
        latest = None
        for i, (_, _, seq, value) in enumerate(group):
            latest = value if value is not None else latest
            expected[seq] = (i + 1, group[i - 1][3] if i else None, latest)
    out = heat.numbered(events, ["key"], ["ts", "seq"], "n", hot_rows=60)
    out = heat.with_previous(out, ["key"], ["ts", "seq"], {"before": "value"}, hot_rows=60)
    out = heat.with_latest(out, ["key"], ["ts", "seq"], {"upto": "value"}, hot_rows=60)
    found = {r.seq: (r.n, r.before, r.upto) for r in out.collect()}
    assert found == expected


def test_operators_built_on_them_agree(spark, events):
    keyed = events.where("key IS NOT NULL")
    as_of = F.expr("TIMESTAMP_NTZ'2024-01-01 02:00:00'")
    limits = spark.createDataFrame([(v, 3 + v) for v in range(12)], "value INT, limit_s LONG")
    timeouts = spark.createDataFrame([(k, 20 * k) for k in range(1, 6)], "key LONG, idle INT")
    wanted = spark.createDataFrame([(1, 333), (2, 5), (3, 0), (4, 10**6)], "key LONG, n LONG")

    def run(limit):
        hot = dict(hot_rows=limit)
        order = ["ts", "seq"]
        return [
            collected(ordered.field_changes(keyed, ["key"], order, "value", skip_first=True, **hot)),
            collected(ordered.stuck_in_phase(
                keyed, ["key"], order, "ts", "value", limits, as_of, **hot)),
            collected(ordered.lifo_victims(keyed, wanted, ["key"], order, **hot)),
            collected(relate.ready_within(
                keyed.where("value < 3"), keyed.where("value > 9"), ["key"], "ts", "seq", 7, **hot)),
            collected(relate.state_at(
                keyed.select("key", "ts").distinct(), keyed, ["key"], "ts", "seq", ["value"], **hot)),
            collected(ticks.state_on_grid(keyed, ["key"], "ts", "seq", ["value"], 7, **hot)),
            collected(relate.state_at(
                ticks.tick_samples(keyed, ["key"], "ts", 7), keyed, ["key"], "ts", "seq",
                ["value"], **hot)),
            collected(ticks.idle_gaps(
                keyed, timeouts, ["key"], "ts", "seq", "idle", as_of, **hot)),
        ]

    plain = run(None)
    assert all(plain)
    assert plain[5] == plain[6]
    assert run(40) == plain


def brute_autoscaler(rows, bounds, cooldown):
    out = []
    by_key = {}
    for key, ts, seq, target in sorted(rows, key=lambda r: (r[1], r[2])):
        if key in bounds and target is not None:
            by_key.setdefault(key, []).append((ts, seq, target))
    for key, group in by_key.items():
        low, high, state = bounds[key]
        wake = None
        for ts, seq, target in group:
            if wake is not None and ts < wake:
                continue
            aim = target if low is None else max(low, target)
            aim = aim if high is None else min(high, aim)
            new = next_replicas(state, aim)
            if new != state:
                out.append((key, ts, seq, state, new))
                state, wake = new, ts + timedelta(seconds=cooldown)
    return sorted(out)


@pytest.mark.parametrize("cooldown,span,grid,fan_in", [
    (15, 4000, None, 32),  # sparse against the cooldown
    (300, 4000, None, 2),  # cooldowns that reach over whole pieces, several levels
    (15, 7500, 5, 3),      # a regular grid, where paths never merge by themselves
    (0, 4000, None, 2),
    (10**6, 4000, None, 2),
])
def test_replay_against_brute_force(spark, cooldown, span, grid, fan_in):
    rows = skewed_rows(1200, cooldown + span, span, grid)
    bounds = {1: (1, 9, 4), 2: (0, 5, 0), 3: (None, None, 3), 4: (6, 2, 10)}
    events = spark.createDataFrame(rows, "key LONG, ts TIMESTAMP_NTZ, seq LONG, target INT")
    limits = spark.createDataFrame(
        [(k, *v) for k, v in bounds.items()], "key LONG, low INT, high INT, start INT"
    )
    expected = brute_autoscaler(rows, bounds, cooldown)
    for hot_rows in (None, 25, 150):
        out = replay.replay_autoscaler(
            events, limits, ["key"], "ts", "seq", "target", "low", "high", "start", cooldown,
            hot_rows=hot_rows, fan_in=fan_in,
        )
        assert sorted(tuple(r) for r in out.collect()) == expected


@pytest.mark.parametrize("cooldown,span,grid", [(15, 4000, None), (15, 7500, 5), (900, 4000, None)])
def test_throttle_against_brute_force(spark, cooldown, span, grid):
    rows = skewed_rows(1200, cooldown, span, grid)
    events = spark.createDataFrame(rows, "key LONG, ts TIMESTAMP_NTZ, seq LONG, value INT")
    last, expected = {}, []
    for key, ts, seq, _ in sorted(rows, key=lambda r: (r[1], r[2])):
        if key not in last or ts >= last[key] + timedelta(seconds=cooldown):
            last[key] = ts
            expected.append((key, ts, seq))
    for hot_rows in (None, 30, 200):
        out = replay.throttle(
            events, ["key"], "ts", "seq", cooldown, hot_rows=hot_rows, fan_in=2
        )
        assert sorted((tuple(r) for r in out.collect()), key=repr) == sorted(expected, key=repr)


def test_replay_survives_a_skew_join(spark):
    """Splitting skewed join partitions must not tear a key's history apart."""
    rows = skewed_rows(3000, 11)
    bounds = {k: (0, 9, 2) for k in range(1, 6)}
    events = spark.createDataFrame(
        rows, "key LONG, ts TIMESTAMP_NTZ, seq LONG, target INT"
    ).repartition(16)
    limits = spark.createDataFrame(
        [(k, *v) for k, v in bounds.items()], "key LONG, low INT, high INT, start INT"
    )
    eager = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1b",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "0.01",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "1kb",
        "spark.sql.adaptive.coalescePartitions.enabled": "false",
    }
    before = {k: spark.conf.get(k, None) for k in eager}
    try:
        for name, value in eager.items():
            spark.conf.set(name, value)
        out = replay.replay_autoscaler(
            events, limits, ["key"], "ts", "seq", "target", "low", "high", "start", 15,
            hot_rows=None,
        )
        found = sorted(tuple(r) for r in out.collect())
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)
    assert found == brute_autoscaler(rows, bounds, 15)
