"""Small hand-made cases of the single rules."""

import json
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from musterroll.functions import clock, counting, labels, manifests, names, phases
from musterroll.operators import closure, expand, matching, ordered, relate, rollup, select, sets
from musterroll.operators.handlers import Handlers, Rule, rule_rows
from musterroll.plans.roles import WORDS
from musterroll.sources import logs, snapshot, specs
from musterroll.sources.schemas import schema_of
from musterroll.streaming import ticks
from musterroll.streaming.replay import next_replicas

T0 = datetime(2024, 1, 1)


def values(df, *columns):
    rows = df.select(*columns).collect()
    return sorted((tuple(r) if len(columns) > 1 else r[0] for r in rows), key=repr)


@pytest.mark.parametrize("name,phase,reason", [
    ("valid-name", "Created", None),
    ("a" * 53, "Created", None),
    ("a" * 54, "Error", "too long"),
    ("invalid.chars.in.name", "Error", "bad characters"),
    ("-starts-wrong", "Error", "bad characters"),
    ("ends-wrong-", "Error", "bad characters"),
    ("Upper", "Error", "bad characters"),
    ("newline\n", "Error", "bad characters"),
    ("", "Error", "bad characters"),
    (None, "Error", "bad characters"),
])
def test_names(spark, name, phase, reason):
    df = spark.createDataFrame([(name,)], "name STRING")
    row = select.split_valid_names(df, "name").first()
    assert (row.phase, row.reason) == (phase, reason)


@pytest.mark.parametrize("current,desired,low,high,expected", [
    (0, 5, 1, 10, 5), (1, 0, 0, 10, 0), (3, 0, 0, 10, 2), (4, 0, 0, 10, 3), (8, 0, 0, 10, 6),
    (100, 0, 0, 10, 75), (100, 200, 0, 10, 75), (2, 50, 0, 10, 10), (2, 0, 5, 10, 5),
    (2, 4, 9, 3, 3), (0, 0, 0, 0, 0), (5, 7, None, None, 7), (100, 0, None, None, 75),
    (5, None, 1, 9, None),
])
def test_step_target(spark, current, desired, low, high, expected):
    df = spark.createDataFrame([(current, desired, low, high)], "c INT, d INT, lo INT, hi INT")
    got = df.select(phases.step_target(F.col("c"), F.col("d"), F.col("lo"), F.col("hi"))).first()[0]
    assert got == expected
    if desired is not None:
        aim = desired if low is None else max(low, desired)
        assert next_replicas(current, aim if high is None else min(high, aim)) == expected


def test_reserved_keys(spark):
    notes = {"test-annotation": "v", "kopf.zalando.org/foobar": "x", "kubectl.kubernetes.io": "y"}
    df = spark.createDataFrame([(notes,)], "notes MAP<STRING, STRING>")
    assert labels.drop_reserved_keys(df, "notes").first()[0] == {"test-annotation": "v"}


def test_merge_layers_last_wins_and_missing_is_empty(spark):
    df = spark.createDataFrame(
        [({"a": "1", "b": "1"}, {"b": "2"}, None), (None, None, None)],
        "x MAP<STRING, STRING>, y MAP<STRING, STRING>, z MAP<STRING, STRING>",
    )
    merged = df.select(labels.merge_layers(F.col("x"), F.col("y"), F.col("z"))).collect()
    assert [r[0] for r in merged] == [{"a": "1", "b": "2"}, {}]


def test_inject_env_keeps_what_is_set(spark):
    schema = "cs ARRAY<STRUCT<name: STRING, env: ARRAY<STRUCT<name: STRING, value: STRING>>>>, d STRING"
    df = spark.createDataFrame([([("w", [("NAME", "mine")]), ("x", None), ("y", [])], "given")], schema)
    found = df.select(labels.inject_env(F.col("cs"), {"NAME": F.col("d"), "ADDR": F.lit("tcp")})).first()[0]
    assert [[tuple(e) for e in c.env] for c in found] == [
        [("NAME", "mine"), ("ADDR", "tcp")], [("NAME", "given"), ("ADDR", "tcp")],
        [("NAME", "given"), ("ADDR", "tcp")],
    ]


def test_pairs(spark):
    rows = [(1, 1, "A=1"), (1, 2, "B=2"), (1, 3, "A=3"), (1, 4, "C"), (1, 5, "D=1=2"), (2, 6, "E="),
            (2, 7, None)]
    df = spark.createDataFrame(rows, "doc LONG, n LONG, pair STRING")
    found = {r.doc: r.settings for r in labels.pairs_to_settings(df, ["doc"], "pair", ["n"]).collect()}
    assert found == {1: {"A": "3", "B": "2"}, 2: {"E": ""}}
    assert values(labels.pair_errors(df, "pair"), "n") == [4, 5, 7]


def test_overlay_takes_highest_layer_with_a_value(spark):
    rows = [("k", 0, "base", "v0"), ("k", 1, "user", None), ("k", 2, "call", "v2"),
            ("m", 0, "base", "v"), ("m", 2, "call", None), ("n", 1, "user", None)]
    df = spark.createDataFrame(rows, "k STRING, p INT, s STRING, v STRING")
    assert values(labels.overlay_settings(df, ["k"], "p", "v", "s"), "k", "v", "s") == [
        ("k", "v2", "call"), ("m", "v", "base"), ("n", None, None)]


@pytest.mark.parametrize("address,host,port", [
    ("tcp://10.0.0.1:8786", "10.0.0.1", 8786), ("http://h.example/a/b?c=d", "h.example", None),
    ("http://h:80/x:y", "h", 80), ("tcp://h", "h", None),
])
def test_addresses(spark, address, host, port):
    df = spark.createDataFrame([(address,)], "a STRING")
    row = names.address_inventory(df, "a").first()
    assert (row.host, row.port, row.n_addresses) == (host, port, 1)


def test_pod_phase(spark):
    rows = [
        ("Running", True, []), ("Running", False, []), ("Running", False, [(None,), ("Back",)]),
        ("Running", True, [("First",), ("Last",), (None,)]), ("Pending", False, [("Back",)]),
        ("Running", None, None), (None, False, []),
    ]
    df = spark.createDataFrame(
        rows, "phase STRING, ready BOOLEAN, cs ARRAY<STRUCT<waiting_reason: STRING>>")
    shown = df.select(phases.pod_phase(F.col("phase"), F.col("ready"), F.col("cs"))).collect()
    assert [r[0] for r in shown] == [
        "Running", "Health Checking", "Back", "Last", "Pending", "Health Checking", None]


def test_crash_looping_is_strict_and_needs_a_timeout(spark):
    back = [("CrashLoopBackOff",)]
    rows = [("Running", False, back, 61), ("Running", False, back, 60), ("Running", True, back, 99),
            ("Pending", False, back, 99), ("Running", False, [("Other",), (None,)], 99),
            ("Running", False, None, 99)]
    df = spark.createDataFrame(
        rows, "p STRING, r BOOLEAN, c ARRAY<STRUCT<waiting_reason: STRING>>, s INT")

    def found(timeout):
        return [r[0] for r in df.select(phases.crash_looping(
            F.col("p"), F.col("r"), F.col("c"), F.col("s"), timeout)).collect()]

    assert found(60) == [True] + [False] * 5
    assert found(None) == found(0) == [False] * 6


def test_levels(spark):
    df = spark.createDataFrame([("DEBUG",), ("INFO",), ("ERROR",), ("odd",)], "l STRING")
    assert values(phases.min_level(df, "l", "INFO"), "l") == ["ERROR", "INFO"]
    assert values(phases.min_level(df, "l", 35), "l") == ["ERROR"]
    assert values(phases.min_level(df, "l", 0, enabled=False), "l") == []


def test_severity_and_service_phase(spark):
    df = spark.createDataFrame([("Running",), ("Health Checking",), ("Error",), ("Odd",), (None,)], "p STRING")
    assert [r[0] for r in df.select(phases.phase_severity(F.col("p"))).collect()] == [
        "green", "yellow", "red", "none", "-"]
    df = spark.createDataFrame(
        [("LoadBalancer", None), ("LoadBalancer", []), ("LoadBalancer", [1]), ("ClusterIP", None)],
        "t STRING, i ARRAY<INT>")
    assert [r[0] for r in df.select(phases.service_phase(F.col("t"), F.col("i"))).collect()] == [
        "Pending", "Pending", "Running", "Running"]


def test_selectors(spark):
    df = spark.createDataFrame(
        [(1, {"a": "1", "b": "2"}), (2, {"a": "1"}), (3, {}), (4, None)], "id INT, labels MAP<STRING, STRING>")
    assert values(select.select_labels(df, "a=1, b=2"), "id") == [1]
    assert values(select.select_labels(df, {"a": "1"}), "id") == [1, 2]
    assert values(select.select_labels(df, ""), "id") == [1, 2, 3, 4]


def test_promoted_label_reaches_the_scan(spark, tmp_path):
    path = str(tmp_path / "pods")
    spark.createDataFrame([("s", {"a": "1"})], "component STRING, labels MAP<STRING, STRING>").write.parquet(path)
    found = select.select_labels(
        spark.read.parquet(path), "component=s,a=1", columns={"component": "component"})
    plan = found._jdf.queryExecution().toString()
    assert "EqualTo(component,s)" in plan
    assert found.count() == 1


def test_constraints_and_resources(spark):
    df = spark.createDataFrame([(1, None, "3", None), (2, "x", "3.5", "On"), (3, "x", "-4", "Off")],
                               "id INT, name STRING, n STRING, mode STRING")
    rules = [select.Required("name"), select.IntegerValue("n"), select.OneOf("mode", ("Off",))]
    assert values(select.check_constraints(df, ["id"], rules), "id", "field", "rule") == [
        (1, "name", "Required"), (2, "mode", "OneOf"), (2, "n", "IntegerValue")]
    assert values(select.fill_defaults(df, {"mode": "Off"}), "mode") == ["Off", "Off", "On"]
    df = spark.createDataFrame([(1, {"limit": "{}", "limits": '{"cpu": "1"}', "requests": "2"})],
                               "id INT, r MAP<STRING, STRING>")
    assert values(select.check_resource_keys(df, ["id"], "r"), "field", "problem") == [
        ("limit", "unknown field"), ("requests", "not a mapping")]


def test_lifo_takes_the_newest(spark):
    workers = [f"w{i}" for i in range(1, 6)]
    df = spark.createDataFrame([("g", i, w) for i, w in enumerate(workers)], "g STRING, at INT, name STRING")

    def victims(n):
        wanted = spark.createDataFrame([("g", n)], "g STRING, n INT")
        found = ordered.lifo_victims(df, wanted, ["g"], ["at", "name"])
        return [r.name for r in found.orderBy(F.desc("rank")).collect()]

    assert victims(2) == ["w4", "w5"]
    assert victims(0) == victims(-3) == []
    assert victims(9) == workers


def test_field_changes_handles_null_and_first(spark):
    rows = [(1, 1, None), (1, 2, "a"), (1, 3, "a"), (1, 4, None), (1, 5, "b"), (2, 1, "a")]
    df = spark.createDataFrame(rows, "k INT, n INT, f STRING")
    assert values(ordered.field_changes(df, ["k"], ["n"], "f"), "k", "n", "old") == [
        (1, 2, None), (1, 4, "a"), (1, 5, None), (2, 1, None)]
    later = ordered.field_changes(df, ["k"], ["n"], "f", skip_first=True)
    assert values(later, "k", "n") == [(1, 2), (1, 4), (1, 5)]
    assert values(ordered.field_changes(df, ["k"], ["n"], "f", new="b"), "k", "n") == [(1, 5)]


def test_reconcile_counts_empty_groups(spark):
    desired = spark.createDataFrame([(1, 3), (2, 1), (3, 2)], "g INT, desired INT")
    actual = spark.createDataFrame([(1,), (2,), (2,), (2,), (9,)], "g INT")
    plan = relate.reconcile(desired, actual, ["g"])
    assert values(plan, "g", "current", "needed", "action") == [
        (1, 1, 2, "up"), (2, 3, -2, "down"), (3, 0, 2, "up")]


def test_expand_workers_is_repeatable_and_unique(spark):
    groups = spark.createDataFrame([("g", 3, 2), ("h", 0, 1), ("i", -2, 5), ("j", 1, None)], "g STRING, needed INT, last_ordinal INT")
    rows = values(expand.expand_workers(groups, "g"), "g", "ordinal", "worker_name")
    assert [r[:2] for r in rows] == [("g", 3), ("g", 4), ("g", 5), ("j", 1)]
    assert len({r[2] for r in rows}) == 4
    assert all(r[2].startswith(f"{r[0]}-worker-") and len(r[2]) == 25 for r in rows)
    assert rows == values(expand.expand_workers(groups, "g"), "g", "ordinal", "worker_name")


@pytest.mark.parametrize("batch,expected", [
    (2, [(1, 2, 0), (2, 2, 30), (3, 1, 60)]), (None, [(1, 5, 0)]), (0, [(1, 5, 0)]), (9, [(1, 5, 0)]),
])
def test_creation_waves(spark, batch, expected):
    df = spark.createDataFrame([("g", 5, T0), ("h", 0, T0), ("i", -1, T0)], "g STRING, n INT, t TIMESTAMP_NTZ")
    waves = expand.creation_waves(df, "g", "n", "t", batch, 30).select(
        "wave", "wave_size", clock.seconds_between(F.lit(T0).cast("timestamp_ntz"), "wave_at"))
    assert sorted(tuple(r) for r in waves.collect()) == expected


def test_numbered_rows_past_a_block(spark):
    df = spark.createDataFrame([("a", 23), ("b", 0), ("c", 10), ("d", None)], "k STRING, n INT")
    rows = values(counting.numbered_rows(df, ["k"], F.col("n"), "i", block=5), "k", "i")
    assert rows == sorted([("a", i) for i in range(23)] + [("c", i) for i in range(10)], key=repr)


def test_ticks_lie_on_the_grid(spark):
    at = [T0.replace(second=s) for s in (3, 10, 22)] + [T0.replace(second=20, microsecond=1)]
    df = spark.createDataFrame([(1, t) for t in at] + [(2, T0.replace(second=1))], "k INT, t TIMESTAMP_NTZ")
    found = values(ticks.tick_samples(df, ["k"], "t", 5), "k", "t")
    assert sorted(t.second for _, t in found) == [5, 10, 15, 20]


def test_idle_check_is_strict(spark):
    df = spark.createDataFrame([(1, T0, 1), (1, T0.replace(second=20), 2)], "k INT, t TIMESTAMP_NTZ, n INT")
    as_of = F.lit(T0.replace(minute=5)).cast("timestamp_ntz")

    def first(timeout):
        limits = spark.createDataFrame([(1, timeout)], "k INT, idle INT")
        found = ticks.idle_shutdowns(df, limits, ["k"], "t", "n", "idle", as_of).collect()
        return [((r.idle_since - T0).seconds, (r.shutdown_at - T0).seconds) for r in found]

    assert first(9) == [(0, 10)]
    assert first(10) == [(0, 15)]
    assert first(15) == [(20, 40)]  # the check at 20 s meets the new activity
    assert first(0) == first(None) == []
    assert first(10**6) == []


def test_closure_ends_cycles_and_keeps_least_depth(spark):
    edges = spark.createDataFrame(
        [("a", "b"), ("b", "c"), ("a", "c"), ("c", "a"), ("c", "d"), ("x", "y")],
        "parent_id STRING, child_id STRING")
    roots = spark.createDataFrame([("a",), ("x",), ("lone",)], "root STRING")
    found = values(closure.owned_closure(edges, roots), "root", "node", "depth")
    assert found == [("a", "a", 0), ("a", "b", 1), ("a", "c", 1), ("a", "d", 2),
                     ("lone", "lone", 0), ("x", "x", 0), ("x", "y", 1)]
    assert values(closure.owned_closure(edges, roots, max_depth=2), "root", "node", "depth") == found
    with pytest.raises(ValueError, match="deeper"):
        closure.owned_closure(edges, roots, max_depth=1)


def test_closure_follows_long_chains(spark):
    chain = spark.createDataFrame([(str(i), str(i + 1)) for i in range(40)], "parent_id STRING, child_id STRING")
    found = closure.owned_closure(chain, spark.createDataFrame([("0",)], "root STRING"))
    assert values(found, "node", "depth") == sorted((str(i), i) for i in range(41))


def plain_closure(edges, roots):
    """Breadth first search from every root."""
    below = {}
    for up, node in edges:
        below.setdefault(up, set()).add(node)
    out = []
    for root in set(roots) - {None}:
        depth, level, seen = 0, {root}, set()
        while level:
            out += [(root, n, depth) for n in level]
            seen |= level
            level = {c for n in level for c in below.get(n, ()) if c is not None} - seen
            depth += 1
    return sorted(out, key=str)


@pytest.mark.parametrize("kind", ["forest", "nested", "circles", "several owners", "nothing"])
def test_closure_equals_search(spark, kind):
    rng = random.Random(kind)
    edges = [(str(rng.randrange(max(i // 2, 1))), str(i)) for i in range(1, 120)] * 2 + [(None, "3"), ("4", None), ("5", "5")]
    roots = ["0", "0", None, "unknown"]
    if kind == "nested":
        roots += ["1", "2", "5", "11", "40", "119"]
    if kind == "circles":
        edges += [("c1", "c2"), ("c2", "c3"), ("c3", "c1"), ("c2", "c4"), ("d1", "d2"), ("d2", "d1"), ("d2", "d3"), ("d3", "d4")]
        roots += ["c1", "c3"]
    if kind == "several owners":
        edges += [(str(rng.randrange(120)), str(rng.randrange(120))) for _ in range(60)]
        roots += ["7", "9"]
    if kind == "nothing":
        edges = []
    found = closure.owned_closure(
        spark.createDataFrame(edges, "parent_id STRING, child_id STRING"), spark.createDataFrame([(r,) for r in roots], "root STRING"))
    assert values(found, "root", "node", "depth") == plain_closure(edges, roots)


def test_closure_of_a_long_chain_takes_few_rounds(spark, monkeypatch):
    rounds = []
    written = closure.written
    monkeypatch.setattr(closure, "written", lambda df, label: rounds.append(label) or written(df, label))
    chain = spark.createDataFrame([(i, i + 1) for i in range(1000)], "parent_id INT, child_id INT")
    found = closure.owned_closure(chain, spark.createDataFrame([(0,)], "root INT"))
    assert values(found, "node", "depth") == sorted(((i, i) for i in range(1001)), key=str)
    assert rounds.count("pointers") <= 12


def test_rules_match_label_subsets(spark):
    events = spark.createDataFrame(
        [(1, "pod", "phase", "Running", {"c": "job", "x": "1"}), (2, "pod", "phase", "Failed", {"c": "job"}),
         (3, "pod", "spec", None, None), (4, "svc", "phase", "Running", {})],
        "id INT, kind STRING, field STRING, new STRING, labels MAP<STRING, STRING>")
    rules = {"any": Rule("pod"), "run": Rule("pod", "phase", "Running", {"c": "job"}),
             "both": Rule("pod", None, None, {"c": "job", "x": "1"})}
    expected = [(1, "any"), (1, "both"), (1, "run"), (2, "any"), (3, "any")]
    assert values(matching.match_rules(events, rule_rows(spark, rules)), "id", "rule") == expected
    handlers = Handlers()
    for name, rule in rules.items():
        handlers.register_handler(rule, lambda df: df.select("id"), name)
    assert values(handlers.run_handlers(events), "id", "handler") == expected


def plain_matches(events, rules):
    out = []
    for number, kind, field, new, labels in events:
        for name, rule_kind, rule_field, rule_new, rule_labels in rules:
            good = kind is not None and kind == rule_kind and rule_field in (None, field) and rule_new in (None, new)
            if good and all((labels or {}).get(k) == v for k, v in (rule_labels or {}).items()):
                out.append((number, name))
    return sorted(out, key=repr)


@pytest.mark.parametrize("pass_shapes, few_kinds", [(64, 100), (3, 1)])
def test_rules_equal_pairwise_matching(spark, monkeypatch, pass_shapes, few_kinds):
    monkeypatch.setattr(matching, "PASS_SHAPES", pass_shapes)
    monkeypatch.setattr(matching, "_FEW_KINDS", few_kinds)
    rng = random.Random(8)

    def some(*values):
        return rng.choice(values)

    def labels():
        return some(None, {}, {k: some("1", "2", "-", "", None) for k in "abc" if rng.random() < 0.5})

    events = [(i, some("pod", "svc", None), some("phase", "spec", None), some("Running", "Failed", None), labels()) for i in range(200)]
    rules = [(f"r{i}", some("pod", "svc", "none", None), some("phase", None), some("Running", "Failed", None), labels()) for i in range(60)]
    rules.append(rules[0])
    types = "kind STRING, {0}field STRING, {0}new STRING, {0}labels MAP<STRING, STRING>"
    found = matching.match_rules(
        spark.createDataFrame(events, "id INT, " + types.format("")),
        spark.createDataFrame(rules, "rule STRING, rule_" + types.format("rule_")),
    )
    assert found.columns == ["id", "kind", "field", "new", "labels", "rule"]
    assert values(found, "id", "rule") == plain_matches(events, rules) and found.count() > 500
    assert "map_filter" not in found._jdf.queryExecution().toString()


def test_no_rules_match_nothing(spark):
    events = spark.createDataFrame([(1, "pod", None, None, None)], "id INT, kind STRING, field STRING, new STRING, labels MAP<STRING, STRING>")
    found = matching.match_rules(events, rule_rows(spark, {"r": Rule("pod")}).limit(0))
    assert found.columns == [*events.columns, "rule"] and found.count() == 0


def test_handlers_share_one_pass_over_the_events(spark):
    counted = spark.sparkContext.accumulator(0)

    def seen(batches):
        for batch in batches:
            counted.add(len(batch))
            yield batch

    schema = "id INT, kind STRING, field STRING, new STRING, labels MAP<STRING, STRING>"
    rows = [(i, ("pod", "svc", "node")[i % 3], "phase", "Running", None) for i in range(90)]
    events = spark.createDataFrame(rows, schema).mapInPandas(seen, schema)
    handlers = Handlers()
    for kind in ("pod", "svc", "none"):
        handlers.register_handler(Rule(kind), lambda df: df.select("id"), kind)
    handlers.register_handler(Rule("pod", "phase"), lambda df: df.groupBy("kind").count(), "counts")
    found = handlers.run_handlers(events)
    assert found.where("handler = 'pod'").count() == 30 and found.where("handler = 'none'").count() == 0
    assert found.where("handler = 'counts'").first()["count"] == 30
    assert counted.value == 90


def test_broken_plugins_are_skipped(monkeypatch):
    class Point:
        def __init__(self, name, fails):
            self.name, self.fails = name, fails

        def load(self):
            if self.fails:
                raise ImportError(self.name)
            return lambda registry: registry.register_handler(Rule("pod"), lambda df: df, self.name)

    monkeypatch.setattr("musterroll.operators.handlers.entry_points",
                        lambda group: [Point("bad", True), Point("good", False)])
    assert Handlers().load_plugins() == ["good"]


def test_ready_within_bounds(spark):
    def at(s):
        return T0.replace(second=s)

    created = spark.createDataFrame([(1, 1, at(0)), (1, 2, at(20)), (2, 3, at(0)), (1, 4, at(40))],
                                    "k INT, n INT, t TIMESTAMP_NTZ")
    ready = spark.createDataFrame([(1, 5, at(10)), (1, 6, at(20)), (1, 7, at(21)), (2, 8, at(11))],
                                  "k INT, n INT, t TIMESTAMP_NTZ")
    found = relate.ready_within(created, ready, ["k"], "t", "n", 10)
    assert values(found, "n", "ready_ts", "outcome") == [
        (1, None, "timed_out"), (2, at(20), "ready"), (3, None, "timed_out"), (4, None, "timed_out")]


def test_drift_compares_maps_and_null_keys(spark):
    kind = "k INT, labels MAP<STRING, STRING>, spec STRUCT<env: ARRAY<MAP<STRING, INT>>>"
    expected = spark.createDataFrame(
        [(1, {"a": "1", "b": "2"}, ([{"x": 1, "y": 2}],)), (2, {"a": "1"}, None), (None, None, None)], kind)
    actual = spark.createDataFrame(
        [(1, {"b": "2", "a": "1"}, ([{"y": 2, "x": 1}],)), (2, {"a": "2"}, None), (None, None, None)], kind)
    found = {r.k: r.drift for r in sets.drift(expected, actual, ["k"], ["labels", "spec"]).collect()}
    assert found == {1: "same", 2: "changed", None: "same"}
    created = snapshot.create_missing(expected.where("k = 1"), actual.where("k IS NOT NULL"), ["k"])
    assert {r.k: r.labels for r in created.collect()} == {1: {"a": "1", "b": "2"}, 2: {"a": "2"}}


def test_unknown_fields_of_manifests_are_kept(spark):
    lines = spark.createDataFrame([('{"k": 1, "other": {"a": [2]}}',), ('{"k": 2}',), ("{",)], "j STRING")
    found = {r.j: r for r in snapshot.read_manifests(lines, "j", T.StructType.fromDDL("k INT")).collect()}
    assert found['{"k": 1, "other": {"a": [2]}}'].extra == {"other": '{"a":[2]}'}
    assert found['{"k": 2}'].extra is None and found["{"].extra is None and found["{"].bad == "{"


def test_drift_and_missing(spark):
    expected = spark.createDataFrame([(1, "a"), (2, None), (3, "c"), (4, None)], "k INT, v STRING")
    actual = spark.createDataFrame([(1, "a"), (2, "b"), (4, None), (5, "e")], "k INT, v STRING")
    assert values(sets.drift(expected, actual, ["k"], ["v"]), "k", "drift") == [
        (1, "same"), (2, "changed"), (3, "missing"), (4, "same"), (5, "extra")]
    have = spark.createDataFrame([(1, "s"), (1, "s"), (1, "g")], "k INT, c STRING")
    missing = sets.missing_components(actual.where("k < 3"), have, ["k"], "c", ["s", "g", "d"])
    assert values(missing, "k", "c") == [(1, "d"), (2, "d"), (2, "g"), (2, "s")]


def test_upsert_and_create_missing(spark):
    target = spark.createDataFrame([(1, "a", 5), (2, "b", None)], "k INT, v STRING, n INT")
    changes = spark.createDataFrame([(2, None, 7), (3, "c", None)], "k INT, v STRING, n INT")
    merged = snapshot.upsert_current(target, changes, ["k"])
    assert values(merged, "k", "v", "n") == [(1, "a", 5), (2, "b", 7), (3, "c", None)]
    once = snapshot.create_missing(target, changes.unionByName(changes), ["k"])
    assert values(once, "k", "v") == [(1, "a"), (2, "b"), (3, "c")]
    assert values(snapshot.create_missing(once, changes, ["k"]), "k") == [1, 2, 3]


def test_replay_patches_null_is_not_mentioned(spark):
    df = spark.createDataFrame([(1, 1, "a", None), (1, 2, None, 3), (1, 3, "c", None), (2, 1, None, None)],
                               "k INT, n INT, f STRING, g INT")
    assert values(rollup.replay_patches(df, ["k"], ["n"], ["f", "g"]), "k", "f", "g") == [
        (1, "c", 3), (2, None, None)]


def test_job_run_fields(spark):
    df = spark.createDataFrame(
        [("j", T0, 1, "Created"), ("j", T0.replace(second=5), 2, "Running"),
         ("j", T0.replace(second=65 - 60, minute=1), 3, "Succeeded"), ("k", T0, 4, "Running")],
        "job STRING, ts TIMESTAMP_NTZ, n INT, phase STRING")
    found = {r.job: r for r in rollup.job_runs(df, "job", "ts", "phase", ["ts", "n"]).collect()}
    assert found["j"].asDict() == {
        "job": "j", "clusterName": "j", "jobRunnerPodName": "j-runner", "jobStatus": "Successful",
        "startTime": "2024-01-01T00:00:05Z", "endTime": "2024-01-01T00:01:05Z", "duration_s": 60}
    assert (found["k"].jobStatus, found["k"].endTime) == ("Running", None)


def test_seeing_a_phase_again_moves_no_start(spark):
    rows = [("j", 0, "Running"), ("j", 100, "Running"), ("j", 150, "Succeeded"), ("j", 170, "Succeeded")]
    df = spark.createDataFrame(
        [(j, T0 + timedelta(seconds=s), s, p) for j, s, p in rows], "job STRING, ts TIMESTAMP_NTZ, n INT, phase STRING")
    for hot_rows in (None, 2):
        found = rollup.job_runs(df, "job", "ts", "phase", ["ts", "n"], hot_rows=hot_rows).first()
        assert (found.duration_s, found.startTime) == (150, "2024-01-01T00:00:00Z")


def test_logs(spark):
    pods = spark.createDataFrame(
        [(1, "x-scheduler", "Running"), (2, "g-worker-1", "Pending"), (3, "j-runner", "Running"),
         (4, "g-worker-2", "Running")], "pod INT, name STRING, phase STRING")
    lines = spark.createDataFrame(
        [(1, i, f"line {i}") for i in range(25)] + [(2, 0, "early"), (3, 0, "job")],
        "pod INT, line_no INT, line STRING")
    found = logs.collect_logs(lines, pods, "pod", "line_no", "line", block_lines=4)
    assert values(found, "name", "log") == [
        ("g-worker-1", "Cannot find logs. Pod is Pending."), ("g-worker-2", ""),
        ("x-scheduler", "\n".join(f"line {i}" for i in range(25)))]


def test_written_specs_read_back(spark, tmp_path):
    params = spark.createDataFrame(
        [("c1", "img", 3, {"limits": {"cpu": "1"}}, {"A": "1"}, "work --fast", "NodePort", 300, True),
         ("c2", "img", None, None, None, "work", "ClusterIP", 0, False)],
        "name STRING, image STRING, n_workers INT, resources MAP<STRING, MAP<STRING, STRING>>,"
        " env MAP<STRING, STRING>, worker_command STRING, scheduler_service_type STRING,"
        " idle_timeout INT, jupyter BOOLEAN")
    path = str(tmp_path / "specs")
    specs.write_specs(params, WORDS, path)
    text = {json.loads(r.value)["metadata"]["name"]: json.loads(r.value)
            for r in spark.read.text(path).collect()}
    worker = text["c1"]["spec"]["worker"]["spec"]["containers"][0]
    assert worker["args"] == ["work", "--fast", "--name", "$(WORKER_NAME)", "--dashboard",
                              "--dashboard-address", "8788"]
    assert worker["env"] == [{"name": "A", "value": "1"}]
    parsed = snapshot.read_manifests(
        spark.read.text(path), "value", schema_of("cluster")).where("bad IS NULL")
    flat = manifests.flatten_manifest(parsed, "manifest")
    assert values(flat, "manifest.metadata.name", "image", "n_workers", "jupyter", F.size("env")) == [
        ("c1", "img", 3, True, 1), ("c2", "img", None, False, 0)]


def test_specs_take_ready_lists(spark):
    params = spark.createDataFrame(
        [("c", "img", 1, None, [("A", "1")], ["run", "a b"], "ClusterIP", 0, False)],
        "name STRING, image STRING, n_workers INT, resources MAP<STRING, MAP<STRING, STRING>>,"
        " env ARRAY<STRUCT<name: STRING, value: STRING>>, worker_command ARRAY<STRING>,"
        " scheduler_service_type STRING, idle_timeout INT, jupyter BOOLEAN")
    line = json.loads(specs.spec_lines(params, WORDS).first()["line"])
    worker = line["spec"]["worker"]["spec"]["containers"][0]
    assert worker["args"][:3] == ["run", "a b", "--name"]
    assert worker["env"] == [{"name": "A", "value": "1"}]


def test_worker_labels(spark):
    row = ("c", "g", {"a": "group", "b": "group", "fleet.example/component": "user"}, {"b": "part"},
           {"a": "cluster", "z": "cluster"})
    df = spark.createDataFrame([row], "c STRING, g STRING, own MAP<STRING, STRING>,"
                               " part MAP<STRING, STRING>, top MAP<STRING, STRING>")
    found = df.select(expand.worker_labels(
        WORDS, F.col("c"), F.col("g"), F.col("own"), F.col("part"), F.col("top"))).first()[0]
    assert found == {
        "a": "group", "b": "part", "z": "cluster", "fleet.example/cluster-name": "c",
        "fleet.example/workergroup-name": "g", "fleet.example/component": "worker",
        "sidecar.istio.io/inject": "false"}


def test_snapshot_prunes_namespaces(spark, tmp_path):
    path = str(tmp_path / "objects")
    spark.createDataFrame([("a", 1), ("b", 2), ("a", 3)], "ns STRING, id INT").write.partitionBy("ns").parquet(path)
    found = snapshot.read_snapshot(spark, path, "cluster", ["a"], "ns", "id INT, ns STRING")
    assert "PartitionFilters: [isnotnull(ns" in found._jdf.queryExecution().toString()
    assert values(found, "id") == [1, 3]
    assert len(values(snapshot.read_snapshot(spark, path, "cluster", None, "ns", "id INT, ns STRING"), "id")) == 3


def test_kinds_have_schemas(spark):
    for kind in ("cluster", "workergroup", "job", "autoscaler"):
        assert {"metadata", "spec", "status"} == set(schema_of(kind).fieldNames())
