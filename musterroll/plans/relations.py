"""Queries over joins and set comparisons."""

from __future__ import annotations

from pyspark.sql import functions as F

from musterroll.operators import closure, matching, relate, sets
from musterroll.operators.handlers import Rule, rule_rows
from musterroll.plans import roles
from musterroll.plans.registry import query
from musterroll.streaming import ticks


@query("j1_owner_of", roles=("clusters", "worker_groups"), sql="""
    SELECT group_id, cluster_id, name AS owner FROM worker_groups
    JOIN clusters USING (cluster_id) WHERE balance >= 0""")
def owner_of(spark, sf):
    owners = roles.live_clusters(spark, sf).select("cluster_id", F.col("name").alias("owner"))
    groups = roles.worker_groups(spark, sf).select("group_id", "cluster_id")
    return relate.owner_of(groups, owners, ["cluster_id"])


@query("j2_orphans", roles=("clusters", "worker_groups"), sql="""
    SELECT group_id, cluster_id FROM worker_groups
    WHERE cluster_id NOT IN (SELECT cluster_id FROM clusters WHERE balance >= 0)""")
def orphans(spark, sf):
    groups = roles.worker_groups(spark, sf).select("group_id", "cluster_id")
    return relate.orphans(groups, roles.live_clusters(spark, sf), ["cluster_id"])


@query("j3_members_of", roles=("clusters", "worker_groups", "workers"), sql="""
    SELECT cluster_id, group_id, part, supplier, line FROM clusters
    JOIN worker_groups g USING (cluster_id) JOIN workers w USING (group_id)""")
def members_of(spark, sf):
    def labelled(df, **entries):
        flat = [p for k, v in entries.items() for p in (F.lit(k), F.col(v).cast("string"))]
        return df.withColumn("labels", F.create_map(*flat))

    parents = roles.clusters(spark, sf).select("cluster_id")
    groups = labelled(
        roles.worker_groups(spark, sf), **{"cluster-name": "cluster_id"}
    ).select("group_id", "labels")
    members = labelled(roles.workers(spark, sf), **{"workergroup-name": "group_id"}).select(
        "part", "supplier", "line", "labels"
    )
    own = relate.members_of(parents, groups, {"cluster-name": "cluster_id"}).drop("labels")
    return relate.members_of(own, members, {"workergroup-name": "group_id"}).drop("labels")


@query("j4_exactly_one", roles=("worker_groups", "workers"), sql="""
    SELECT group_id, count(w.group_id) AS found,
           CASE WHEN count(w.group_id) = 0 THEN 'not found' ELSE 'several' END AS problem
    FROM worker_groups LEFT JOIN workers w USING (group_id)
    GROUP BY group_id HAVING count(w.group_id) <> 1""")
def exactly_one(spark, sf):
    return relate.exactly_one(
        roles.worker_groups(spark, sf), roles.workers(spark, sf), ["group_id"]
    )


@query("j5_propagate_status", roles=("clusters", "services"), sql="""
    SELECT cluster_id, coalesce(arg_max(s.phase, (s.created, s.group_id)), 'Created') AS phase
    FROM clusters LEFT JOIN services s USING (cluster_id) GROUP BY cluster_id""")
def propagate_status(spark, sf):
    owners = roles.clusters(spark, sf).select("cluster_id", F.lit("Created").alias("phase"))
    return relate.propagate_status(
        roles.services(spark, sf), owners, ["cluster_id"], ["created", "group_id"]
    )


def fleet_plan(spark, sf):
    """Every worker group with what it needs, the step most other plans start from."""
    groups = roles.worker_groups(spark, sf).select("group_id", "cluster_id", "created", "desired")
    return relate.reconcile(groups, roles.workers(spark, sf), ["group_id"])


@query("j6_reconcile", roles=("worker_groups", "workers", "plan"), sql="""
    SELECT group_id, desired, current, needed,
           CASE WHEN needed > 0 THEN 'up' WHEN needed < 0 THEN 'down' ELSE 'none' END AS action
    FROM plan""")
def reconcile(spark, sf):
    return fleet_plan(spark, sf).drop("cluster_id", "created")


_STATE_AT_SQL = """
    SELECT t.key, t.ts, w.target FROM ticks t
    ASOF LEFT JOIN (SELECT key, ts, arg_max(target, seq) AS target FROM watch
                    GROUP BY key, ts) w
    ON t.key = w.key AND t.ts >= w.ts"""


@query("j7_state_at", roles=("watch", "ticks"), sql=_STATE_AT_SQL)
def state_at(spark, sf):
    changes = roles.watch(spark, sf)
    grid = ticks.tick_samples(changes, ["key"], "ts", roles.HOUR)
    return relate.state_at(grid, changes, ["key"], "ts", "seq", ["target"])


@query("j7_state_on_grid", roles=("watch", "ticks"), sql=_STATE_AT_SQL)
def state_on_grid(spark, sf):
    return ticks.state_on_grid(
        roles.watch(spark, sf), ["key"], "ts", "seq", ["target"], roles.HOUR
    )


@query("j8_owned_closure", roles=("edges",), sql="""
    , reach AS (
      SELECT 'r' || r_regionkey AS root, 'r' || r_regionkey AS node, 0 AS depth FROM region
      UNION SELECT root, child_id, depth + 1 FROM reach JOIN edges ON parent_id = node)
    SELECT root, node, CAST(depth AS INTEGER) AS depth FROM reach""")
def owned_closure(spark, sf):
    roots = roles.table(spark, sf, "region").select(
        F.concat(F.lit("r"), "r_regionkey").alias("root")
    )
    return closure.owned_closure(roles.edges(spark, sf), roots)


@query("j9_connect_plan", roles=("clusters", "worker_groups"), sql="""
    , requested AS (
      SELECT cluster_id, CASE cluster_id % 3 WHEN 0 THEN 'CREATE_ONLY'
                WHEN 1 THEN 'CREATE_OR_CONNECT' ELSE 'CONNECT_ONLY' END AS mode,
             cluster_id IN (SELECT cluster_id FROM worker_groups
                            WHERE phase = 'Running' AND created >= '2001-01-01') AS present
      FROM clusters), planned AS (
      SELECT cluster_id, mode,
             CASE WHEN present AND mode = 'CREATE_ONLY' THEN 'error_exists'
                  WHEN present THEN 'connect'
                  WHEN mode = 'CONNECT_ONLY' THEN 'error_missing' ELSE 'create' END AS plan
      FROM requested)
    SELECT cluster_id, mode, plan,
           CASE WHEN cluster_id % 10 = 0 THEN FALSE WHEN plan = 'create' THEN TRUE
                WHEN plan = 'connect' THEN FALSE END AS shutdown_on_close
    FROM planned""")
def connect_plan(spark, sf):
    key = F.col("cluster_id")
    requests = roles.clusters(spark, sf).select(
        key,
        F.when(key % 3 == 0, "CREATE_ONLY").when(key % 3 == 1, "CREATE_OR_CONNECT")
        .otherwise("CONNECT_ONLY").alias("mode"),
        F.when(key % 10 == 0, F.lit(False)).alias("shutdown_on_close"),
    )
    existing = roles.worker_groups(spark, sf).where(
        (F.col("phase") == "Running") & (F.col("created") >= F.lit("2001-01-01").cast("timestamp_ntz"))
    )
    return relate.connect_plan(requests, existing, ["cluster_id"])


RULES = {
    "cluster_created": Rule("cluster", "phase", "Created"),
    "any_cluster_change": Rule("cluster", "phase"),
    "runner_running": Rule("pod", "phase", "Running", {"component": "job-runner"}),
    "runner_failed": Rule("pod", "phase", "Failed", {"component": "job-runner", "half": "0"}),
    "service_status": Rule("service", None, None, {"component": "scheduler"}),
}


def change_events(spark, sf):
    """Watch rows as field changes of a kind, with labels."""
    seq = F.col("seq")
    return roles.watch(spark, sf).select(
        "seq", "key",
        F.when(seq % 3 == 0, "cluster").when(seq % 3 == 1, "pod").otherwise("service")
        .alias("kind"),
        F.lit("phase").alias("field"),
        F.col("phase").alias("new"),
        F.when(seq % 7 != 0, F.create_map(
            F.lit("component"),
            F.when(F.col("key") % 2 == 0, "job-runner").otherwise("scheduler"),
            F.lit("half"), (seq % 2).cast("string"),
        )).alias("labels"),
    )


@query("j10_match_rules", roles=("watch",), sql="""
    SELECT seq, 'cluster_created' AS rule FROM watch WHERE seq % 3 = 0 AND phase = 'Created'
    UNION ALL SELECT seq, 'any_cluster_change' FROM watch WHERE seq % 3 = 0
    UNION ALL SELECT seq, 'runner_running' FROM watch
    WHERE seq % 3 = 1 AND phase = 'Running' AND seq % 7 <> 0 AND key % 2 = 0
    UNION ALL SELECT seq, 'runner_failed' FROM watch
    WHERE seq % 3 = 1 AND phase = 'Failed' AND seq % 7 <> 0 AND key % 2 = 0 AND seq % 2 = 0
    UNION ALL SELECT seq, 'service_status' FROM watch
    WHERE seq % 3 = 2 AND seq % 7 <> 0 AND key % 2 = 1""")
def match_rules(spark, sf):
    matched = matching.match_rules(change_events(spark, sf), rule_rows(spark, RULES))
    return matched.select("seq", "rule")


def signups_and_clicks(spark, sf):
    changes = roles.watch(spark, sf).select("key", "seq", "ts", "event_type")
    created = changes.where(F.col("event_type") == "signup").drop("event_type")
    ready = changes.where(F.col("event_type") == "click").drop("event_type")
    return created, ready


@query("j11_ready_within", roles=("watch",), sql="""
    SELECT c.key, c.seq, c.ts, min(r.ts) AS ready_ts,
           CASE WHEN min(r.ts) IS NULL THEN 'timed_out' ELSE 'ready' END AS outcome
    FROM (SELECT * FROM watch WHERE event_type = 'signup') c
    LEFT JOIN (SELECT * FROM watch WHERE event_type = 'click') r
    ON r.key = c.key AND r.ts >= c.ts AND r.ts < c.ts + INTERVAL 6 HOUR
    GROUP BY c.key, c.seq, c.ts""")
def ready_within(spark, sf):
    created, ready = signups_and_clicks(spark, sf)
    return relate.ready_within(created, ready, ["key"], "ts", "seq", roles.READY_TIMEOUT)


@query("j12_resolve_endpoint", """
    SELECT s_suppkey, 'tcp://' || CASE s_suppkey % 3
             WHEN 0 THEN CASE WHEN s_suppkey % 2 = 0 THEN 'lb-' || s_suppkey || '.example'
                              ELSE '10.1.0.' || (s_suppkey % 250) END
             WHEN 1 THEN 'node-' || lower(n_name)
             ELSE replace(lower(s_name), '#', '-') || '.' || s_nationkey END
           || ':' || CASE WHEN s_suppkey % 3 = 1 THEN 30000 + s_suppkey % 1000 ELSE 8786 END
           AS endpoint
    FROM supplier JOIN (SELECT n_regionkey, arg_min(n_name, n_nationkey) AS n_name
                        FROM nation GROUP BY n_regionkey) f
    ON f.n_regionkey = s_nationkey % 5""")
def resolve_endpoint(spark, sf):
    key = F.col("s_suppkey")
    port = F.struct(
        F.lit("tcp-comm").alias("name"), F.lit(8786).alias("port"),
        (key % 1000 + 30000).cast("int").alias("nodePort"),
    )
    other = F.struct(
        F.lit("http-dashboard").alias("name"), F.lit(8787).alias("port"),
        F.lit(31000).alias("nodePort"),
    )
    entry = F.struct(
        F.when(key % 2 == 0, F.format_string("lb-%d.example", key)).alias("hostname"),
        F.format_string("10.1.0.%d", key % 250).alias("ip"),
    )
    services = roles.table(spark, sf, "supplier").select(
        "s_suppkey",
        F.replace(F.lower("s_name"), F.lit("#"), F.lit("-")).alias("name"),
        F.col("s_nationkey").cast("string").alias("namespace"),
        (F.col("s_nationkey") % 5).alias("fleet"),
        F.when(key % 3 == 0, "LoadBalancer").when(key % 3 == 1, "NodePort")
        .otherwise("ClusterIP").alias("type"),
        F.when(key % 3 == 0, F.array(entry)).alias("ingress"),
        F.array(port, other).alias("ports"),
    )
    nodes = roles.table(spark, sf, "nation").select(
        F.col("n_regionkey").alias("fleet"), F.col("n_nationkey").alias("node_id"),
        F.concat(F.lit("node-"), F.lower("n_name")).alias("address"),
    )
    found = relate.resolve_endpoint(services, nodes, "fleet", "node_id", "tcp-comm")
    return found.select("s_suppkey", "endpoint")


@query("o1_drift", roles=("worker_groups",), sql="""
    SELECT group_id, CASE WHEN group_id % 10 = 3 THEN 'missing' WHEN group_id % 10 = 5 THEN 'changed'
                          ELSE 'same' END AS drift
    FROM worker_groups
    UNION ALL SELECT -group_id - 1, 'extra' FROM worker_groups WHERE group_id % 10 = 3""")
def drift(spark, sf):
    cols = ["cluster_id", "phase", "desired"]
    expected = roles.worker_groups(spark, sf).select("group_id", *cols)
    key = F.col("group_id")
    actual = expected.withColumns({
        "desired": F.when(key % 10 == 5, F.col("desired") + 1).otherwise(F.col("desired")),
        "phase": F.when(key % 10 != 5, F.col("phase")),
        "group_id": F.when(key % 10 == 3, -key - 1).otherwise(key),
    })
    return sets.drift(expected, actual, ["group_id"], cols)


@query("o2_missing_components", roles=("clusters", "worker_groups"), sql="""
    SELECT cluster_id, component FROM clusters,
      (VALUES ('1-URGENT'), ('2-HIGH'), ('3-MEDIUM'), ('4-NOT SPECIFIED'), ('5-LOW')) e(component)
    EXCEPT SELECT cluster_id, component FROM worker_groups""")
def missing_components(spark, sf):
    return sets.missing_components(
        roles.clusters(spark, sf), roles.worker_groups(spark, sf), ["cluster_id"], "component",
        ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"],
    )
