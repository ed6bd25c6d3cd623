"""Queries over replayed histories and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from musterroll.functions.phases import lookup
from musterroll.operators import rollup
from musterroll.plans import roles
from musterroll.plans.registry import query
from musterroll.plans.rollups import JOB_RUNS_SQL
from musterroll.session import scratch_path
from musterroll.sources.snapshot import close_feed, closing_folder, read_watch
from musterroll.streaming import live, replay, scaling, ticks

AS_OF = "TIMESTAMP_NTZ'2024-02-01 00:00:00'"
END = "TIMESTAMP_NTZ'2025-01-01 00:00:00'"

_AUTOSCALER_SQL = """
    , s AS (SELECT key, seq, ts, target, minimum, maximum,
                   row_number() OVER (PARTITION BY key ORDER BY ts, seq) AS n
            FROM watch JOIN clusters ON cluster_id = key WHERE target IS NOT NULL), run AS (
      SELECT cluster_id AS key, CAST(0 AS BIGINT) AS n, CAST(NULL AS BIGINT) AS seq,
             CAST(NULL AS TIMESTAMP) AS ts, minimum AS old, minimum AS cur,
             CAST(NULL AS TIMESTAMP) AS wake, FALSE AS fired
      FROM clusters WHERE cluster_id IN (SELECT key FROM watch)
      UNION ALL
      SELECT key, n, seq, ts, cur, CASE WHEN fires THEN new ELSE cur END,
             CASE WHEN fires THEN ts + INTERVAL 6 HOUR ELSE wake END, fires
      FROM (SELECT s.key, s.n, s.seq, s.ts, r.cur, r.wake, x.new,
                   (r.wake IS NULL OR s.ts >= r.wake) AND x.new <> r.cur AS fires
            FROM run r JOIN s ON s.key = r.key AND s.n = r.n + 1,
            LATERAL (SELECT CAST(CASE WHEN r.cur > 0 THEN greatest(
                r.cur - greatest(1, CAST(floor(r.cur * 0.25) AS INTEGER)),
                least(s.maximum, greatest(s.minimum, s.target)))
              ELSE least(s.maximum, greatest(s.minimum, s.target)) END AS INTEGER) AS new) x))
    SELECT key, ts, seq, old, cur AS new FROM run WHERE fired"""


@query("t1_replay_autoscaler", roles=("watch", "clusters"), sql=_AUTOSCALER_SQL)
def replay_autoscaler(spark, sf):
    return replay.replay_autoscaler(
        roles.watch(spark, sf), roles.watch_clusters(spark, sf), ["key"], "ts", "seq", "target",
        "minimum", "maximum", "minimum", roles.COOLDOWN,
    )


_IDLE_SQL = """
    , a AS (SELECT key, ts, idle_timeout_s,
                   lead(ts) OVER (PARTITION BY key ORDER BY ts, seq) AS nxt
            FROM watch JOIN clusters ON cluster_id = key WHERE idle_timeout_s > 0), g AS (
      SELECT key, ts AS idle_since, nxt, make_timestamp(
        (epoch_us(ts + to_seconds(idle_timeout_s)) // 5000000 + 1) * 5000000) AS shutdown_at
      FROM a)
    SELECT key, min(idle_since) AS idle_since, arg_min(shutdown_at, idle_since) AS shutdown_at
    FROM g WHERE CASE WHEN nxt IS NULL THEN shutdown_at <= TIMESTAMP '2024-02-01'
                      ELSE shutdown_at < nxt END
    GROUP BY key"""


@query("t2_idle_shutdowns", roles=("watch", "clusters"), sql=_IDLE_SQL)
def idle_shutdowns(spark, sf):
    return ticks.idle_shutdowns(
        roles.watch(spark, sf), roles.watch_clusters(spark, sf), ["key"], "ts", "seq",
        "idle_timeout_s", F.expr(AS_OF),
    )


_THROTTLE_SQL = """
    , s AS (SELECT key, seq, ts, row_number() OVER (PARTITION BY key ORDER BY ts, seq) AS n
            FROM watch), run AS (
      SELECT key, n, seq, ts, ts AS last, TRUE AS kept FROM s WHERE n = 1
      UNION ALL
      SELECT s.key, s.n, s.seq, s.ts,
             CASE WHEN s.ts >= r.last + INTERVAL 6 HOUR THEN s.ts ELSE r.last END,
             s.ts >= r.last + INTERVAL 6 HOUR
      FROM run r JOIN s ON s.key = r.key AND s.n = r.n + 1)
    SELECT key, ts, seq FROM run WHERE kept"""


@query("t3_throttle", roles=("watch",), sql=_THROTTLE_SQL)
def throttle(spark, sf):
    return replay.throttle(roles.watch(spark, sf), ["key"], "ts", "seq", roles.COOLDOWN)


@query("t7_preferred_source", roles=("watch",), sql="""
    , ranked AS (SELECT *, CASE event_type WHEN 'purchase' THEN 1 WHEN 'click' THEN 2 ELSE 3 END
                 AS priority FROM watch
                 WHERE event_type IN ('purchase', 'click', 'error') AND target < 8)
    SELECT key, target, event_type FROM ranked
    QUALIFY row_number() OVER (PARTITION BY key ORDER BY priority, ts DESC, seq DESC) = 1""")
def preferred_source(spark, sf):
    priority = {"purchase": 1, "click": 2, "error": 3}
    seen = roles.watch(spark, sf).where(F.col("event_type").isin(*priority))
    seen = seen.withColumn("target", F.when(F.col("target") < 8, F.col("target")))
    return rollup.preferred_source(
        seen, ["key"], "event_type", "target", lookup(F.col("event_type"), priority),
        ["ts", "seq"],
    )


@query("t8_tick_samples", roles=("watch", "ticks"), sql="SELECT key, ts FROM ticks")
def tick_samples(spark, sf):
    return ticks.tick_samples(roles.watch(spark, sf), ["key"], "ts", roles.HOUR)


_PLAN_SQL = """
    , said AS (SELECT key, ts, seq, CASE event_type WHEN 'signup' THEN TRUE WHEN 'error' THEN FALSE END AS ready,
                      CASE event_type WHEN 'view' THEN target WHEN 'purchase' THEN -1 END AS http,
                      CASE event_type WHEN 'click' THEN target END AS rpc, FALSE AS tick FROM watch
               UNION ALL SELECT key, ts, 9223372036854775807, NULL, NULL, NULL, TRUE
               FROM ticks WHERE epoch(ts) % 21600 = 0)
    , seen AS (SELECT key, ts, tick, last_value(ready IGNORE NULLS) OVER w AS ready,
                      last_value(http IGNORE NULLS) OVER w AS http, last_value(rpc IGNORE NULLS) OVER w AS rpc
               FROM said WINDOW w AS (PARTITION BY key ORDER BY ts, seq ROWS UNBOUNDED PRECEDING))
    , s AS (SELECT key, 0 AS seq, ts, coalesce(nullif(http, -1), rpc) AS target, minimum, maximum,
                   row_number() OVER (PARTITION BY key ORDER BY ts) AS n
            FROM seen JOIN clusters ON cluster_id = key
            WHERE tick AND ready AND coalesce(nullif(http, -1), rpc) IS NOT NULL), """ + _AUTOSCALER_SQL[
    _AUTOSCALER_SQL.index("run AS ("):_AUTOSCALER_SQL.rindex("SELECT key")] + """
    , moved AS (SELECT key, count(*) AS moves, arg_max(cur, ts) AS desired FROM run WHERE fired GROUP BY key)
    , wanted AS (SELECT cluster_id AS key, coalesce(desired, minimum) AS desired, coalesce(moves, 0) AS moves
                 FROM clusters LEFT JOIN moved ON key = cluster_id)
    , had AS (SELECT cluster_id AS key, count(*) AS n FROM worker_groups GROUP BY cluster_id)
    SELECT key, desired, moves, coalesce(n, 0) AS current, desired - coalesce(n, 0) AS needed,
           CASE WHEN desired > coalesce(n, 0) THEN 'up' WHEN desired < coalesce(n, 0) THEN 'down' ELSE 'none' END AS action
    FROM wanted LEFT JOIN had USING (key)"""


@query("t9_scaling_plan", roles=("watch", "clusters", "worker_groups", "ticks"), sql=_PLAN_SQL)
def scaling_plan(spark, sf):
    """Events as readiness and as answers of two sources; groups as the members of a cluster."""
    kind = F.col("event_type")
    changes = roles.watch(spark, sf).select(
        "key", "ts", "seq",
        F.when(kind == "signup", F.lit(True)).when(kind == "error", F.lit(False)).alias("ready"),
        F.when(kind == "view", F.col("target")).when(kind == "purchase", F.lit(scaling.UNREACHABLE)).alias("http"),
        F.when(kind == "click", F.col("target")).alias("rpc"),
    )
    members = roles.worker_groups(spark, sf).select(F.col("cluster_id").alias("key"))
    return scaling.scaling_plan(
        changes, roles.watch_clusters(spark, sf), members, ["key"], "ts", "seq", "ready", ["http", "rpc"],
        6 * roles.HOUR, roles.COOLDOWN,
    )


# --- streams over the event files ----------------------------------------------------


def live_watch(spark, sf, closing=None):
    """The event file as a stream with the watch columns."""
    schema = roles.table(spark, sf, "events").schema
    return roles.watch_columns(read_watch(spark, sf, schema, files="events.parquet", closing=closing))


def backfilled(spark, sf, label, of_watch, at=END):
    """What a stream over the event file gives once its time has come to ``at``."""
    schema = roles.table(spark, sf, "events").schema
    closing = closing_folder(spark, schema)
    stream = of_watch(live_watch(spark, sf, closing))
    return live.run_available(
        stream, label, close=lambda: close_feed(spark, closing, schema, "ts", F.expr(at))
    )


@query("s2_read_watch", roles=("watch",), sql="""
    SELECT key, seq, ts, event_type, phase, target, patch FROM watch""")
def read_watch_query(spark, sf):
    seen = live.run_available(live_watch(spark, sf), "watch")
    return seen.withColumn("ts", F.col("ts").cast("timestamp_ntz"))


@query("t4_coalesce_updates", roles=("watch", "clusters"), sql="""
    , u AS (SELECT key, seq, ts, CASE WHEN event_type <> 'error' THEN target END AS target
            FROM watch
            UNION ALL SELECT cluster_id, -1, TIMESTAMP '2020-01-01', minimum FROM clusters
            UNION ALL SELECT -cluster_id - 1, -1, TIMESTAMP '2020-01-01', minimum FROM clusters)
    SELECT key, list(seq ORDER BY ts DESC, seq DESC)[1] AS seq, max(ts) AS ts,
           (list(target ORDER BY ts DESC, seq DESC) FILTER (target IS NOT NULL))[1] AS target
    FROM u GROUP BY key""")
def coalesce_updates(spark, sf):
    named = F.when(F.col("event_type") != "error", F.col("target"))
    updates = live_watch(spark, sf).select("key", "seq", "ts", named.alias("target"))
    start = roles.watch_clusters(spark, sf).select(
        "key", F.lit(-1).cast("long").alias("seq"),
        F.expr("TIMESTAMP_NTZ'2020-01-01'").cast("timestamp").alias("ts"),
        F.col("minimum").alias("target"),
    )
    start = start.unionByName(start.withColumn("key", -F.col("key") - 1))
    path = scratch_path(spark, "replicas")
    table = live.coalesce_updates(updates, start, ["key"], ["ts", "seq"], path)
    return table.withColumn("ts", F.col("ts").cast("timestamp_ntz"))


@query("t5_job_runs_stream", roles=("watch",), sql=JOB_RUNS_SQL)
def job_runs_stream(spark, sf):
    written = backfilled(spark, sf, "jobs", lambda watch: live.job_runs_stream(
        watch, "key", "ts", "seq", "phase"))
    return live.job_runs_table(written, "key")


@query("t6_ready_within_stream", roles=("watch",), sql="""
    , e AS (SELECT * FROM watch WHERE event_type IN ('signup', 'click'))
    SELECT c.key, c.seq, c.ts, min(r.ts) AS ready_ts,
           CASE WHEN min(r.ts) IS NULL THEN 'timed_out' ELSE 'ready' END AS outcome
    FROM (SELECT * FROM e WHERE event_type = 'signup') c
    LEFT JOIN (SELECT * FROM e WHERE event_type = 'click') r
    ON r.key = c.key AND r.ts >= c.ts AND r.ts < c.ts + INTERVAL 6 HOUR
    GROUP BY c.key, c.seq, c.ts""")
def ready_within_stream(spark, sf):
    return backfilled(spark, sf, "ready", lambda watch: live.ready_within_stream(
        watch.select("key", "seq", "ts", "event_type"), "key", "ts", "seq",
        F.col("event_type") == "signup", F.col("event_type") == "click", roles.READY_TIMEOUT,
    ))


@query("t1_replay_autoscaler_stream", roles=("watch", "clusters"), sql=_AUTOSCALER_SQL)
def replay_autoscaler_stream(spark, sf):
    return backfilled(spark, sf, "autoscaler", lambda watch: live.replay_autoscaler_stream(
        watch, roles.watch_clusters(spark, sf), "key", "ts", "seq", "target", "minimum",
        "maximum", "minimum", roles.COOLDOWN,
    ))


@query("t2_idle_shutdowns_stream", roles=("watch", "clusters"), sql=_IDLE_SQL)
def idle_shutdowns_stream(spark, sf):
    return backfilled(spark, sf, "idle", lambda watch: live.idle_shutdowns_stream(
        watch, roles.watch_clusters(spark, sf), "key", "ts", "seq", "idle_timeout_s",
    ), at=f"{AS_OF} + INTERVAL '1' SECOND")


@query("t3_throttle_stream", roles=("watch",), sql=_THROTTLE_SQL)
def throttle_stream(spark, sf):
    return backfilled(spark, sf, "throttle", lambda watch: live.throttle_stream(
        watch, "key", "ts", "seq", roles.COOLDOWN))
