"""Queries over sources, selectors, list views and checks."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from musterroll.functions import labels, names, phases
from musterroll.operators import rollup, select
from musterroll.plans import roles
from musterroll.plans.registry import query
from musterroll.sources import logs, snapshot, specs

AS_OF = "TIMESTAMP_NTZ'2002-01-01 00:00:00'"
_CUSTOMER = (
    "c_custkey LONG, c_name STRING, c_nationkey INT, c_acctbal DOUBLE, c_mktsegment STRING"
)


@query("s1_read_snapshot", """
    SELECT c_custkey, c_name, c_nationkey FROM customer WHERE c_nationkey IN (1, 5, 9)""")
def read_snapshot(spark, sf):
    path = f"{sf}/customer.parquet"
    found = snapshot.read_snapshot(
        spark, path, "cluster", [1, 5, 9], "c_nationkey", _CUSTOMER
    )
    return found.select("c_custkey", "c_name", "c_nationkey")


@query("s3_read_manifests", roles=("watch",), sql="""
    SELECT seq, CASE WHEN seq % 10 = 0 THEN NULL
                     ELSE CAST(json_extract(patch, '$.k') AS INTEGER) END AS k,
           CASE WHEN seq % 10 = 0 THEN substr(patch, 1, 4) END AS bad
    FROM watch""")
def read_manifests(spark, sf):
    cut = F.when(F.col("seq") % 10 == 0, F.substring("patch", 1, 4)).otherwise(F.col("patch"))
    documents = roles.watch(spark, sf).select("seq", cut.alias("body"))
    parsed = snapshot.read_manifests(documents, "body", T.StructType.fromDDL("k INT"))
    return parsed.select("seq", "manifest.k", "bad")


@query("s4_upsert_current", roles=("worker_groups", "watch"), sql="""
    , changes AS (
      SELECT key * 200 AS group_id,
             arg_max(phase, seq) FILTER (WHERE event_type <> 'view') AS phase,
             CAST(arg_max(target, seq) FILTER (WHERE seq % 3 = 0) AS INTEGER) AS desired
      FROM watch GROUP BY key)
    SELECT group_id, g.cluster_id, coalesce(c.phase, g.phase) AS phase,
           coalesce(c.desired, g.desired) AS desired
    FROM worker_groups g FULL OUTER JOIN changes c USING (group_id)""")
def upsert_current(spark, sf):
    patches = roles.watch(spark, sf).select(
        (F.col("key") * 200).alias("group_id"), "seq",
        F.when(F.col("event_type") != "view", F.col("phase")).alias("phase"),
        F.when(F.col("seq") % 3 == 0, F.col("target")).alias("desired"),
    )
    changes = rollup.replay_patches(patches, ["group_id"], ["seq"], ["phase", "desired"])
    target = roles.worker_groups(spark, sf).select("group_id", "cluster_id", "phase", "desired")
    return snapshot.upsert_current(target, changes, ["group_id"])


@query("s5_create_missing", roles=("worker_groups", "workers"), sql="""
    SELECT group_id, count(w.group_id) AS members
    FROM (SELECT group_id FROM worker_groups UNION SELECT group_id FROM workers) g
    LEFT JOIN workers w USING (group_id) GROUP BY group_id""")
def create_missing(spark, sf):
    existing = rollup.count_members(roles.workers(spark, sf), ["group_id"])
    desired = roles.worker_groups(spark, sf).select(
        "group_id", F.lit(0).cast("long").alias("members")
    )
    return snapshot.create_missing(existing, desired, ["group_id"])


@query("s6_collect_logs", """
    SELECT p.name, CASE WHEN phase = 'Running' THEN log
                        ELSE 'Cannot find logs. Pod is ' || phase || '.' END AS log
    FROM (SELECT conv_id, 'pod-' || conv_id || '-' || CASE WHEN conv_id % 4 = 0 THEN 'scheduler'
                 WHEN conv_id % 4 = 3 THEN 'runner' ELSE 'worker' END AS name,
                 CASE conv_id % 3 WHEN 0 THEN 'Running' WHEN 1 THEN 'Pending'
                      ELSE 'Failed' END AS phase,
                 string_agg(text, chr(10) ORDER BY turn) AS log
          FROM conversations GROUP BY conv_id) p
    WHERE p.name NOT LIKE '%runner'""")
def collect_logs(spark, sf):
    found = logs.collect_logs(
        roles.log_lines(spark, sf), roles.log_pods(spark, sf), "pod", "line_no", "line"
    )
    return found.select("name", "log")


@query("s7_write_specs", roles=("clusters",), sql="""
    SELECT cluster_id, replace(lower(name), '#', '-') AS name, minimum AS replicas,
           CASE WHEN cluster_id % 2 = 0 THEN '["fleet-worker",'
                ELSE '["fleet-cuda-worker","--nthreads","4",' END
             || '"--name","$(WORKER_NAME)","--dashboard","--dashboard-address","8788"]'
             AS worker_args,
           CASE WHEN cluster_id % 7 = 0
                THEN '["fleet-scheduler","--host","0.0.0.0","--jupyter"]'
                ELSE '["fleet-scheduler","--host","0.0.0.0"]' END AS scheduler_args,
           CASE WHEN cluster_id % 4 <> 0 THEN segment END AS env_value,
           CASE WHEN cluster_id % 3 <> 0 THEN (cluster_id % 8 + 1) || 'Gi' END AS memory,
           CASE WHEN cluster_id % 5 = 0 THEN 'LoadBalancer' ELSE 'ClusterIP' END AS service_type,
           CAST(idle_timeout_s AS VARCHAR) AS idle_timeout, '8787' AS dashboard_port
    FROM clusters""")
def write_specs(spark, sf):
    lines = specs.spec_lines(roles.cluster_params(spark, sf), roles.WORDS)

    def at(path: str):
        return F.get_json_object("line", f"$.spec.{path}")

    worker, scheduler = "worker.spec.containers[0]", "scheduler.spec.containers[0]"
    return lines.select(
        "cluster_id",
        F.get_json_object("line", "$.metadata.name").alias("name"),
        at("worker.replicas").cast("int").alias("replicas"),
        at(f"{worker}.args").alias("worker_args"),
        at(f"{scheduler}.args").alias("scheduler_args"),
        at(f"{worker}.env[0].value").alias("env_value"),
        at(f"{worker}.resources.limits.memory").alias("memory"),
        at("scheduler.service.type").alias("service_type"),
        at("idleTimeout").alias("idle_timeout"),
        at("scheduler.service.ports[1].port").alias("dashboard_port"),
    )


@query("f1_select_labels", roles=("clusters",), sql="""
    SELECT cluster_id, name FROM clusters
    WHERE segment = 'BUILDING' AND namespace % 4 = 1""")
def select_labels(spark, sf):
    zone = F.concat(F.lit("z"), F.col("namespace") % 4)
    labelled = roles.clusters(spark, sf).withColumn(
        "labels", F.create_map(F.lit("segment"), F.col("segment"), F.lit("zone"), zone)
    )
    found = select.select_labels(
        labelled, "segment=BUILDING,zone=z1", columns={"segment": "segment"}
    )
    return found.select("cluster_id", "name")


@query("f2_select_field", roles=("worker_groups",), sql="""
    SELECT group_id, cluster_id FROM worker_groups WHERE phase = 'Running'""")
def select_field(spark, sf):
    groups = roles.worker_groups(spark, sf).withColumn("status", F.struct("phase"))
    return select.select_field(groups, "status.phase=Running").select("group_id", "cluster_id")


@query("f3_drop_reserved_keys", roles=("clusters",), sql="""
    SELECT cluster_id, 'note' AS key, 'n' || (cluster_id % 10) AS value FROM clusters""")
def drop_reserved_keys(spark, sf):
    kept = labels.drop_reserved_keys(roles.cluster_labels(spark, sf), "annotations")
    return kept.select("cluster_id", F.explode("annotations"))


@query("f4_printer_columns", roles=("worker_groups",), sql="""
    SELECT CAST(group_id AS VARCHAR) AS name, desired AS workers,
           CAST(epoch(TIMESTAMP '2002-01-01') - epoch(created) AS BIGINT) AS age_s
    FROM worker_groups""")
def printer_columns(spark, sf):
    manifests = roles.worker_groups(spark, sf).select(
        F.struct(F.col("group_id").cast("string").alias("name"),
                 F.col("created").alias("creationTimestamp")).alias("metadata"),
        F.struct(F.struct(F.col("desired").alias("replicas")).alias("worker")).alias("spec"),
    )
    return select.printer_columns(manifests, "workergroup", F.expr(AS_OF))


@query("f5_split_valid_names", roles=("names",), sql="""
    SELECT origin, id, name,
           CASE WHEN length(name) > 53 THEN 'too long'
                WHEN NOT regexp_full_match(name, '[a-z0-9]([-a-z0-9]*[a-z0-9])?')
                THEN 'bad characters' END AS reason,
           CASE WHEN length(name) <= 53
                 AND regexp_full_match(name, '[a-z0-9]([-a-z0-9]*[a-z0-9])?')
                THEN 'Created' ELSE 'Error' END AS phase
    FROM names""")
def split_valid_names(spark, sf):
    return select.split_valid_names(roles.names(spark, sf), "name")


@query("f6_is_ready", roles=("worker_groups",), sql="""
    SELECT group_id, group_id % 7 <> 0 AND phase = 'Running' AS ready FROM worker_groups""")
def is_ready(spark, sf):
    known = F.when(F.col("group_id") % 7 != 0, F.col("phase"))
    groups = roles.worker_groups(spark, sf).select("group_id", F.struct(known.alias("phase")).alias("status"))
    return select.is_ready(groups).select("group_id", "ready")


@query("f7_check_constraints", roles=("clusters",), sql="""
    SELECT cluster_id, 'cluster' AS field, 'Required' AS rule FROM clusters
    WHERE cluster_id % 11 = 0
    UNION ALL SELECT cluster_id, 'minimum', 'IntegerValue' FROM clusters
    WHERE cluster_id % 13 = 0
    UNION ALL SELECT cluster_id, 'maximum', 'Required' FROM clusters
    WHERE cluster_id % 17 = 0
    UNION ALL SELECT cluster_id, 'segment', 'OneOf' FROM clusters
    WHERE segment NOT IN ('BUILDING', 'MACHINERY', 'AUTOMOBILE')""")
def check_constraints(spark, sf):
    key = F.col("cluster_id")
    found = roles.clusters(spark, sf).select(
        "cluster_id", "segment",
        F.when(key % 11 != 0, F.col("name")).alias("cluster"),
        F.when(key % 13 == 0, "many").otherwise(F.col("minimum").cast("string")).alias("minimum"),
        F.when(key % 17 != 0, F.col("maximum")).alias("maximum"),
        F.lit(None).cast("int").alias("replicas"),
    )
    filled = select.fill_defaults(found, {"replicas": 1})
    return select.check_constraints(filled, ["cluster_id"], [
        select.Required("cluster"), select.Required("replicas"), select.Required("maximum"),
        select.IntegerValue("minimum"),
        select.OneOf("segment", ("BUILDING", "MACHINERY", "AUTOMOBILE")),
    ])


@query("f8_check_resource_keys", """
    SELECT p_partkey, 'limit' AS field, 'unknown field' AS problem FROM part
    WHERE p_partkey % 5 = 0
    UNION ALL SELECT p_partkey, 'requests', 'not a mapping' FROM part WHERE p_partkey % 7 = 0""")
def check_resource_keys(spark, sf):
    key = F.col("p_partkey")
    memory = F.concat(F.lit('{"memory": "'), F.col("p_size"), F.lit('Gi"}'))
    resources = F.create_map(
        F.when(key % 5 == 0, "limit").otherwise("limits"), memory,
        F.lit("requests"), F.when(key % 7 == 0, "2Gi").otherwise(memory),
    )
    parts = roles.table(spark, sf, "part").select("p_partkey", resources.alias("resources"))
    return select.check_resource_keys(parts, ["p_partkey"], "resources")


@query("f9_min_level", roles=("watch",), sql="""
    SELECT seq, event_type FROM watch WHERE event_type IN ('purchase', 'error')""")
def min_level(spark, sf):
    level = {"view": "DEBUG", "click": "INFO", "signup": "INFO", "purchase": "WARNING",
             "error": "ERROR"}
    events = roles.watch(spark, sf).select(
        "seq", "event_type", phases.lookup(F.col("event_type"), level).alias("level")
    )
    return phases.min_level(events, "level", "WARNING").drop("level")


@query("f10_service_phase", roles=("services",), sql="SELECT group_id, phase FROM services")
def service_phase(spark, sf):
    found = select.with_service_phase(
        roles.services(spark, sf), "service_type", "ingress", "phase"
    )
    return found.select("group_id", "phase")


@query("x1_render_names", roles=("names",), sql="""
    SELECT origin, id, name || '-scheduler' AS scheduler_name,
           name || '-default' AS default_group_name, name || '-runner' AS runner_name,
           origin || '-worker-' || id AS worker_name,
           origin || '-' || substr(sha256(name), 1, 10) || '-fleet' AS rendered_name
    FROM names""")
def render_names(spark, sf):
    rows = roles.names(spark, sf).withColumns({
        "template": F.lit("{user}-{uuid}-fleet"), "uuid": F.sha2("name", 256)
    })
    rendered = names.render_names(rows, "name", "origin", "id", "template", "origin", "uuid")
    return rendered.drop("name", "template", "uuid")
