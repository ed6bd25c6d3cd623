"""Queries over aggregates, windows, expansion and the handler registry."""

from __future__ import annotations

from pyspark.sql import functions as F

from musterroll.functions import labels, manifests, names, phases
from musterroll.functions.clock import seconds_between
from musterroll.operators import expand, ordered, rollup
from musterroll.operators.handlers import Handlers, Rule
from musterroll.plans import roles
from musterroll.plans.registry import query
from musterroll.plans.relations import change_events, fleet_plan

POD_KEYS = ["group_id", "part", "supplier", "line"]
COMPONENTS = {
    "urgent": "1-URGENT", "high": "2-HIGH", "medium": "3-MEDIUM",
    "unspecified": "4-NOT SPECIFIED", "low": "5-LOW",
}


@query("a1_count_members", roles=("workers",), sql="""
    SELECT group_id, count(*) AS members FROM workers GROUP BY group_id""")
def count_members(spark, sf):
    return rollup.count_members(roles.workers(spark, sf), ["group_id"])


@query("a2_component_board", roles=("worker_groups",), sql="SELECT cluster_id, " + ", ".join(
    f"coalesce(arg_max(phase, (created, group_id)) FILTER (WHERE component = '{v}'), '-') AS {c}"
    for c, v in COMPONENTS.items()) + " FROM worker_groups GROUP BY cluster_id")
def component_board(spark, sf):
    return rollup.component_board(
        roles.worker_groups(spark, sf), ["cluster_id"], "component", "phase",
        ["created", "group_id"], COMPONENTS,
    )


@query("a3_pod_phase", roles=("pods",), sql="""
    SELECT group_id, part, supplier, line,
           CASE WHEN phase <> 'Running' THEN phase
                ELSE coalesce(list_filter(reasons, lambda r: r IS NOT NULL)[-1],
                              CASE WHEN ready THEN phase ELSE 'Health Checking' END) END AS phase
    FROM pods""")
def pod_phase(spark, sf):
    shown = phases.pod_phase(F.col("phase"), F.col("ready"), F.col("containers"))
    return roles.pods(spark, sf).select(*POD_KEYS, shown.alias("phase"))


@query("a4_crash_looping", roles=("pods",), sql="""
    SELECT group_id, part, supplier, line FROM pods
    WHERE phase = 'Running' AND NOT ready AND list_contains(reasons, 'CrashLoopBackOff')
      AND created + INTERVAL 60 DAY < TIMESTAMP '2001-06-01'""")
def crash_looping(spark, sf):
    running_for = seconds_between("created", F.expr("TIMESTAMP_NTZ'2001-06-01 00:00:00'"))
    looping = phases.crash_looping(
        F.col("phase"), F.col("ready"), F.col("containers"), running_for, 60 * 86400
    )
    return roles.pods(spark, sf).where(looping).select(*POD_KEYS)


JOB_RUNS_SQL = """
    , runs AS (
      SELECT key, arg_max(phase, (ts, seq)) AS last,
             max(ts) FILTER (WHERE changed AND phase = 'Running') AS started,
             max(ts) FILTER (WHERE changed AND phase IN ('Succeeded', 'Failed')) AS ended
      FROM (SELECT *, phase IS DISTINCT FROM lag(phase) OVER (PARTITION BY key ORDER BY ts, seq)
                   AS changed FROM watch) GROUP BY key)
    SELECT key, CAST(key AS VARCHAR) AS clusterName, key || '-runner' AS jobRunnerPodName,
           CASE last WHEN 'Created' THEN 'JobCreated' WHEN 'Pending' THEN 'ClusterCreated'
                WHEN 'Running' THEN 'Running' WHEN 'Succeeded' THEN 'Successful'
                ELSE 'Failed' END AS jobStatus,
           strftime(started, '%Y-%m-%dT%H:%M:%SZ') AS startTime,
           strftime(ended, '%Y-%m-%dT%H:%M:%SZ') AS endTime,
           CASE WHEN ended >= started
                THEN CAST(floor((epoch_us(ended) - epoch_us(started)) / 1e6) AS BIGINT)
           END AS duration_s
    FROM runs"""


@query("a5_job_runs", roles=("watch",), sql=JOB_RUNS_SQL)
def job_runs(spark, sf):
    return rollup.job_runs(roles.watch(spark, sf), "key", "ts", "phase", ["ts", "seq"])


@query("a6_latest_state", roles=("watch",), sql="""
    SELECT key, max(seq) AS seq, arg_max(ts, seq) AS ts, arg_max(phase, seq) AS phase,
           arg_max(target, seq) AS target
    FROM (SELECT * FROM watch
          QUALIFY row_number() OVER (PARTITION BY key ORDER BY ts DESC, seq DESC) = 1)
    GROUP BY key""")
def latest_state(spark, sf):
    events = roles.watch(spark, sf).drop("event_type", "patch")
    return rollup.latest_state(events, ["key"], ["ts", "seq"])


@query("a7_replay_patches", roles=("watch",), sql="""
    SELECT key, arg_max(phase, (ts, seq)) FILTER (WHERE event_type <> 'view') AS phase,
           arg_max(target, (ts, seq)) FILTER (WHERE event_type IN ('purchase', 'error')) AS replicas,
           arg_max(patch, (ts, seq)) FILTER (WHERE event_type = 'signup') AS patch
    FROM watch GROUP BY key""")
def replay_patches(spark, sf):
    kind = F.col("event_type")
    patches = roles.watch(spark, sf).select(
        "key", "ts", "seq",
        F.when(kind != "view", F.col("phase")).alias("phase"),
        F.when(kind.isin("purchase", "error"), F.col("target")).alias("replicas"),
        F.when(kind == "signup", F.col("patch")).alias("patch"),
    )
    return rollup.replay_patches(
        patches, ["key"], ["ts", "seq"], ["phase", "replicas", "patch"]
    )


@query("a8_duplicate_env", roles=("workers",), sql="""
    SELECT group_id, name, count(*) AS times
    FROM (SELECT group_id, 'L' || line AS name FROM workers
          UNION ALL SELECT group_id, 'P' || (part % 50) FROM workers)
    GROUP BY group_id, name HAVING count(*) > 1""")
def duplicate_env(spark, sf):
    def entry(prefix, value):
        return F.struct(F.concat(F.lit(prefix), value).alias("name"))

    env = F.array(entry("L", F.col("line")), entry("P", F.col("part") % 50))
    documents = roles.workers(spark, sf).select("group_id", env.alias("env"))
    return rollup.duplicate_env(documents, ["group_id"], "env")


_NEWEST = ", ".join(f"{c} DESC" + (" NULLS LAST" if c == "waiting_reason" else "")
                    for c in roles.WORKER_ORDER)


@query("w1_lifo_victims", roles=("worker_groups", "workers", "plan"), sql=f"""
    SELECT group_id, created, part, supplier, line, rank
    FROM (SELECT w.*, -needed AS n,
                 row_number() OVER (PARTITION BY group_id ORDER BY {_NEWEST.replace(
                     'created', 'w.created')}) AS rank
          FROM workers w JOIN plan USING (group_id) WHERE needed < 0)
    WHERE rank <= n""")
def lifo_victims(spark, sf):
    surplus = fleet_plan(spark, sf).select("group_id", (-F.col("needed")).alias("n"))
    victims = ordered.lifo_victims(
        roles.workers(spark, sf), surplus, ["group_id"], roles.WORKER_ORDER
    )
    return victims.select("group_id", "created", "part", "supplier", "line", "rank")


@query("w2_field_changes", roles=("watch",), sql="""
    SELECT key, seq, old, phase
    FROM (SELECT *, lag(phase) OVER w AS old, row_number() OVER w AS n FROM watch
          WINDOW w AS (PARTITION BY key ORDER BY ts, seq))
    WHERE n > 1 AND phase = 'Running' AND old <> 'Running'""")
def field_changes(spark, sf):
    changes = ordered.field_changes(
        roles.watch(spark, sf).select("key", "ts", "seq", "phase"), ["key"], ["ts", "seq"],
        "phase", new="Running", skip_first=True,
    )
    return changes.select("key", "seq", "old", "phase")


@query("w3_stuck_in_phase", roles=("watch",), sql="""
    , starts AS (
      SELECT * FROM (SELECT *, lag(phase) OVER (PARTITION BY key ORDER BY ts, seq) AS old
                     FROM watch) WHERE old IS DISTINCT FROM phase), stays AS (
      SELECT key, phase, ts AS since,
             coalesce(lead(ts) OVER (PARTITION BY key ORDER BY ts, seq),
                      TIMESTAMP '2024-02-01') AS until FROM starts)
    SELECT *, CAST(floor((epoch_us(until) - epoch_us(since)) / 1e6) AS BIGINT) AS stay_s
    FROM stays JOIN (VALUES ('Pending', 43200), ('Failed', 21600), ('Created', 86400))
      l(phase, limit_s) USING (phase)
    WHERE floor((epoch_us(until) - epoch_us(since)) / 1e6) > limit_s""".replace(
    "SELECT *, CAST(floor((epoch_us(until)", "SELECT key, phase, since, until,"
    " CAST(floor((epoch_us(until)"))
def stuck_in_phase(spark, sf):
    limits = spark.createDataFrame(
        [("Pending", 43200), ("Failed", 21600), ("Created", 86400), ("Running", 0)],
        "phase STRING, limit_s LONG",
    )
    return ordered.stuck_in_phase(
        roles.watch(spark, sf).select("key", "ts", "seq", "phase"), ["key"], ["ts", "seq"],
        "ts", "phase", limits, F.expr("TIMESTAMP_NTZ'2024-02-01 00:00:00'"),
    )


@query("e1_expand_resources", roles=("named",), sql="""
    , base AS (SELECT cluster_id, name, segment, 't' || (cluster_id % 3) AS tier,
                      cluster_id % 2 = 0 AS pooled FROM named)
    SELECT cluster_id, 'Deployment' AS kind, name || '-scheduler' AS child,
           name || '/scheduler/' || segment || '/scheduler/false/-' AS labels, 2 AS n_annotations
    FROM base
    UNION ALL SELECT cluster_id, 'Service', name || '-scheduler',
           name || '/scheduler/' || segment || '/scheduler/-/-', 2 FROM base
    UNION ALL SELECT cluster_id, 'WorkerGroup', name || '-default',
           name || '/workergroup/' || segment || '/' || tier || '/-/'
             || CASE WHEN pooled THEN 'p' ELSE '-' END, 1 FROM base
    UNION ALL SELECT cluster_id, 'Cluster', name,
           name || '/-/' || segment || '/scheduler/-/-', 2 FROM base
    UNION ALL SELECT cluster_id, 'Pod', name || '-runner',
           name || '/job-runner/' || segment || '/' || tier || '/false/'
             || CASE WHEN pooled THEN 'p' ELSE '-' END, 1 FROM base""")
def expand_resources(spark, sf):
    owners = roles.cluster_labels(spark, sf)
    jobs = owners.withColumnsRenamed({
        "scheduler_labels": "cluster_labels", "scheduler_annotations": "cluster_annotations",
        "worker_labels": "job_labels", "worker_annotations": "job_annotations",
    })
    children = expand.expand_resources(owners, roles.WORDS).unionByName(
        expand.expand_jobs(jobs, roles.WORDS)
    )
    shown = [roles.WORDS.label("cluster-name"), roles.WORDS.label("component"), "segment",
             "tier", "sidecar.istio.io/inject", "pool"]
    return children.select(
        "cluster_id", "kind", F.col("name").alias("child"),
        F.concat_ws("/", *[F.coalesce(F.col("labels")[k], F.lit("-")) for k in shown])
        .alias("labels"),
        F.size("annotations").alias("n_annotations"),
    )


@query("e2_expand_workers", roles=("worker_groups", "workers", "plan"), sql="""
    , new AS (SELECT group_id, coalesce(last, 0) + unnest(range(1, needed + 1)) AS ordinal
              FROM plan LEFT JOIN (SELECT group_id, max(line) AS last FROM workers GROUP BY group_id)
              USING (group_id) WHERE needed > 0)
    SELECT group_id, ordinal, substr(sha256(group_id || ':' || ordinal), 1, 16) AS worker_id,
           group_id || '-worker-' || substr(sha256(group_id || ':' || ordinal), 1, 16)
             AS worker_name
    FROM new""")
def expand_workers(spark, sf):
    # The line number plays the ordinal of a worker; groups have gaps and repeats.
    used = roles.workers(spark, sf).groupBy("group_id").agg(F.max("line").alias("last_ordinal"))
    groups = fleet_plan(spark, sf).join(used, "group_id", "left")
    rows = expand.expand_workers(groups, "group_id")
    return rows.select("group_id", "ordinal", "worker_id", "worker_name")


@query("e3_creation_waves", roles=("worker_groups", "workers", "plan"), sql="""
    , waves AS (SELECT group_id, created, needed, unnest(range(0, (needed + 1) // 2)) AS w
                FROM plan WHERE needed > 0)
    SELECT group_id, w + 1 AS wave, least(2, needed - w * 2) AS wave_size,
           created + to_seconds(w * 30) AS wave_at
    FROM waves""")
def creation_waves(spark, sf):
    waves = expand.creation_waves(
        fleet_plan(spark, sf), "group_id", "needed", "created", 2, 30
    )
    return waves.select("group_id", "wave", "wave_size", "wave_at")


@query("u1_run_handlers", roles=("watch",), sql="""
    SELECT 'on_runner_end' AS handler, key, count(*) AS n FROM watch
    WHERE seq % 3 = 1 AND phase = 'Succeeded' AND seq % 7 <> 0 AND key % 2 = 0 GROUP BY key
    UNION ALL SELECT 'on_cluster_created', key, 1 FROM watch
    WHERE seq % 3 = 0 AND phase = 'Created'
    UNION ALL SELECT 'on_service', key, max(seq) FROM watch
    WHERE seq % 3 = 2 GROUP BY key""")
def run_handlers(spark, sf):
    handlers = Handlers()
    handlers.register_handler(
        Rule("pod", "phase", "Succeeded", {"component": "job-runner"}),
        lambda df: df.groupBy("key").agg(F.count(F.lit(1)).alias("n")), "on_runner_end",
    )
    handlers.register_handler(
        Rule("cluster", "phase", "Created"),
        lambda df: df.select("key", F.lit(1).cast("long").alias("n")), "on_cluster_created",
    )
    handlers.register_handler(
        Rule("service"), lambda df: df.groupBy("key").agg(F.max("seq").alias("n")), "on_service",
    )
    return handlers.run_handlers(change_events(spark, sf))


# --- maps, lists and addresses -------------------------------------------------------


@query("x2_merge_layers", roles=("clusters",), sql="""
    SELECT cluster_id, 'zone' AS key, 'z' || namespace AS value FROM clusters
    UNION ALL SELECT cluster_id, 'segment', segment FROM clusters
    UNION ALL SELECT cluster_id, 'tier', CASE WHEN cluster_id % 3 = 0 THEN 'base'
                                              ELSE 't' || (cluster_id % 4) END FROM clusters
    UNION ALL SELECT cluster_id, 'owner', 'fleet' FROM clusters WHERE cluster_id % 3 = 0""")
def merge_layers(spark, sf):
    key = F.col("cluster_id")
    top = F.create_map(F.lit("zone"), F.concat(F.lit("z"), "namespace"), F.lit("segment"),
                       F.lit("none"))
    part = F.create_map(F.lit("segment"), F.col("segment"), F.lit("tier"),
                        F.concat(F.lit("t"), key % 4))
    base = F.when(key % 3 == 0, F.create_map(
        F.lit("tier"), F.lit("base"), F.lit("owner"), F.lit("fleet")))
    merged = labels.merge_layers(top, part, base)
    return roles.clusters(spark, sf).select("cluster_id", F.explode(merged))


@query("x3_env_to_list", roles=("clusters",), sql="""
    SELECT cluster_id, 'SEGMENT' AS name, segment AS value FROM clusters
    UNION ALL SELECT cluster_id, 'ZONE', CAST(namespace AS VARCHAR) FROM clusters""")
def env_to_list(spark, sf):
    env = F.create_map(F.lit("SEGMENT"), F.col("segment"), F.lit("ZONE"),
                       F.col("namespace").cast("string"))
    listed = labels.env_to_list(env)
    back = labels.env_to_list(labels.list_to_env(listed))
    return roles.clusters(spark, sf).select("cluster_id", F.inline(back))


@query("x4_inject_env", roles=("workers",), sql="""
    , c AS (SELECT group_id, part, supplier, line, unnest(['main', 'side']) AS container
            FROM workers)
    SELECT group_id, part, supplier, line, container, 'OWN' AS name,
           CAST(part AS VARCHAR) AS value FROM c WHERE container = 'main' AND line % 3 = 2
    UNION ALL SELECT group_id, part, supplier, line, container, 'WORKER_NAME',
           CASE WHEN container = 'main' AND line % 3 = 1 THEN 'mine'
                ELSE group_id || '-worker-' || line END FROM c
    UNION ALL SELECT group_id, part, supplier, line, container, 'SCHEDULER_ADDRESS',
           'tcp://c' || (group_id % 100) || '-scheduler.default.svc.cluster.local:8786' FROM c""")
def inject_env(spark, sf):
    def item(name, value):
        return F.struct(F.lit(name).alias("name"), value.alias("value"))

    own = F.when(F.col("line") % 3 == 1, F.array(item("WORKER_NAME", F.lit("mine")))).when(
        F.col("line") % 3 == 2, F.array(item("OWN", F.col("part").cast("string")))
    )
    none = F.lit(None).cast("array<struct<name:string,value:string>>")
    containers = F.array(
        F.struct(F.lit("main").alias("container"), own.alias("env")),
        F.struct(F.lit("side").alias("container"), none.alias("env")),
    )
    cluster = F.concat(F.lit("c"), F.col("group_id") % 100)
    defaults = {
        roles.WORDS.worker_name_env: names.worker_name(
            F.col("group_id").cast("string"), F.col("line").cast("string")),
        roles.WORDS.scheduler_address_env: manifests.scheduler_address(cluster, F.lit("default")),
    }
    given = roles.workers(spark, sf).select(
        *POD_KEYS, F.explode(containers).alias("_c"))
    completed = labels.complete_env(F.col("_c.env"), defaults)
    return given.select(*POD_KEYS, F.col("_c.container").alias("container"), F.inline(completed))


def _pairs(spark, sf):
    seq = F.col("seq")
    good = F.concat_ws("=", F.col("event_type"), F.col("target").cast("string"))
    pair = F.when(seq % 17 == 0, F.col("event_type")).when(
        seq % 19 == 0, F.concat(good, F.lit("=x"))).otherwise(good)
    return roles.watch(spark, sf).select("key", "ts", "seq", pair.alias("pair"))


@query("x5_pairs_to_settings", roles=("watch",), sql="""
    SELECT key, event_type AS name, CAST(arg_max(target, (ts, seq)) AS VARCHAR) AS value
    FROM watch WHERE seq % 17 <> 0 AND seq % 19 <> 0 GROUP BY key, event_type""")
def pairs_to_settings(spark, sf):
    settings = labels.pairs_to_settings(_pairs(spark, sf), ["key"], "pair", ["ts", "seq"])
    return settings.select("key", F.explode("settings").alias("name", "value"))


@query("x5_pair_errors", roles=("watch",), sql="""
    SELECT seq, CASE WHEN seq % 17 = 0 THEN event_type
                     ELSE event_type || '=' || target || '=x' END AS pair
    FROM watch WHERE seq % 17 = 0 OR seq % 19 = 0""")
def pair_errors(spark, sf):
    return labels.pair_errors(_pairs(spark, sf), "pair").select("seq", "pair")


@query("x6_address_inventory", """
    SELECT regexp_extract(url, '://([^/:]*)', 1) AS host,
           CASE WHEN page_id % 2 = 0 THEN CAST(8000 + page_id % 10 AS INTEGER) END AS port,
           count(*) AS n_addresses
    FROM pages GROUP BY 1, 2""")
def address_inventory(spark, sf):
    return names.address_inventory(roles.addresses(spark, sf), "address")


@query("x6_notebook_link", """
    SELECT page_id, 'http://' || regexp_extract(url, '://([^/:]*)', 1) || ':8787/jupyter/lab' AS link
    FROM pages""")
def notebook_link(spark, sf):
    host, _ = names.address_parts(F.col("address"))
    dashboard = F.concat(F.lit("http://"), host, F.lit(":8787/status"))
    return roles.addresses(spark, sf).select(
        "page_id", names.notebook_link(dashboard).alias("link")
    )


@query("x7_named_port", """
    SELECT s_suppkey, CASE WHEN s_suppkey % 5 IN (0, 1) THEN NULL
                           WHEN s_suppkey % 5 = 2 THEN 9000 ELSE 8786 END AS port,
           CASE s_suppkey % 5 WHEN 0 THEN 'several ports' WHEN 1 THEN 'no such port' END AS problem
    FROM supplier""")
def named_port(spark, sf):
    key = F.col("s_suppkey")

    def port(name, number):
        return F.struct(name.alias("name"), F.lit(number).alias("port"),
                        F.lit(number + 20000).alias("nodePort"))

    comm = F.when(key % 5 == 1, "other").when(key % 5 == 2, "none").otherwise("tcp-comm")
    own = F.when(key % 5 < 3, F.when(key % 5 == 1, "http").otherwise(F.col("s_name"))).otherwise("h")
    ports = F.array(port(comm, 8786), port(own, 9000))
    found = names.named_port(ports, F.col("s_name"), "tcp-comm")
    return roles.table(spark, sf, "supplier").select("s_suppkey", found.alias("_p")).select(
        "s_suppkey", "_p.port", "_p.problem"
    )


@query("x8_overlay_settings", roles=("clusters",), sql="""
    SELECT cluster_id,
           CASE WHEN cluster_id % 2 = 0 THEN 'c' || (cluster_id % 9)
                WHEN namespace % 3 <> 0 THEN n_name ELSE r_name END AS value,
           CASE WHEN cluster_id % 2 = 0 THEN 'cluster'
                WHEN namespace % 3 <> 0 THEN 'namespace' ELSE 'fleet' END AS source
    FROM clusters JOIN nation ON n_nationkey = namespace
    JOIN region ON r_regionkey = n_regionkey""")
def overlay_settings(spark, sf):
    key = F.col("cluster_id")
    scoped = (
        roles.clusters(spark, sf)
        .join(roles.table(spark, sf, "nation"), F.col("namespace") == F.col("n_nationkey"))
        .join(roles.table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    )

    def layer(priority, source, value):
        return F.struct(F.lit(priority).alias("priority"), F.lit(source).alias("source"),
                        value.alias("value"))

    layers = scoped.select("cluster_id", F.inline(F.array(
        layer(0, "fleet", F.col("r_name")),
        layer(1, "namespace", F.when(F.col("namespace") % 3 != 0, F.col("n_name"))),
        layer(2, "cluster", F.when(key % 2 == 0, F.concat(F.lit("c"), key % 9))),
    )))
    return labels.overlay_settings(layers, ["cluster_id"], "priority", "value", "source")


@query("x9_phase_severity", roles=("watch",), sql="""
    SELECT seq, CASE WHEN seq % 11 = 0 THEN '-' WHEN seq % 13 = 0 THEN 'red'
                     WHEN phase IN ('Running', 'Created') THEN 'green'
                     WHEN phase = 'Pending' THEN 'yellow' ELSE 'none' END AS severity
    FROM watch""")
def phase_severity(spark, sf):
    seq = F.col("seq")
    phase = F.when(seq % 11 != 0, F.when(seq % 13 == 0, "CrashLoopBackOff")
                   .otherwise(F.col("phase")))
    return roles.watch(spark, sf).select("seq", phases.phase_severity(phase).alias("severity"))


@query("x10_flatten_manifest", roles=("clusters",), sql="""
    SELECT cluster_id, 'registry.example/' || lower(segment) || ':latest' AS image,
           CASE WHEN cluster_id % 3 <> 0 THEN (cluster_id % 8 + 1) || 'Gi' END AS memory,
           CASE WHEN cluster_id % 4 <> 0 THEN 1 ELSE 0 END AS n_env,
           minimum AS n_workers, cluster_id % 7 = 0 AS jupyter
    FROM clusters""")
def flatten_manifest(spark, sf):
    documents = manifests.cluster_documents(roles.cluster_params(spark, sf), roles.WORDS)
    flat = manifests.flatten_manifest(documents.select("cluster_id", "document"))
    return flat.select(
        "cluster_id", "image", F.col("resources")["limits"]["memory"].alias("memory"),
        F.size("env").alias("n_env"), "n_workers", "jupyter",
    )


@query("x11_step_target", roles=("watch", "clusters"), sql="""
    , s AS (SELECT seq, CAST(seq % 60 AS INTEGER) AS cur,
                   least(maximum, greatest(minimum, target)) AS t
            FROM watch JOIN clusters ON cluster_id = key)
    SELECT seq, CAST(CASE WHEN cur > 0 THEN
        greatest(cur - greatest(1, CAST(floor(cur * 0.25) AS INTEGER)), t)
        ELSE t END AS INTEGER) AS replicas
    FROM s""")
def step_target(spark, sf):
    rows = roles.watch(spark, sf).join(roles.watch_clusters(spark, sf), "key")
    current = (F.col("seq") % 60).cast("int")
    return rows.select("seq", phases.step_target(
        current, F.col("target"), F.col("minimum"), F.col("maximum")).alias("replicas"))
