"""Queries over whole child documents."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from musterroll.operators import children, expand, sets, validate
from musterroll.plans import roles
from musterroll.plans.registry import query
from musterroll.plans.relations import fleet_plan


def shown(paths: dict[str, str]) -> list[Column]:
    """Parts of the manifest as columns; a path that the document lacks gives null."""
    return [F.get_json_object("manifest", f"$.{path}").alias(name) for name, path in paths.items()]


_CLUSTERS = """
    , base AS (
      SELECT cluster_id, 'ns-' || namespace AS namespace, lower(segment) AS segment,
             replace(lower(name), '#', '-') AS name, 't' || (cluster_id % 3) AS tier,
             CASE WHEN cluster_id % 2 = 0 THEN 'p' END AS pool,
             'registry.example/' || lower(segment) || ':latest' AS image,
             CASE WHEN cluster_id % 5 = 0 THEN 'LoadBalancer' ELSE 'ClusterIP' END AS service_type,
             minimum, 'uid-' || cluster_id AS uid,
             CASE WHEN cluster_id % 4 <> 0 THEN '{"name":"SEGMENT","value":"' || segment || '"},' ELSE '' END AS own_env,
             'tcp://' || replace(lower(name), '#', '-') || '-scheduler.ns-' || namespace
               || '.svc.cluster.local:8786' AS address
      FROM clusters)"""


@query("e1_child_manifests", roles=("clusters",), sql=_CLUSTERS + """
    SELECT cluster_id, 'Deployment' AS kind, name || '-scheduler' AS child, namespace, 'apps/v1' AS api, uid AS owner,
           name AS cluster, 'scheduler' AS component, 'scheduler' AS tier, NULL AS pool, 'false' AS sidecar,
           'on' AS probe, 'n' || (cluster_id % 10) AS note, name || '-scheduler' AS template_name,
           'scheduler' AS matched, image AS image, NULL AS service_type, NULL AS replicas, NULL AS env
    FROM base
    UNION ALL SELECT cluster_id, 'Service', name || '-scheduler', namespace, 'v1', uid, name, 'scheduler', 'scheduler',
           NULL, NULL, 'on', 'n' || (cluster_id % 10), NULL, NULL, NULL, service_type, NULL, NULL FROM base
    UNION ALL SELECT cluster_id, 'WorkerGroup', name || '-default', namespace, 'fleet.example/v1', uid, name, 'workergroup',
           tier, pool, NULL, NULL, 'n' || (cluster_id % 10), NULL, NULL, image, NULL, CAST(minimum AS VARCHAR), NULL FROM base
    UNION ALL SELECT cluster_id, 'Cluster', name, namespace, 'fleet.example/v1', uid, name, NULL, 'scheduler', NULL,
           NULL, 'on', 'n' || (cluster_id % 10), NULL, NULL, image, service_type, CAST(minimum AS VARCHAR), NULL FROM base
    UNION ALL SELECT cluster_id, 'Pod', name || '-runner', namespace, 'v1', uid, name, 'job-runner', tier, pool, 'false',
           NULL, 'n' || (cluster_id % 10), NULL, NULL, image, NULL, NULL,
           '[' || own_env || '{"name":"SCHEDULER_ADDRESS","value":"' || address || '"}]' FROM base""")
def child_manifests(spark, sf):
    """Children of every cluster, and of a job that runs its worker container on it."""
    clusters = roles.cluster_manifests(spark, sf)
    doc = F.col("document")
    cluster, runner = doc["spec"]["scheduler"]["metadata"], doc["spec"]["worker"]
    jobs = clusters.withColumn("document", F.struct(
        F.lit(roles.WORDS.api_version).alias("apiVersion"), F.lit("Job").alias("kind"), doc["metadata"].alias("metadata"),
        F.struct(
            F.struct(cluster.alias("metadata"), doc["spec"].dropFields("idleTimeout").alias("spec")).alias("cluster"),
            runner.dropFields("replicas").alias("job"),
        ).alias("spec"),
    ))
    rows = children.cluster_children(clusters, roles.WORDS).unionByName(children.job_children(jobs, roles.WORDS))
    word = roles.WORDS.label
    image = F.coalesce(*[F.get_json_object("manifest", f"$.spec.{p}.containers[0].image") for p in ("template.spec", "worker.spec")],
                       F.get_json_object("manifest", "$.spec.containers[0].image"))
    service = F.coalesce(F.get_json_object("manifest", "$.spec.type"), F.get_json_object("manifest", "$.spec.scheduler.service.type"))
    return rows.select("cluster_id", "kind", "child", *shown({
        "namespace": "metadata.namespace", "api": "apiVersion", "owner": "metadata.ownerReferences[0].uid",
        "cluster": f"metadata.labels['{word('cluster-name')}']", "component": f"metadata.labels['{word('component')}']",
        "tier": "metadata.labels.tier", "pool": "metadata.labels.pool",
        "sidecar": "metadata.labels['sidecar.istio.io/inject']", "probe": "metadata.annotations.probe",
        "note": "metadata.annotations.note", "template_name": "spec.template.metadata.name",
        "matched": f"spec.selector.matchLabels['{word('component')}']", "replicas": "spec.worker.replicas",
        "env": "spec.containers[0].env",
    }), image.alias("image"), service.alias("service_type"))


@query("e2_worker_manifests", roles=("clusters", "worker_groups", "workers", "plan"), sql=_CLUSTERS + """
    , new AS (SELECT group_id, cluster_id, coalesce(last, 0) + unnest(range(1, needed + 1)) AS ordinal
              FROM plan LEFT JOIN (SELECT group_id, max(line) AS last FROM workers GROUP BY group_id)
              USING (group_id) WHERE needed > 0)
    , named AS (SELECT *, 'g-' || group_id || '-worker-' || substr(sha256(group_id || ':' || ordinal), 1, 16) AS child FROM new)
    SELECT group_id, ordinal, child, name AS cluster, 'g-' || group_id AS of_group, 'worker' AS component, pool,
           segment, child AS matched_name,
           '[' || own_env || '{"name":"WORKER_NAME","value":"' || child || '"},{"name":"SCHEDULER_ADDRESS","value":"'
             || address || '"}]' AS env
    FROM named JOIN base USING (cluster_id)""")
def worker_manifests(spark, sf):
    """The deployment of every worker that a group lacks."""
    used = roles.workers(spark, sf).groupBy("group_id").agg(F.max("line").alias("last_ordinal"))
    groups = fleet_plan(spark, sf).join(used, "group_id", "left")
    rows = expand.expand_workers(groups, "group_id").select("group_id", "cluster_id", "ordinal", "worker_id")
    doc = F.col("document")
    owners = roles.cluster_manifests(spark, sf).select(
        "cluster_id", "namespace", doc["metadata"]["name"].alias("cluster"), doc["metadata"]["labels"].alias("cluster_labels"),
        doc["spec"]["worker"].alias("worker"),
    )
    # The cluster's worker part serves all of its groups; groups have no labels of their own.
    rows = rows.join(owners, "cluster_id").withColumn("document", F.struct(
        F.lit(roles.WORDS.api_version).alias("apiVersion"), F.lit(roles.WORDS.group_kind).alias("kind"),
        F.struct(F.concat(F.lit("g-"), "group_id").alias("name")).alias("metadata"),
        F.struct("cluster", "worker").alias("spec"),
    ))
    made = children.worker_children(rows, roles.WORDS, cluster_labels="cluster_labels")
    word = roles.WORDS.label
    return made.select("group_id", "ordinal", "child", *shown({
        "cluster": f"metadata.labels['{word('cluster-name')}']", "of_group": f"spec.selector.matchLabels['{word('workergroup-name')}']",
        "component": f"spec.template.metadata.labels['{word('component')}']", "pool": "metadata.labels.pool",
        "segment": "spec.template.metadata.labels.segment", "matched_name": "spec.template.metadata.name",
        "env": "spec.template.spec.containers[0].env",
    }))


@query("e4_group_documents", roles=("clusters",), sql=_CLUSTERS + """
    SELECT cluster_id, 'WorkerGroup' AS kind, name || '-extra' AS child, namespace, name AS cluster,
           CASE WHEN cluster_id % 6 = 0 THEN '9' ELSE CAST(minimum + 1 AS VARCHAR) END AS size,
           CASE WHEN cluster_id % 6 = 0 THEN 'own:1' ELSE image END AS image, NULL AS component
    FROM base
    UNION ALL SELECT cluster_id, 'Autoscaler', name, namespace, name, CAST(minimum AS VARCHAR), NULL, 'autoscaler' FROM base""")
def group_documents(spark, sf):
    """A second group for every cluster, some from a ready part, and its autoscaler."""
    params = roles.cluster_params(spark, sf).withColumn("namespace", F.concat(F.lit("ns-"), "namespace"))
    key = F.col("cluster_id")
    container = F.struct(F.lit("worker").alias("name"), F.lit("own:1").alias("image"))
    own = F.struct(F.lit(9).alias("replicas"), F.struct(F.array(container).alias("containers")).alias("spec"))
    requests = params.withColumns({
        "minimum": F.col("n_workers"), "maximum": F.col("n_workers") + 5, "group": F.lit("extra"),
        "custom": F.when(key % 6 == 0, own), "n_workers": F.col("n_workers") + 1,
    })
    columns = ["cluster_id", "kind", "child", "manifest"]
    rows = children.group_documents(requests, roles.WORDS, custom="custom").select(*columns).unionByName(
        children.autoscaler_documents(requests, roles.WORDS, "Autoscaler").select(*columns))
    size = F.coalesce(F.get_json_object("manifest", "$.spec.worker.replicas"), F.get_json_object("manifest", "$.spec.minimum"))
    word = roles.WORDS.label
    return rows.select("cluster_id", "kind", "child", size.alias("size"), *shown({
        "namespace": "metadata.namespace", "cluster": "spec.cluster", "image": "spec.worker.spec.containers[0].image",
        "component": f"metadata['{word('component')}']",
    }))


@query("o1_drift_paths", roles=("clusters",), sql=_CLUSTERS + """
    SELECT cluster_id, 'document.metadata.labels[tier]' AS path, tier AS expected, NULL AS actual FROM base WHERE cluster_id % 10 = 1
    UNION ALL SELECT cluster_id, 'document.metadata.labels[zone]', NULL, 'z' FROM base WHERE cluster_id % 10 = 1
    UNION ALL SELECT cluster_id, 'document.spec.worker.replicas', CAST(minimum AS VARCHAR), CAST(minimum + 1 AS VARCHAR)
              FROM base WHERE cluster_id % 10 = 2
    UNION ALL SELECT cluster_id, 'document.spec.worker.spec.containers[worker].image', image, 'other' FROM base WHERE cluster_id % 10 = 3""")
def drift_paths(spark, sf):
    """Clusters with changed labels, replicas and images, by path."""
    expected = roles.cluster_manifests(spark, sf).select("cluster_id", "document")
    key, doc = F.col("cluster_id"), F.col("document")
    worker = doc["spec"]["worker"]
    other = F.transform(worker["spec"]["containers"], lambda c: c.withField("image", F.lit("other")))
    labels = F.map_concat(F.map_filter(doc["metadata"]["labels"], lambda k, _: k != "tier"), F.create_map(F.lit("zone"), F.lit("z")))
    changed = doc.withField("metadata", F.when(key % 10 == 1, doc["metadata"].withField("labels", labels)).otherwise(doc["metadata"]))
    changed = changed.withField("spec", doc["spec"].withField("worker", F.when(key % 10 == 2, worker.withField("replicas", worker["replicas"] + 1))
                                .when(key % 10 == 3, worker.withField("spec", worker["spec"].withField("containers", other))).otherwise(worker)))
    return sets.drift_paths(expected, expected.select("cluster_id", changed.alias("document")), ["cluster_id"], ["document"])


# What the documents of each kind have to hold.
_TEXT, _COUNT, _ANY = {"type": "string"}, {"type": "integer", "minimum": 0}, {"type": "object"}
_TEXTS = {"type": "object", "additionalProperties": _TEXT}
_META = {"type": "object", "required": ["name"], "additionalProperties": True,
         "properties": {"name": {"type": "string", "pattern": "^[a-z0-9-]+$"}, "labels": _TEXTS, "annotations": _TEXTS}}
_CONTAINER = {"type": "object", "required": ["name"], "additionalProperties": True, "properties": {"name": _TEXT, "image": _TEXT}}
_POD = {"type": "object", "required": ["containers"], "properties": {"containers": {"type": "array", "items": _CONTAINER}}}
_WORKER = {"type": "object", "required": ["spec"], "properties": {"metadata": _ANY, "replicas": _COUNT, "spec": _POD}}
_SERVICE = {"type": "object", "properties": {
    "type": {"enum": ["ClusterIP", "NodePort", "LoadBalancer"]}, "selector": _TEXTS, "ports": {"type": "array", "items": _ANY}}}
_SCHEDULER = {"type": "object", "required": ["spec", "service"], "properties": {"metadata": _ANY, "spec": _POD, "service": _SERVICE}}


def _schema(required: list[str], **spec) -> dict:
    return {"type": "object", "required": ["metadata", "spec"], "properties": {
        "apiVersion": _TEXT, "kind": _TEXT, "metadata": _META, "status": _ANY,
        "spec": {"type": "object", "required": required, "properties": spec}}}


SCHEMAS = {
    "Cluster": _schema(["worker", "scheduler"], idleTimeout={"type": "integer"}, worker=_WORKER, scheduler=_SCHEDULER),
    "WorkerGroup": _schema(["cluster", "worker"], cluster=_TEXT, worker=_WORKER),
    "Autoscaler": _schema(["cluster", "minimum", "maximum"], cluster=_TEXT, minimum=_COUNT, maximum=_COUNT),
    "Pod": _schema(["containers"], **_POD["properties"]),
}


@query("f7_check_documents", roles=("clusters",), sql="""
    SELECT cluster_id, 'Autoscaler' AS kind, 'spec.maximum' AS path, 'missing' AS problem FROM clusters WHERE cluster_id % 7 = 0
    UNION ALL SELECT cluster_id, 'Autoscaler', 'spec.minimum', 'not of type integer' FROM clusters WHERE cluster_id % 9 = 0
    UNION ALL SELECT cluster_id, 'Autoscaler', 'spec.minimum', 'too small' FROM clusters WHERE cluster_id % 9 = 1
    UNION ALL SELECT cluster_id, 'Cluster', 'spec.scheduler.service.type', 'not one of the values' FROM clusters WHERE cluster_id % 5 = 0
    UNION ALL SELECT cluster_id, 'Cluster', 'spec.scheduler.service.typo', 'unknown' FROM clusters WHERE cluster_id % 4 = 0
    UNION ALL SELECT cluster_id, 'WorkerGroup', 'spec.worker.spec.containers[0].name', 'missing' FROM clusters
              WHERE cluster_id % 6 = 0 AND cluster_id % 11 <> 3
    UNION ALL SELECT cluster_id, 'WorkerGroup', '', 'not JSON' FROM clusters WHERE cluster_id % 11 = 3
    UNION ALL SELECT cluster_id, 'Pod', 'metadata.name', 'not of the form' FROM clusters WHERE cluster_id % 8 = 0
    UNION ALL SELECT cluster_id, 'Pod', 'extra', 'unknown' FROM clusters WHERE cluster_id % 8 = 1""")
def check_documents(spark, sf):
    """Documents of four kinds, of which some were damaged."""
    key = F.col("cluster_id")
    clusters = roles.cluster_manifests(spark, sf)
    doc = F.col("document")
    service = doc["spec"]["scheduler"]["service"]
    typed = service.withField("type", F.when(key % 5 == 0, "Other").otherwise(service["type"])).withField(
        "typo", F.when(key % 4 == 0, 1))
    changed = doc.withField("spec", doc["spec"].withField("scheduler", doc["spec"]["scheduler"].withField("service", typed)))
    container = F.struct(F.when(key % 6 != 0, "worker").alias("name"), F.lit("i:1").alias("image"))
    group = F.to_json(F.struct(
        F.struct(F.lit("g").alias("name")).alias("metadata"),
        F.struct(F.lit("c").alias("cluster"), F.struct(F.struct(F.array(container).alias("containers")).alias("spec")).alias("worker")).alias("spec")))
    low = F.when(key % 9 == 0, '"2"').when(key % 9 == 1, "-1").otherwise("2")
    high = F.when(key % 7 == 0, "null").otherwise("5")
    autoscaler = F.concat(F.lit('{"metadata":{"name":"a"},"spec":{"cluster":"c","minimum":'), low, F.lit(',"maximum":'), high, F.lit("}}"))
    pod = F.concat(
        F.lit('{"metadata":{"name":"'), F.when(key % 8 == 0, "Not A Name").otherwise("name"), F.lit('"},"spec":{"containers":[]}'),
        F.when(key % 8 == 1, ',"extra":{}').otherwise(""), F.lit("}"))
    texts = {"Cluster": F.to_json(changed), "WorkerGroup": F.when(key % 11 == 3, F.substring(group, 1, 20)).otherwise(group),
             "Autoscaler": autoscaler, "Pod": pod}
    rows = clusters.select(key, F.explode(F.array(*[
        F.struct(F.lit(k).alias("kind"), t.alias("body")) for k, t in texts.items()])).alias("d")).select("cluster_id", "d.*")
    return validate.check_documents(rows, ["cluster_id"], "body", F.col("kind"), SCHEMAS)
