"""Whole documents of the children that a resource stands for.

Every function takes resources with their document as a struct of whatever schema and adds
a row per child: its ``kind``, its name as ``child`` and its ``manifest`` as JSON. Parts
that the schema of the resource does not have, or that are null, are not in the child.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from musterroll.functions.documents import Value, merged, record, text, text_map, with_field
from musterroll.functions.labels import (
    RESERVED_ANNOTATION_PREFIXES,
    RESERVED_LABEL_PREFIXES,
    merge_layers,
    without_prefixes,
)
from musterroll.functions.manifests import Vocabulary, cluster_documents, scheduler_address
from musterroll.functions.names import default_group_name, runner_name, scheduler_name, worker_name

_NO_SIDECAR = {"sidecar.istio.io/inject": "false"}


def _column(value: Value | None, kind: str) -> Column:
    return value.column if value is not None else F.lit(None).cast(kind)


def _map(value: Value | None) -> Column:
    return _column(value, "map<string,string>").cast("map<string,string>")


class _Owner:
    """A resource's document and what its children inherit."""

    def __init__(self, rows: DataFrame, document: str, namespace: str, words: Vocabulary):
        self.doc, self.words = Value.of(rows, document), words
        self.name = _column(self.doc.at("metadata.name"), "string")
        self.namespace = F.col(namespace).cast("string")

    def labels(self, part: Value | None, component: str | None, cluster: Column, **more: Column) -> Column:
        """Own labels lose to those of the part, and both to the reserved ones."""
        word = self.words.label
        reserved = {word("cluster-name"): cluster}
        reserved |= {word(k.replace("_", "-")): v for k, v in more.items()}
        if component is not None:
            reserved[word("component")] = F.lit(component)
        if component in ("scheduler", "worker", "job-runner"):
            reserved |= {k: F.lit(v) for k, v in _NO_SIDECAR.items()}
        flat = [x for k, v in reserved.items() for x in (F.lit(k), v)]
        own = without_prefixes(_map(self.doc.at("metadata.labels")), RESERVED_LABEL_PREFIXES)
        return merge_layers(own, _map(part and part.at("metadata.labels")), F.create_map(*flat))

    def annotations(self, part: Value | None) -> Column:
        own = without_prefixes(_map(self.doc.at("metadata.annotations")), RESERVED_ANNOTATION_PREFIXES)
        return merge_layers(own, _map(part and part.at("metadata.annotations")))

    def reference(self) -> Value | None:
        """How a child names its owner; a resource without uid is not yet one."""
        uid = self.doc.at("metadata.uid")
        if uid is None:
            return None
        yes = Value(F.lit(True), T.BooleanType())
        one = record(
            controller=yes, blockOwnerDeletion=yes, apiVersion=self.doc.at("apiVersion"),
            kind=self.doc.at("kind"), name=text(self.name), uid=uid,
        )
        return Value(F.when(uid.column.isNotNull(), F.array(one.column)), T.ArrayType(one.kind))

    def metadata(self, name: Column, labels: Column, annotations: Column) -> Value:
        return record(
            name=text(name), namespace=text(self.namespace), labels=text_map(labels),
            annotations=text_map(annotations), ownerReferences=self.reference(),
        )


def _manifest(api: str, kind: str, metadata: Value, spec: Value | None) -> Column:
    made = record(apiVersion=text(api), kind=text(kind), metadata=metadata, spec=spec)
    return F.struct(
        F.lit(kind).alias("kind"), metadata.field("name").column.alias("child"), F.to_json(made.column).alias("manifest"))


def _deployment(metadata: Value, pod: Value | None) -> Column:
    spec = record(
        replicas=Value(F.lit(1), T.IntegerType()), selector=record(matchLabels=metadata.field("labels")),
        template=record(metadata=metadata, spec=pod),
    )
    return _manifest("apps/v1", "Deployment", metadata, spec)


def _with_env(pod: Value | None, defaults: dict[str, Column]) -> Value | None:
    """The pod with each default in every container that does not set that name."""
    containers = pod.field("containers") if pod is not None else None
    if containers is None:
        return pod
    items = [record(name=text(n), value=text(v)) for n, v in defaults.items()]
    env = Value(F.array(*[i.column for i in items]), T.ArrayType(items[0].kind))
    element = containers.kind.elementType
    of_type = merged(record(env=env), Value(F.lit(None).cast(element), element), whole=("env",)).kind
    filled = F.transform(containers.column, lambda c: merged(record(env=env), Value(c, element), whole=("env",)).column)
    return with_field(pod, "containers", Value(filled, T.ArrayType(of_type)))


def _exploded(rows: DataFrame, children: list[Column], *drop: str) -> DataFrame:
    made = rows.withColumn("_child", F.explode(F.array(*children))).drop(*drop)
    return made.select("*", "_child.*").drop("_child")


def cluster_children(
    clusters: DataFrame, words: Vocabulary, document: str = "document", namespace: str = "namespace"
) -> DataFrame:
    """Each cluster's scheduler deployment, scheduler service and default worker group."""
    own = _Owner(clusters, document, namespace, words)
    scheduler, worker = own.doc.at("spec.scheduler"), own.doc.at("spec.worker")
    notes = own.annotations(scheduler)
    on_pod = own.metadata(scheduler_name(own.name), own.labels(scheduler, "scheduler", own.name), notes)
    # The service is found by the scheduler's labels but has no sidecar to refuse.
    no_sidecar = F.map_filter(on_pod.field("labels").column, lambda k, _: ~k.isin(*_NO_SIDECAR))
    on_service = own.metadata(scheduler_name(own.name), no_sidecar, notes)
    on_group = own.metadata(
        default_group_name(own.name), own.labels(worker, "workergroup", own.name), own.annotations(worker))
    return _exploded(clusters, [
        _deployment(on_pod, scheduler and scheduler.field("spec")),
        _manifest("v1", "Service", on_service, scheduler and scheduler.field("service")),
        _manifest(words.api_version, words.group_kind, on_group, record(cluster=text(own.name), worker=worker)),
    ], document)


def job_children(
    jobs: DataFrame, words: Vocabulary, document: str = "document", namespace: str = "namespace"
) -> DataFrame:
    """Each job's cluster, named like the job, and its runner pod."""
    own = _Owner(jobs, document, namespace, words)
    cluster, job = own.doc.at("spec.cluster"), own.doc.at("spec.job")
    on_cluster = own.metadata(own.name, own.labels(cluster, None, own.name), own.annotations(cluster))
    on_runner = own.metadata(runner_name(own.name), own.labels(job, "job-runner", own.name), own.annotations(job))
    parts = record(worker=own.doc.at("spec.cluster.spec.worker"), scheduler=own.doc.at("spec.cluster.spec.scheduler"))
    address = {words.scheduler_address_env: scheduler_address(own.name, own.namespace)}
    return _exploded(jobs, [
        _manifest(words.api_version, words.cluster_kind, on_cluster, parts),
        _manifest("v1", "Pod", on_runner, _with_env(job and job.field("spec"), address)),
    ], document)


def worker_children(
    workers: DataFrame, words: Vocabulary, document: str = "document", namespace: str = "namespace",
    worker_id: str = "worker_id", cluster_labels: str | None = None,
) -> DataFrame:
    """The deployment of every worker: one row each, with the document of its group.

    Labels of the cluster fill in what the group's leave open.
    """
    own = _Owner(workers, document, namespace, words)
    worker, cluster = own.doc.at("spec.worker"), _column(own.doc.at("spec.cluster"), "string")
    labels = own.labels(worker, "worker", cluster, workergroup_name=own.name)
    if cluster_labels is not None:
        labels = merge_layers(F.col(cluster_labels), labels)
    name = worker_name(own.name, F.col(worker_id))
    pod = _with_env(worker and worker.field("spec"), {
        words.worker_name_env: name, words.scheduler_address_env: scheduler_address(cluster, own.namespace)})
    deployment = _deployment(own.metadata(name, labels, own.annotations(worker)), pod)
    return workers.select("*", deployment.alias("_child")).drop(document).select("*", "_child.*").drop("_child")


def group_documents(
    requests: DataFrame, words: Vocabulary, group: str = "group", custom: str | None = None,
    namespace: str = "namespace",
) -> DataFrame:
    """The worker group that a client adds to a cluster, as ``child`` and ``manifest``.

    ``requests`` has the parameters of ``cluster_documents``, those of the request where it
    names them and the cluster's otherwise, and the new group's name. A ready worker part in
    the column ``custom`` takes the place of the one made of them.
    """
    made = cluster_documents(requests, words)
    name = F.concat("name", F.lit("-"), group)
    head = record(name=text(name), namespace=text(F.col(namespace).cast("string")))

    def manifest(worker: Value) -> Column:
        return _manifest(words.api_version, words.group_kind, head, record(cluster=text(F.col("name")), worker=worker))

    child = manifest(Value.of(made, "document").at("spec.worker"))
    if custom is not None:
        ready = Value.of(requests, custom)
        child = F.when(ready.column.isNotNull(), manifest(ready)).otherwise(child)
    return made.withColumn("_child", child).drop("document").select("*", "_child.*").drop("_child")


def autoscaler_documents(requests: DataFrame, words: Vocabulary, kind: str, namespace: str = "namespace") -> DataFrame:
    """The autoscaler of a cluster between ``minimum`` and ``maximum`` workers."""
    metadata = record(**{
        "name": text(F.col("name")), "namespace": text(F.col(namespace).cast("string")),
        words.label("cluster-name"): text(F.col("name")), words.label("component"): text("autoscaler"),
    })
    bounds = {c: Value.of(requests, c) for c in ("minimum", "maximum")}
    child = _manifest(words.api_version, kind, metadata, record(cluster=text(F.col("name")), **bounds))
    return requests.select("*", child.alias("_child")).select("*", "_child.*").drop("_child")
