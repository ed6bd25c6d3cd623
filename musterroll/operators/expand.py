"""One resource row to the rows it stands for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from musterroll.functions.clock import shifted
from musterroll.functions.counting import numbered_rows
from musterroll.functions.labels import (
    RESERVED_ANNOTATION_PREFIXES,
    RESERVED_LABEL_PREFIXES,
    merge_layers,
    without_prefixes,
)
from musterroll.functions.manifests import Vocabulary
from musterroll.functions.names import (
    default_group_name,
    runner_name,
    scheduler_name,
    worker_name,
)


def _labels(entries: dict[str, Column]) -> Column:
    flat = [part for key, value in entries.items() for part in (F.lit(key), value)]
    return F.create_map(*flat)


def _child(kind: str, name: Column, labels: Column, annotations: Column) -> Column:
    return F.struct(
        F.lit(kind).alias("kind"), name.alias("name"), labels.alias("labels"),
        annotations.alias("annotations"),
    )


def _inherited(own: str, part: str | None, prefixes: tuple[str, ...]) -> Column:
    kept = without_prefixes(F.col(own), prefixes)
    return merge_layers(kept, F.col(part)) if part else merge_layers(kept)


def _exploded(owners: DataFrame, children: Column) -> DataFrame:
    """One row per child, with the owner's other columns."""
    own = [c for c in owners.columns if c.endswith(("labels", "annotations")) or c == "name"]
    rows = owners.withColumn("_child", F.explode(children)).drop(*own)
    return rows.select("*", "_child.*").drop("_child")


def expand_resources(manifests: DataFrame, words: Vocabulary) -> DataFrame:
    """Each cluster to its scheduler deployment, its service and its default group.

    Expects ``name, labels, annotations`` and the same maps of both parts as
    ``scheduler_labels, scheduler_annotations, worker_labels, worker_annotations``.
    Own labels lose to those of the part, and both lose to the reserved ones.
    """
    cluster = {words.label("cluster-name"): F.col("name")}
    on_scheduler = {**cluster, words.label("component"): F.lit("scheduler")}
    on_group = {**cluster, words.label("component"): F.lit("workergroup")}
    no_sidecar = {"sidecar.istio.io/inject": F.lit("false")}
    # Maps that several children share are columns, so each is built once.
    shared = manifests.withColumns({
        "_scheduler_labels": _inherited("labels", "scheduler_labels", RESERVED_LABEL_PREFIXES),
        "_worker_labels": _inherited("labels", "worker_labels", RESERVED_LABEL_PREFIXES),
        "_scheduler_annotations": _inherited(
            "annotations", "scheduler_annotations", RESERVED_ANNOTATION_PREFIXES),
        "_worker_annotations": _inherited(
            "annotations", "worker_annotations", RESERVED_ANNOTATION_PREFIXES),
    })
    scheduler, notes = F.col("_scheduler_labels"), F.col("_scheduler_annotations")
    children = F.array(
        _child("Deployment", scheduler_name("name"),
               merge_layers(scheduler, _labels({**on_scheduler, **no_sidecar})), notes),
        _child("Service", scheduler_name("name"),
               merge_layers(scheduler, _labels(on_scheduler)), notes),
        _child(words.group_kind, default_group_name("name"),
               merge_layers(F.col("_worker_labels"), _labels(on_group)), F.col("_worker_annotations")),
    )
    return _exploded(shared, children)


def expand_jobs(jobs: DataFrame, words: Vocabulary) -> DataFrame:
    """Each job to its cluster and its runner pod; the cluster is named like the job.

    Expects ``name, labels, annotations`` and ``cluster_labels, cluster_annotations,
    job_labels, job_annotations`` of both parts.
    """
    cluster = {words.label("cluster-name"): F.col("name")}
    on_runner = {
        **cluster,
        words.label("component"): F.lit("job-runner"),
        "sidecar.istio.io/inject": F.lit("false"),
    }
    children = F.array(
        _child(words.cluster_kind, F.col("name"),
               merge_layers(_inherited("labels", "cluster_labels", RESERVED_LABEL_PREFIXES),
                            _labels(cluster)),
               _inherited("annotations", "cluster_annotations", RESERVED_ANNOTATION_PREFIXES)),
        _child("Pod", runner_name("name"),
               merge_layers(_inherited("labels", "job_labels", RESERVED_LABEL_PREFIXES),
                            _labels(on_runner)),
               _inherited("annotations", "job_annotations", RESERVED_ANNOTATION_PREFIXES)),
    )
    return _exploded(jobs, children)


def expand_workers(
    groups: DataFrame, group: str, needed: str = "needed", last_ordinal: str = "last_ordinal"
) -> DataFrame:
    """One row per worker to create, with an id and a name that are the same every run.

    Ordinals continue after ``last_ordinal``, the highest one that the group has ever used
    (null: none), so no name meets that of a live worker, whichever ones were deleted.
    The id is 64 bits of a digest of group and ordinal.
    """
    rows = numbered_rows(groups, [group], F.col(needed), "_i")
    ordinal = F.coalesce(F.col(last_ordinal), F.lit(0)) + F.col("_i") + 1
    name = F.col(group).cast("string")
    digest = F.sha2(F.concat_ws(":", name, ordinal.cast("string")), 256)
    return (
        rows.withColumn("ordinal", ordinal)
        .withColumn("worker_id", F.substring(digest, 1, 16))
        .withColumn("worker_name", worker_name(name, F.col("worker_id")))
        .drop("_i")
    )


def worker_labels(
    words: Vocabulary, cluster: Column, group: Column, group_labels: Column, part_labels: Column,
    cluster_labels: Column,
) -> Column:
    """Labels of a group's worker deployments.

    Those of the cluster fill in what is missing; those of the group lose to those of its
    worker part, and all lose to the reserved ones.
    """
    reserved = {
        words.label("cluster-name"): cluster,
        words.label("workergroup-name"): group,
        words.label("component"): F.lit("worker"),
        "sidecar.istio.io/inject": F.lit("false"),
    }
    own = without_prefixes(group_labels, RESERVED_LABEL_PREFIXES)
    return merge_layers(cluster_labels, own, part_labels, _labels(reserved))


def creation_waves(
    groups: DataFrame, group: str, needed: str, start: str, batch_size: int | None, delay: int
) -> DataFrame:
    """Creations in waves of ``batch_size``, ``delay`` seconds apart.

    One row per wave with its size. Without a batch size everything is one wave.
    """
    batch = F.lit(batch_size).cast("long") if batch_size else F.col(needed).cast("long")
    waves = F.when(F.col(needed) > 0, F.ceil(F.col(needed) / batch)).otherwise(0)
    rows = numbered_rows(groups, [group], waves, "_wave")
    left = F.col(needed) - F.col("_wave") * batch
    return (
        rows.withColumn("wave_size", F.least(batch, left))
        .withColumn("wave_at", shifted(start, F.col("_wave") * delay))
        .withColumn("wave", F.col("_wave") + 1)
        .drop("_wave")
    )
