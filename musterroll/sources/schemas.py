"""Explicit schemas of the resource kinds; nothing is inferred from the files."""

from __future__ import annotations

from pyspark.sql import types as T

_LABELS = "MAP<STRING, STRING>"
_META = f"STRUCT<labels: {_LABELS}, annotations: {_LABELS}>"
_POD = (
    "STRUCT<containers: ARRAY<STRUCT<name: STRING, image: STRING, imagePullPolicy: STRING,"
    " args: ARRAY<STRING>, env: ARRAY<STRUCT<name: STRING, value: STRING>>,"
    " resources: MAP<STRING, MAP<STRING, STRING>>,"
    " ports: ARRAY<STRUCT<name: STRING, containerPort: INT, protocol: STRING>>>>,"
    " restartPolicy: STRING>"
)
_SERVICE = (
    f"STRUCT<type: STRING, selector: {_LABELS}, ports: ARRAY<STRUCT<name: STRING,"
    " protocol: STRING, port: INT, targetPort: STRING, nodePort: INT>>>"
)
_CLUSTER_SPEC = (
    f"STRUCT<worker: STRUCT<replicas: INT, metadata: {_META}, spec: {_POD}>,"
    f" scheduler: STRUCT<metadata: {_META}, spec: {_POD}, service: {_SERVICE}>,"
    " idleTimeout: INT>"
)
_METADATA = (
    "metadata STRUCT<name: STRING, namespace: STRING, creationTimestamp: TIMESTAMP,"
    f" labels: {_LABELS}, annotations: {_LABELS}>"
)
_PHASE = "status STRUCT<phase: STRING>"

_DDL = {
    "cluster": f"{_METADATA}, spec {_CLUSTER_SPEC}, {_PHASE}",
    "workergroup": (
        f"{_METADATA}, spec STRUCT<cluster: STRING, worker: STRUCT<replicas: INT,"
        f" metadata: {_META}, spec: {_POD}>>, {_PHASE}"
    ),
    "job": (
        f"{_METADATA}, spec STRUCT<job: STRUCT<metadata: {_META}, spec: {_POD}>,"
        f" cluster: STRUCT<metadata: {_META}, spec: {_CLUSTER_SPEC}>>,"
        " status STRUCT<clusterName: STRING, jobRunnerPodName: STRING, jobStatus: STRING,"
        " startTime: TIMESTAMP, endTime: TIMESTAMP>"
    ),
    "autoscaler": f"{_METADATA}, spec STRUCT<cluster: STRING, minimum: INT, maximum: INT>, {_PHASE}",
}


def schema_of(kind: str) -> T.StructType:
    """Schema of one resource kind: cluster, workergroup, job or autoscaler."""
    return T.StructType.fromDDL(_DDL[kind])
