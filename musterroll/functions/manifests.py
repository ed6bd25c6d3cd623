"""Cluster manifests: building them from flat parameters and flattening them again."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from musterroll.functions.labels import env_to_list
from musterroll.functions.names import scheduler_name


@dataclass(frozen=True)
class Vocabulary:
    """Names that belong to one operator installation; pass those of yours."""

    domain: str
    api_version: str
    cluster_kind: str
    group_kind: str
    worker_name_env: str
    scheduler_address_env: str
    scheduler_command: str

    def label(self, name: str) -> str:
        return f"{self.domain}/{name}"


# Ports, flags and probe times of the generated manifests.
COMM_PORT = 8786
DASHBOARD_PORT = 8787
WORKER_DASHBOARD_PORT = 8788
JUPYTER_FLAG = "--jupyter"


def _literals(*values: str) -> Column:
    return F.array(*[F.lit(v) for v in values])


def _port(name: str, number: int) -> Column:
    return F.struct(
        F.lit(name).alias("name"),
        F.lit(number).alias("containerPort"),
        F.lit("TCP").alias("protocol"),
    )


def _service_port(name: str, number: int) -> Column:
    return F.struct(
        F.lit(name).alias("name"),
        F.lit("TCP").alias("protocol"),
        F.lit(number).alias("port"),
        F.lit(name).alias("targetPort"),
    )


def _probe(**seconds: int) -> Column:
    get = F.struct(F.lit("http-dashboard").alias("port"), F.lit("/health").alias("path"))
    return F.struct(get.alias("httpGet"), *[F.lit(v).alias(k) for k, v in seconds.items()])


def cluster_documents(params: DataFrame, words: Vocabulary) -> DataFrame:
    """One nested cluster manifest per parameter row, beside the row's own columns.

    Expects ``name, image, n_workers, resources, env, worker_command,
    scheduler_service_type, idle_timeout, jupyter``. ``env`` is a map or a ready list of
    names and values; the worker command is a list, or a text that is split at single
    spaces.
    """
    name = F.col("name")

    def is_list(column: str) -> bool:
        return isinstance(params.schema[column].dataType, T.ArrayType)

    command = F.col("worker_command")
    command = command if is_list("worker_command") else F.split(command, " ")
    env = F.col("env") if is_list("env") else env_to_list(F.col("env"))
    common = {"image": F.col("image"), "env": env, "resources": F.col("resources")}

    def container(title: str, args: Column, ports: Column, *more: Column) -> Column:
        return F.struct(
            F.lit(title).alias("name"), common["image"].alias("image"), args.alias("args"),
            common["env"].alias("env"), common["resources"].alias("resources"),
            ports.alias("ports"), *more,
        )

    worker_args = F.concat(
        command,
        _literals("--name", f"$({words.worker_name_env})", "--dashboard",
                  "--dashboard-address", str(WORKER_DASHBOARD_PORT)),
    )
    start = _literals(words.scheduler_command, "--host", "0.0.0.0")
    scheduler_args = F.when(
        F.col("jupyter"), F.concat(start, _literals(JUPYTER_FLAG))
    ).otherwise(start)
    worker = F.struct(
        F.col("n_workers").alias("replicas"),
        F.struct(F.array(container(
            "worker", worker_args, F.array(_port("http-dashboard", WORKER_DASHBOARD_PORT))
        )).alias("containers")).alias("spec"),
    )
    scheduler = F.struct(
        F.struct(F.array(container(
            "scheduler", scheduler_args,
            F.array(_port("tcp-comm", COMM_PORT), _port("http-dashboard", DASHBOARD_PORT)),
            _probe(initialDelaySeconds=0, periodSeconds=1,
                   timeoutSeconds=300).alias("readinessProbe"),
            _probe(initialDelaySeconds=15, periodSeconds=20).alias("livenessProbe"),
        )).alias("containers")).alias("spec"),
        F.struct(
            F.col("scheduler_service_type").alias("type"),
            F.create_map(
                F.lit(words.label("cluster-name")), name,
                F.lit(words.label("component")), F.lit("scheduler"),
            ).alias("selector"),
            F.array(_service_port("tcp-comm", COMM_PORT),
                    _service_port("http-dashboard", DASHBOARD_PORT)).alias("ports"),
        ).alias("service"),
    )
    return params.withColumn("document", F.struct(
        F.lit(words.api_version).alias("apiVersion"),
        F.lit(words.cluster_kind).alias("kind"),
        F.struct(name.alias("name")).alias("metadata"),
        F.struct(F.col("idle_timeout").alias("idleTimeout"), worker.alias("worker"),
                 scheduler.alias("scheduler")).alias("spec"),
    ))


def scheduler_address(cluster: Column, namespace: Column) -> Column:
    """Address the injected environment gives to workers and runners."""
    return F.concat(
        F.lit("tcp://"), scheduler_name(cluster), F.lit("."), namespace,
        F.lit(f".svc.cluster.local:{COMM_PORT}"),
    )


def flatten_manifest(df: DataFrame, document: str = "document") -> DataFrame:
    """First worker container and scheduler flags of a manifest as flat columns."""
    spec = F.col(document)["spec"]
    first = F.try_element_at(spec["worker"]["spec"]["containers"], F.lit(1))
    scheduler = F.try_element_at(spec["scheduler"]["spec"]["containers"], F.lit(1))
    no_env = F.array().cast("array<struct<name:string,value:string>>")
    return df.withColumns({
        "image": first["image"],
        "resources": first["resources"],
        "env": F.coalesce(first["env"], no_env),
        "n_workers": spec["worker"]["replicas"],
        "jupyter": F.coalesce(F.array_contains(scheduler["args"], JUPYTER_FLAG), F.lit(False)),
    })
