"""Joins between parents, children, requests, rules and services.

Equi joins carry no hints: adaptive execution broadcasts a side it has measured and
splits skewed partitions of the others. Where only a count or one value per key is
needed, children are aggregated before the join.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from musterroll.functions.clock import shifted
from musterroll.functions.names import named_port
from musterroll.functions.phases import service_phase
from musterroll.operators.heat import HOT_ROWS, with_latest
from musterroll.operators.rollup import count_members


def owner_of(children: DataFrame, parents: DataFrame, key: list[str]) -> DataFrame:
    """Each child with its owner's columns; children of a deleted owner drop out."""
    return children.join(parents, key, "inner")


def orphans(children: DataFrame, parents: DataFrame, key: list[str]) -> DataFrame:
    """Children that have no owner."""
    return children.join(parents.select(*key), key, "left_anti")


def members_of(
    parents: DataFrame, children: DataFrame, on_labels: dict[str, str], labels: str = "labels"
) -> DataFrame:
    """Children whose labels all equal the parent's columns.

    ``on_labels`` maps a label key of the child to a column of the parent. The labels
    become join columns, so this is an equi join.
    """
    keyed = children.withColumns({f"_on_{c}": F.col(labels)[k] for k, c in on_labels.items()})
    pairs = [parents[c].cast("string") == keyed[f"_on_{c}"] for c in on_labels.values()]
    return parents.join(keyed, reduce(lambda a, b: a & b, pairs)).drop(
        *[f"_on_{c}" for c in on_labels.values()]
    )


def exactly_one(parents: DataFrame, children: DataFrame, key: list[str]) -> DataFrame:
    """Parents without exactly one child, with the count and the problem."""
    counted = parents.select(*key).join(count_members(children, key, "found"), key, "left")
    n = F.coalesce("found", F.lit(0).cast("long"))
    return (
        counted.withColumn("found", n)
        .where(F.col("found") != 1)
        .withColumn("problem", F.when(F.col("found") < 1, "not found").otherwise("several"))
    )


def propagate_status(
    services: DataFrame, clusters: DataFrame, key: list[str], order: list[str]
) -> DataFrame:
    """The phase of each cluster after its latest service status, if it has any.

    Services are reduced to the last one per cluster before the join.
    """
    reported = services.groupBy(*key).agg(
        F.max_by(service_phase(F.col("service_type"), F.col("ingress")), F.struct(*order))
        .alias("_reported")
    )
    joined = clusters.join(reported, key, "left")
    return joined.withColumn("phase", F.coalesce("_reported", "phase")).drop("_reported")


def reconcile(
    desired: DataFrame, actual: DataFrame, key: list[str], replicas: str = "desired"
) -> DataFrame:
    """Workers missing or surplus per group, and the action that follows.

    Members are counted before the join, so the join is the size of the groups. A
    group without members counts zero.
    """
    joined = desired.join(count_members(actual, key, "current"), key, "left")
    return (
        joined.withColumn("current", F.coalesce("current", F.lit(0).cast("long")))
        .withColumn("needed", F.col(replicas) - F.col("current"))
        .withColumn(
            "action",
            F.when(F.col("needed") > 0, "up").when(F.col("needed") < 0, "down").otherwise("none"),
        )
    )


def state_at(
    ticks: DataFrame,
    changes: DataFrame,
    key: list[str],
    ts: str,
    tie: str,
    columns: list[str],
    hot_rows: int | None = HOT_ROWS,
) -> DataFrame:
    """Latest non-null value of each column at every tick, an as-of join.

    A change at the tick's own time is visible; changes at one time apply in the
    order of ``tie``. One shuffle on the key, with hot keys cut by time.
    """
    nothing = {c: F.lit(None).cast(changes.schema[c].dataType) for c in columns}
    order = [ts, "_is_tick", "_tie"]
    marked = changes.select(
        *key, ts, F.lit(False).alias("_is_tick"), F.col(tie).alias("_tie"), *columns
    ).unionByName(
        ticks.select(
            *key, ts, F.lit(True).alias("_is_tick"),
            F.lit(None).cast(changes.schema[tie].dataType).alias("_tie"),
            *[v.alias(c) for c, v in nothing.items()],
        )
    )
    carried = with_latest(
        marked, key, order, {f"_at_{c}": c for c in columns}, hot_rows=hot_rows
    )
    return carried.where("_is_tick").select(
        *key, ts, *[F.col(f"_at_{c}").alias(c) for c in columns]
    )


def ready_within(
    created: DataFrame,
    ready: DataFrame,
    key: list[str],
    ts: str,
    seq: str,
    timeout: int,
    hot_rows: int | None = HOT_ROWS,
) -> DataFrame:
    """First ready time in ``[created, created + timeout)`` per creation, or timed out.

    Only the next ready event matters, so this looks ahead once instead of joining
    every creation with every ready event of its key.
    """
    marked = created.select(
        *key, F.col(seq).alias("_seq"), ts, F.lit(0).alias("_rank"),
        F.lit(None).cast(ready.schema[ts].dataType).alias("_ready"),
    ).unionByName(
        ready.select(
            *key, F.col(seq).alias("_seq"), ts, F.lit(1).alias("_rank"),
            F.col(ts).alias("_ready"),
        )
    )
    ahead = with_latest(
        marked, key, [ts, "_rank", "_seq"], {"_next": "_ready"}, descending=True,
        hot_rows=hot_rows,
    ).where(F.col("_rank") == 0)
    in_time = F.coalesce(F.col("_next") < shifted(ts, timeout), F.lit(False))
    return ahead.select(
        *key, F.col("_seq").alias(seq), ts,
        F.when(in_time, F.col("_next")).alias("ready_ts"),
        F.when(in_time, "ready").otherwise("timed_out").alias("outcome"),
    )


def connect_plan(
    requests: DataFrame, existing: DataFrame, key: list[str], mode: str = "mode",
    shutdown: str = "shutdown_on_close",
) -> DataFrame:
    """What each request does, given whether its cluster exists.

    A null shutdown choice becomes true for a created and false for a connected cluster.
    """
    found = existing.select(*key).distinct().withColumn("_exists", F.lit(True))
    plan = (
        F.when(F.col("_exists") & (F.col(mode) == "CREATE_ONLY"), "error_exists")
        .when(F.col("_exists"), "connect")
        .when(F.col(mode) == "CONNECT_ONLY", "error_missing")
        .otherwise("create")
    )
    joined = requests.join(found, key, "left").withColumn(
        "_exists", F.coalesce("_exists", F.lit(False))
    )
    usual = F.when(F.col("plan") == "create", True).when(F.col("plan") == "connect", False)
    return (
        joined.withColumn("plan", plan)
        .withColumn(shutdown, F.coalesce(shutdown, usual))
        .drop("_exists")
    )


def resolve_endpoint(
    services: DataFrame, nodes: DataFrame, fleet: str, node_id: str, port_name: str
) -> DataFrame:
    """``tcp://host:port`` of each service, by its type.

    A load balancer uses its first ingress (hostname, else ip), a node port the lowest
    node of its fleet, a cluster service its own name. ``services`` needs ``name,
    namespace, type, ingress, ports``; ``nodes`` needs ``address``.
    """
    first = nodes.groupBy(fleet).agg(F.min_by("address", node_id).alias("_node"))
    ingress = F.try_element_at("ingress", F.lit(1))
    host = (
        F.when(F.col("type") == "LoadBalancer", F.coalesce(ingress["hostname"], ingress["ip"]))
        .when(F.col("type") == "NodePort", F.col("_node"))
        .when(F.col("type") == "ClusterIP", F.concat("name", F.lit("."), "namespace"))
    )
    port = F.when(
        F.col("type") == "NodePort", named_port(F.col("ports"), F.col("name"), port_name, True)
    ).otherwise(named_port(F.col("ports"), F.col("name"), port_name))["port"]
    joined = services.join(first, fleet, "left").withColumns({"_host": host, "_port": port})
    endpoint = F.concat(F.lit("tcp://"), "_host", F.lit(":"), "_port")
    return joined.withColumn("endpoint", endpoint).drop("_host", "_port", "_node")
