"""The roles the given tables play: the only place that knows their names.

A customer is a cluster, an order a worker group, a line item a worker, an event a
change seen on the watch feed, and so on. Every role column is an expression.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from musterroll.functions.manifests import Vocabulary, cluster_documents
from musterroll.functions.phases import lookup

WORDS = Vocabulary(
    domain="fleet.example",
    api_version="fleet.example/v1",
    cluster_kind="Cluster",
    group_kind="WorkerGroup",
    worker_name_env="WORKER_NAME",
    scheduler_address_env="SCHEDULER_ADDRESS",
    scheduler_command="fleet-scheduler",
)
EVENT_PHASE = {
    "signup": "Created",
    "view": "Pending",
    "click": "Running",
    "purchase": "Succeeded",
    "error": "Failed",
}
ORDER_PHASE = {"P": "Pending", "O": "Running", "F": "Failed"}
WAITING = {"N": "CrashLoopBackOff", "R": "ImagePullBackOff"}
HOUR = 3600
COOLDOWN = 6 * HOUR
READY_TIMEOUT = 6 * HOUR


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def clusters(spark, sf) -> DataFrame:
    key = F.col("c_custkey")
    return table(spark, sf, "customer").select(
        key.alias("cluster_id"),
        F.col("c_name").alias("name"),
        F.col("c_nationkey").alias("namespace"),
        F.col("c_mktsegment").alias("segment"),
        F.col("c_acctbal").alias("balance"),
        (key % 5).cast("int").alias("minimum"),
        (key % 30 + 20).cast("int").alias("maximum"),
        (key % 4 * (6 * HOUR)).cast("int").alias("idle_timeout_s"),
    )


def live_clusters(spark, sf) -> DataFrame:
    return clusters(spark, sf).where(F.col("balance") >= 0)


def worker_groups(spark, sf) -> DataFrame:
    key = F.col("o_orderkey")
    return table(spark, sf, "orders").select(
        key.alias("group_id"),
        F.col("o_custkey").alias("cluster_id"),
        F.col("o_orderdate").alias("created"),
        lookup(F.col("o_orderstatus"), ORDER_PHASE).alias("phase"),
        (key % 6 + 1).cast("int").alias("desired"),
        F.col("o_orderpriority").alias("component"),
        F.when(key % 3 == 0, "LoadBalancer").when(key % 3 == 1, "NodePort")
        .otherwise("ClusterIP").alias("service_type"),
    )


def workers(spark, sf) -> DataFrame:
    """No key is unique here, so an order over workers names every column."""
    return table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("group_id"),
        F.col("l_shipdate").alias("created"),
        F.col("l_partkey").alias("part"),
        F.col("l_suppkey").alias("supplier"),
        F.col("l_linenumber").alias("line"),
        F.col("l_quantity").alias("quantity"),
        F.col("l_extendedprice").alias("price"),
        F.col("l_discount").alias("discount"),
        F.col("l_tax").alias("tax"),
        lookup(F.col("l_returnflag"), WAITING).alias("waiting_reason"),
        (F.col("l_linestatus") == "F").alias("ready"),
    )


WORKER_ORDER = [
    "created", "part", "supplier", "line", "quantity", "price", "discount", "tax",
    "waiting_reason", "ready",
]


def watch_columns(events: DataFrame) -> DataFrame:
    """Watch columns from event rows, batch or stream."""
    return events.select(
        F.col("user_id").alias("key"),
        F.col("event_id").alias("seq"),
        "ts",
        "event_type",
        lookup(F.col("event_type"), EVENT_PHASE).alias("phase"),
        F.floor(F.col("value") / 10).cast("int").alias("target"),
        F.col("props").alias("patch"),
    )


def watch(spark, sf) -> DataFrame:
    return watch_columns(table(spark, sf, "events"))


def watch_clusters(spark, sf) -> DataFrame:
    return clusters(spark, sf).withColumnRenamed("cluster_id", "key")


def pods(spark, sf) -> DataFrame:
    """A pod per worker, with none to three containers, each perhaps waiting."""
    reason = lambda i: F.when((F.col("part") + i) % 3 == 1, "CrashLoopBackOff").when(
        (F.col("part") + i) % 3 == 2, "ImagePullBackOff"
    )
    numbers = F.filter(F.sequence(F.lit(0), F.lit(2)), lambda i: i < F.col("line") % 4)
    return workers(spark, sf).select(
        "group_id", "part", "supplier", "line", "created",
        F.when(F.col("quantity") <= 40, "Running").otherwise("Pending").alias("phase"),
        "ready",
        F.transform(numbers, lambda i: F.struct(reason(i).alias("waiting_reason"))).alias(
            "containers"
        ),
    )


def services(spark, sf) -> DataFrame:
    """Scheduler services of the worker groups, some without an ingress."""
    key = F.col("group_id")
    entry = F.struct(F.format_string("10.0.0.%d", key % 250).alias("ip"))
    ingress = F.when(key % 4 == 0, F.array().cast("array<struct<ip:string>>")).when(
        key % 4 != 1, F.array(entry)
    )
    return worker_groups(spark, sf).select(
        "group_id", "cluster_id", "created", "service_type", ingress.alias("ingress")
    )


def edges(spark, sf) -> DataFrame:
    """Fleet to namespace to cluster to group; ids carry their level."""

    def pair(name: str, parent: str, p: str, child: str, c: str) -> DataFrame:
        return table(spark, sf, name).select(
            F.concat(F.lit(p), F.col(parent)).alias("parent_id"),
            F.concat(F.lit(c), F.col(child)).alias("child_id"),
        )

    return (
        pair("nation", "n_regionkey", "r", "n_nationkey", "n")
        .unionByName(pair("customer", "c_nationkey", "n", "c_custkey", "c"))
        .unionByName(pair("orders", "o_custkey", "c", "o_orderkey", "o"))
    )


def names(spark, sf) -> DataFrame:
    """Candidate names: raw ones are invalid, cleaned ones valid, repeated ones too long."""
    part, document = table(spark, sf, "part"), table(spark, sf, "documents")
    customer = table(spark, sf, "customer")

    def rows(df: DataFrame, origin: str, key: str, name) -> DataFrame:
        return df.select(
            F.lit(origin).alias("origin"), F.col(key).alias("id"), name.alias("name")
        )

    clean = F.replace(F.lower("c_name"), F.lit("#"), F.lit("-"))
    parts = [
        rows(part, "part", "p_partkey", F.col("p_name")),
        rows(part, "part-clean", "p_partkey", F.replace("p_name", F.lit(" "), F.lit("-"))),
        rows(document, "source", "doc_id", F.col("source")),
        rows(document, "source-long", "doc_id", F.repeat("source", 15)),
        rows(customer, "customer", "c_custkey", F.col("c_name")),
        rows(customer, "customer-clean", "c_custkey", clean),
    ]
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    return out


def addresses(spark, sf) -> DataFrame:
    """Page addresses; even pages get a port after the host."""
    port = F.concat(F.lit("$1:"), (F.col("page_id") % 10 + 8000).cast("string"))
    with_port = F.regexp_replace(F.col("url"), F.lit("(://[^/]+)"), port)
    return table(spark, sf, "pages").select(
        "page_id",
        F.when(F.col("page_id") % 2 == 0, with_port).otherwise(F.col("url")).alias("address"),
    )


def log_lines(spark, sf) -> DataFrame:
    return table(spark, sf, "conversations").select(
        F.col("conv_id").alias("pod"), F.col("turn").alias("line_no"), F.col("text").alias("line")
    )


def log_pods(spark, sf) -> DataFrame:
    pod = F.col("pod")
    kind = (
        F.when(pod % 4 == 0, "scheduler").when(pod % 4 == 3, "runner").otherwise("worker")
    )
    return log_lines(spark, sf).select("pod").distinct().select(
        pod,
        F.concat(F.lit("pod-"), pod, F.lit("-"), kind).alias("name"),
        F.when(pod % 3 == 0, "Running").when(pod % 3 == 1, "Pending").otherwise("Failed")
        .alias("phase"),
    )


def cluster_params(spark, sf) -> DataFrame:
    """Flat settings of a cluster, as a client passes them."""
    key = F.col("cluster_id")
    return clusters(spark, sf).select(
        "cluster_id", "namespace",
        F.replace(F.lower("name"), F.lit("#"), F.lit("-")).alias("name"),
        F.concat(F.lit("registry.example/"), F.lower("segment"), F.lit(":latest")).alias("image"),
        F.col("minimum").alias("n_workers"),
        F.when(key % 3 != 0, F.create_map(F.lit("limits"), F.create_map(
            F.lit("memory"), F.concat(key % 8 + 1, F.lit("Gi"))))).alias("resources"),
        F.when(key % 4 != 0, F.create_map(F.lit("SEGMENT"), F.col("segment"))).alias("env"),
        F.when(key % 2 == 0, "fleet-worker").otherwise("fleet-cuda-worker --nthreads 4")
        .alias("worker_command"),
        F.when(key % 5 == 0, "LoadBalancer").otherwise("ClusterIP")
        .alias("scheduler_service_type"),
        F.col("idle_timeout_s").alias("idle_timeout"),
        (key % 7 == 0).alias("jupyter"),
    )


def _label_maps(key, segment) -> dict:
    return {
        "labels": F.create_map(
            F.lit("segment"), segment, F.lit("tier"), F.concat(F.lit("t"), key % 3)),
        "annotations": F.create_map(
            F.lit("note"), F.concat(F.lit("n"), key % 10),
            F.lit("kopf.zalando.org/foobar"), F.lit("x"),
            F.lit("kubectl.kubernetes.io"), F.lit("y"),
        ),
        "scheduler_labels": F.create_map(F.lit("tier"), F.lit("scheduler")),
        "scheduler_annotations": F.create_map(F.lit("probe"), F.lit("on")),
        "worker_labels": F.when(key % 2 == 0, F.create_map(
            F.lit(WORDS.label("cluster-name")), F.lit("mine"), F.lit("pool"), F.lit("p")
        )),
        "worker_annotations": F.lit(None).cast("map<string,string>"),
    }


def cluster_labels(spark, sf) -> DataFrame:
    """Clusters with the label and annotation maps of the object and of both parts."""
    key = F.col("cluster_id")
    named = clusters(spark, sf).withColumn(
        "name", F.replace(F.lower("name"), F.lit("#"), F.lit("-"))
    )
    return named.select(
        "cluster_id", "name",
        *[value.alias(name) for name, value in _label_maps(key, F.col("segment")).items()],
    )


def cluster_manifests(spark, sf) -> DataFrame:
    """Whole cluster documents with labels, notes and metadata of both parts."""
    params = cluster_params(spark, sf).withColumn("namespace", F.concat(F.lit("ns-"), "namespace"))
    key = F.col("cluster_id")
    segment = F.substring_index(F.substring_index("image", "/", -1), ":", 1)
    made = cluster_documents(params, WORDS).withColumns(_label_maps(key, segment))
    part = lambda p: F.struct(F.col(f"{p}_labels").alias("labels"), F.col(f"{p}_annotations").alias("annotations"))
    doc = F.col("document")
    meta = F.struct(
        doc["metadata"]["name"].alias("name"), F.concat(F.lit("uid-"), key).alias("uid"),
        F.col("labels").alias("labels"), F.col("annotations").alias("annotations"),
    )
    spec = doc["spec"]
    with_meta = spec.withField("scheduler", spec["scheduler"].withField("metadata", part("scheduler"))).withField(
        "worker", spec["worker"].withField("metadata", part("worker")))
    return made.select(
        "cluster_id", "namespace", doc.withField("metadata", meta).withField("spec", with_meta).alias("document"))
