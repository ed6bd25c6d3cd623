"""Registered queries, each beside the SQL that checks it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

# The roles of ``roles.py`` in SQL.
_ROLES = {
    "clusters": """
        SELECT c_custkey AS cluster_id, c_name AS name, c_nationkey AS namespace,
               c_mktsegment AS segment, c_acctbal AS balance,
               CAST(c_custkey % 5 AS INTEGER) AS minimum,
               CAST(c_custkey % 30 + 20 AS INTEGER) AS maximum,
               CAST(c_custkey % 4 * 21600 AS INTEGER) AS idle_timeout_s
        FROM customer""",
    "worker_groups": """
        SELECT o_orderkey AS group_id, o_custkey AS cluster_id, o_orderdate AS created,
               CASE o_orderstatus WHEN 'P' THEN 'Pending' WHEN 'O' THEN 'Running'
                    WHEN 'F' THEN 'Failed' END AS phase,
               CAST(o_orderkey % 6 + 1 AS INTEGER) AS desired, o_orderpriority AS component,
               CASE o_orderkey % 3 WHEN 0 THEN 'LoadBalancer' WHEN 1 THEN 'NodePort'
                    ELSE 'ClusterIP' END AS service_type
        FROM orders""",
    "workers": """
        SELECT l_orderkey AS group_id, l_shipdate AS created, l_partkey AS part,
               l_suppkey AS supplier, l_linenumber AS line, l_quantity AS quantity,
               l_extendedprice AS price, l_discount AS discount, l_tax AS tax,
               CASE l_returnflag WHEN 'N' THEN 'CrashLoopBackOff'
                    WHEN 'R' THEN 'ImagePullBackOff' END AS waiting_reason,
               l_linestatus = 'F' AS ready
        FROM lineitem""",
    "watch": """
        SELECT user_id AS key, event_id AS seq, ts, event_type,
               CASE event_type WHEN 'signup' THEN 'Created' WHEN 'view' THEN 'Pending'
                    WHEN 'click' THEN 'Running' WHEN 'purchase' THEN 'Succeeded'
                    WHEN 'error' THEN 'Failed' END AS phase,
               CAST(floor(value / 10) AS INTEGER) AS target, props AS patch
        FROM events""",
    "pods": """
        SELECT l_orderkey AS group_id, l_partkey AS part, l_suppkey AS supplier,
               l_linenumber AS line, l_shipdate AS created,
               CASE WHEN l_quantity <= 40 THEN 'Running' ELSE 'Pending' END AS phase,
               l_linestatus = 'F' AS ready,
               [CASE (l_partkey + i) % 3 WHEN 1 THEN 'CrashLoopBackOff'
                     WHEN 2 THEN 'ImagePullBackOff' END
                FOR i IN range(l_linenumber % 4) ] AS reasons
        FROM lineitem""",
    "services": """
        SELECT o_orderkey AS group_id, o_custkey AS cluster_id, o_orderdate AS created,
               CASE WHEN o_orderkey % 3 = 0 AND o_orderkey % 4 < 2 THEN 'Pending'
                    ELSE 'Running' END AS phase
        FROM orders""",
    "named": """
        SELECT c_custkey AS cluster_id, c_nationkey AS namespace, c_mktsegment AS segment,
               replace(lower(c_name), '#', '-') AS name
        FROM customer""",
    "names": """
        SELECT 'part' AS origin, p_partkey AS id, p_name AS name FROM part
        UNION ALL SELECT 'part-clean', p_partkey, replace(p_name, ' ', '-') FROM part
        UNION ALL SELECT 'source', doc_id, source FROM documents
        UNION ALL SELECT 'source-long', doc_id, repeat(source, 15) FROM documents
        UNION ALL SELECT 'customer', c_custkey, c_name FROM customer
        UNION ALL SELECT 'customer-clean', c_custkey, replace(lower(c_name), '#', '-')
                  FROM customer""",
    "edges": """
        SELECT 'r' || n_regionkey AS parent_id, 'n' || n_nationkey AS child_id FROM nation
        UNION ALL SELECT 'n' || c_nationkey, 'c' || c_custkey FROM customer
        UNION ALL SELECT 'c' || o_custkey, 'o' || o_orderkey FROM orders""",
    "plan": """
        SELECT group_id, cluster_id, g.created, desired, coalesce(n, 0) AS current,
               desired - coalesce(n, 0) AS needed
        FROM worker_groups g
        LEFT JOIN (SELECT group_id, count(*) AS n FROM workers GROUP BY group_id) w
        USING (group_id)""",
    "ticks": """
        SELECT key, unnest(generate_series(
                 to_timestamp(ceil(epoch(min(ts)) / 3600) * 3600)::TIMESTAMP,
                 max(ts), INTERVAL 1 HOUR)) AS ts
        FROM watch GROUP BY key""",
}


def with_roles(*names: str) -> str:
    """Common table expressions of some roles, in the order given."""
    return "WITH RECURSIVE " + ", ".join(f"{n} AS ({_ROLES[n]})" for n in names)


def query(name: str, sql: str | None = None, roles: tuple[str, ...] = ()):
    """Register a query; ``sql`` is its oracle over the tables and the named roles."""

    def add(function: Query) -> Query:
        QUERIES[name] = function
        if sql is not None:
            if not roles:
                ORACLES[name] = sql
            elif sql.lstrip().startswith(","):
                ORACLES[name] = with_roles(*roles) + sql
            else:
                ORACLES[name] = with_roles(*roles) + " " + sql
        return function

    return add
