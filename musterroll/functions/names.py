"""Names, addresses and ports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The longest cluster name and its pattern.
MAX_NAME_LENGTH = 53
NAME_PATTERN = r"\A[a-z0-9]([-a-z0-9]*[a-z0-9])?\z"


def scheduler_name(cluster) -> Column:
    return F.concat(cluster, F.lit("-scheduler"))


def default_group_name(cluster) -> Column:
    return F.concat(cluster, F.lit("-default"))


def runner_name(job) -> Column:
    return F.concat(job, F.lit("-runner"))


def worker_name(group, worker_id) -> Column:
    return F.concat(group, F.lit("-worker-"), worker_id)


def filled_template(template: Column, **values: Column) -> Column:
    """Replace each ``{field}`` of the template by its column."""
    for field, value in values.items():
        template = F.replace(template, F.lit("{%s}" % field), value)
    return template


def render_names(
    df: DataFrame, cluster: str, group: str, worker_id: str, template: str, user: str, uuid: str
) -> DataFrame:
    """Every name derived from a cluster, a group and a name template."""
    return df.select(
        "*",
        scheduler_name(F.col(cluster)).alias("scheduler_name"),
        default_group_name(F.col(cluster)).alias("default_group_name"),
        runner_name(F.col(cluster)).alias("runner_name"),
        worker_name(F.col(group), F.col(worker_id)).alias("worker_name"),
        filled_template(
            F.col(template), user=F.col(user), uuid=F.substring(F.col(uuid), 1, 10)
        ).alias("rendered_name"),
    )


def name_problem(name: Column) -> Column:
    """``too long``, ``bad characters`` or null for a valid name; null names are bad."""
    return F.when(F.length(name) > MAX_NAME_LENGTH, "too long").when(
        ~F.coalesce(name.rlike(NAME_PATTERN), F.lit(False)), "bad characters"
    )


def address_parts(address: Column) -> tuple[Column, Column]:
    """Host and port (null if none) of ``protocol://host[:port][/path]``."""
    authority = r"://([^/:]*)(?::([0-9]+))?"
    port = F.regexp_extract(address, authority, 2)
    return F.regexp_extract(address, authority, 1), F.when(port != "", port.cast("int"))


def address_inventory(df: DataFrame, col: str) -> DataFrame:
    """Distinct (host, port) with how many rows use it."""
    host, port = address_parts(F.col(col))
    return df.groupBy(host.alias("host"), port.alias("port")).agg(
        F.count(F.lit(1)).alias("n_addresses")
    )


def notebook_link(dashboard: Column, old: str = "/status", new: str = "/jupyter/lab") -> Column:
    """Address of another page of the same dashboard."""
    return F.replace(dashboard, F.lit(old), F.lit(new))


def named_port(ports: Column, service: Column, port_name, node_port: bool = False) -> Column:
    """Struct of ``port`` and ``problem``: exactly one port may carry either name."""
    wanted = F.lit(port_name) if isinstance(port_name, str) else port_name
    hits = F.filter(ports, lambda p: (p["name"] == service) | (p["name"] == wanted))
    n = F.coalesce(F.size(hits), F.lit(0))
    only = F.try_element_at(hits, F.lit(1))["nodePort" if node_port else "port"]
    return F.struct(
        F.when(n == 1, only).alias("port"),
        F.when(n < 1, "no such port").when(n > 1, "several ports").alias("problem"),
    )
