"""Maps of labels, annotations, settings and environment variables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Key prefixes that are never copied to children.
RESERVED_ANNOTATION_PREFIXES = ("kopf.zalando.org", "kubectl.kubernetes.io")
RESERVED_LABEL_PREFIXES = ()


def empty_map() -> Column:
    return F.create_map().cast("map<string,string>")


def without_prefixes(labels: Column, prefixes: tuple[str, ...]) -> Column:
    """The map without entries whose key starts with one of the prefixes."""
    if not prefixes:
        return labels
    return F.map_filter(
        labels, lambda k, _: ~reduce(lambda a, b: a | b, [k.startswith(p) for p in prefixes])
    )


def drop_reserved_keys(
    df: DataFrame, map_col: str, prefixes: tuple[str, ...] = RESERVED_ANNOTATION_PREFIXES
) -> DataFrame:
    """Remove reserved entries from a map column."""
    return df.withColumn(map_col, without_prefixes(F.col(map_col), prefixes))


def merge_layers(*maps: Column) -> Column:
    """One map; a later layer wins. A missing layer counts as empty."""

    def over(lower: Column, upper: Column) -> Column:
        return F.map_zip_with(lower, upper, lambda _, low, high: F.coalesce(high, low))

    return reduce(over, [F.coalesce(m, empty_map()) for m in maps])


def env_to_list(env: Column) -> Column:
    """Map to a list of ``{name, value}``."""
    return F.transform(
        F.map_entries(env),
        lambda entry: F.struct(entry["key"].alias("name"), entry["value"].alias("value")),
    )


def list_to_env(items: Column) -> Column:
    """Inverse of ``env_to_list``; names must be unique in the list."""
    return F.map_from_entries(items)


def complete_env(env: Column, defaults: dict[str, Column]) -> Column:
    """One container's environment with each default whose name it does not set yet.

    Plain expressions without lambdas, so it compiles; a missing environment is empty.
    """
    kind = "array<struct<name:string,value:string>>"

    def item(name: str, value: Column) -> Column:
        return F.array(F.struct(F.lit(name).alias("name"), value.alias("value"))).cast(kind)

    none = F.array().cast(kind)
    missing = [
        F.when(F.array_contains(env["name"], F.lit(name)), none).otherwise(item(name, value))
        for name, value in defaults.items()
    ]
    return F.concat(F.coalesce(env, none), *missing)


def inject_env(containers: Column, defaults: dict[str, Column]) -> Column:
    """Append each default to every container that does not set that name yet."""
    return F.transform(
        containers, lambda c: c.withField("env", complete_env(c["env"], defaults)))


def pairs_to_settings(
    df: DataFrame, doc: list[str], pair_col: str, order: list[str]
) -> DataFrame:
    """``KEY=VAL`` rows to one map per document; the last pair of a key wins.

    Only pairs with exactly one ``=`` count; ``pair_errors`` returns the others.
    Pairs are reduced to one per (document, key) before they are gathered, so a
    document gathers its distinct keys only.
    """
    parts = F.split(F.col(pair_col), "=")
    split = df.where(F.size(parts) == 2).withColumn("_parts", parts)
    last = split.groupBy(*doc, F.col("_parts")[0].alias("_name")).agg(
        F.max_by(F.col("_parts")[1], F.struct(*order)).alias("_value")
    )
    return last.groupBy(*doc).agg(
        F.map_from_entries(F.collect_list(F.struct("_name", "_value"))).alias("settings")
    )


def pair_errors(df: DataFrame, pair_col: str) -> DataFrame:
    """Rows whose pair is missing or has not exactly one ``=``."""
    return df.where(F.coalesce(F.size(F.split(F.col(pair_col), "=")) != 2, F.lit(True)))


def overlay_settings(
    layers: DataFrame, key: list[str], priority: str, value: str, source: str
) -> DataFrame:
    """Effective value per key: the highest-priority non-null layer, and its source."""
    ranked = F.when(F.col(value).isNotNull(), F.struct(priority, source))
    return layers.groupBy(*key).agg(
        F.max_by(value, ranked).alias(value), F.max_by(source, ranked).alias(source)
    )
