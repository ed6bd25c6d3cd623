"""Comparing expected with actual state."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from musterroll.functions.comparing import comparable
from musterroll.functions.documents import Value, leaves


def drift(expected: DataFrame, actual: DataFrame, key: list[str], cols: list[str]) -> DataFrame:
    """Per key: missing, extra, changed or same.

    Maps, also nested ones, are equal if their entries are. A null key equals a null key.
    Keys are unique on both sides; a key that is not gives one row per pair.
    """

    def side(rows: DataFrame, prefix: str) -> DataFrame:
        values = [comparable(F.col(c), rows.schema[c].dataType).alias(c) for c in cols]
        named = [F.col(k).alias(f"_{prefix}_{k}") for k in key]
        return rows.select(*named, F.struct(*values).alias(f"_{prefix}"))

    left, right = side(expected, "expected"), side(actual, "actual")
    match = reduce(and_, [F.col(f"_expected_{k}").eqNullSafe(F.col(f"_actual_{k}")) for k in key])
    both = [F.coalesce(f"_expected_{k}", f"_actual_{k}").alias(k) for k in key]
    state = (
        F.when(F.col("_actual").isNull(), "missing")
        .when(F.col("_expected").isNull(), "extra")
        .when(F.col("_expected").eqNullSafe(F.col("_actual")), "same")
        .otherwise("changed")
    )
    return left.join(right, match, "full_outer").select(*both, state.alias("drift"))


def drift_paths(expected: DataFrame, actual: DataFrame, key: list[str], cols: list[str]) -> DataFrame:
    """``key, path, expected, actual``: every part of a document that is not as expected.

    Paths come from the schema: fields by name, entries of maps by key, and things in lists
    by their ``name`` where they have one, else by their place. Values are texts, null where
    a side does not have the path. A key that one side lacks gives all paths of the other.
    A null key equals a null key; keys are unique on both sides.
    """

    def side(rows: DataFrame, prefix: str) -> DataFrame:
        found = F.concat(*[leaves(Value.of(rows, c), F.lit(c)) for c in cols])
        named = [F.col(k).alias(f"_{prefix}_{k}") for k in key]
        return rows.select(*named, F.map_from_entries(found).alias(f"_{prefix}"))

    left, right = side(expected, "expected"), side(actual, "actual")
    match = reduce(and_, [F.col(f"_expected_{k}").eqNullSafe(F.col(f"_actual_{k}")) for k in key])
    both = [F.coalesce(f"_expected_{k}", f"_actual_{k}").alias(k) for k in key]
    none = F.create_map().cast("map<string,string>")
    # Documents that are equal as a whole are most of them, and are not taken apart further.
    joined = left.join(right, match, "full_outer").where(
        ~F.map_entries("_expected").eqNullSafe(F.map_entries("_actual")))
    pairs = F.map_zip_with(
        F.coalesce("_expected", none), F.coalesce("_actual", none), lambda _, e, a: F.struct(e.alias("expected"), a.alias("actual")))
    rows = joined.select(*both, F.explode(pairs).alias("path", "_pair"))
    return rows.where(~F.col("_pair.expected").eqNullSafe(F.col("_pair.actual"))).select(*key, "path", "_pair.expected", "_pair.actual")


def missing_components(
    clusters: DataFrame, children: DataFrame, key: list[str], component: str,
    expected: list[str | Column],
) -> DataFrame:
    """The (cluster, component) pairs that should exist and do not."""
    names = F.array(*[F.lit(e) if isinstance(e, str) else e for e in expected])
    wanted = clusters.select(*key, F.explode(names).alias(component))
    return wanted.join(children.select(*key, component).distinct(), [*key, component], "left_anti")
