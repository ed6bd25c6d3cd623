"""Which rules select which events, by hash joins on what the rules ask for.

Rules that ask for the same parts of an event (field, new value, the same label keys) have
one shape. For every shape an event gives one key, the values of those parts, and a rule
fires exactly if its own values are that key. There are few shapes, however many rules.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from musterroll.operators.heat import small_side

#: Shapes whose keys one pass over the events emits; more shapes take further passes.
PASS_SHAPES = 64
#: Kinds that a shape's keys are restricted to; a shape with more gives keys for every kind.
_FEW_KINDS = 100
_PARTS = ("rule_kind", "rule_field", "rule_new", "rule_labels")


@dataclass(frozen=True)
class Shape:
    """The parts of an event that some rules ask for, and the kinds they ask for."""

    field: bool
    new: bool
    labels: tuple[str, ...]
    kinds: tuple[str, ...] | None


def _marked(value: Column) -> Column:
    """The value as a text that no absent value equals."""
    return F.coalesce(F.concat(F.lit("="), value), F.lit("-"))


def _names(labels: str) -> Column:
    return F.array_sort(F.map_keys(F.coalesce(labels, F.create_map().cast("map<string,string>"))))


def shapes_of(rules: DataFrame) -> tuple[list[Shape], int]:
    """The shapes of a rule table, of which the driver gets one row each, and its rows."""
    asked = [F.col("rule_field").isNotNull().alias("field"), F.col("rule_new").isNotNull().alias("new"), _names("rule_labels").alias("names")]
    found = rules.where(F.col("rule_kind").isNotNull()).groupBy(*asked).agg(
        F.slice(F.array_sort(F.collect_set("rule_kind")), 1, _FEW_KINDS + 1).alias("kinds"), F.count(F.lit(1)).alias("n"))
    rows = sorted(found.collect(), key=lambda r: (r["field"], r["new"], r["names"]))
    shapes = [
        Shape(r["field"], r["new"], tuple(r["names"]), tuple(r["kinds"]) if len(r["kinds"]) <= _FEW_KINDS else None)
        for r in rows
    ]
    return shapes, sum(r["n"] for r in rows)


def _rule_keys(rules: DataFrame) -> DataFrame:
    """Rules with their key in ``_key``: flags of the parts, their values, names and values of labels."""
    flag = lambda part: F.when(F.col(part).isNotNull(), "+").otherwise("")
    own = F.array(
        F.concat(F.lit("f"), flag("rule_field"), F.lit("n"), flag("rule_new")),
        F.col("rule_kind"), F.coalesce("rule_field", F.lit("")), F.coalesce("rule_new", F.lit("")),
    )
    labels = F.flatten(F.transform(_names("rule_labels"), lambda k: F.array(k, _marked(F.col("rule_labels")[k]))))
    return rules.where(F.col("rule_kind").isNotNull()).withColumn("_key", F.concat(own, labels)).drop(*_PARTS)


def _event_keys(events: DataFrame, shapes: list[Shape]) -> DataFrame:
    """One row per event and shape that may select it, with the key in ``_key``."""
    kind, field, new, nothing = F.col("kind"), F.col("field"), F.col("new"), F.lit("")
    values = {name: _marked(F.col("labels")[name]) for shape in shapes for name in shape.labels}
    keys = []
    for shape in shapes:
        wanted = kind.isNotNull() if shape.kinds is None else kind.isin(*shape.kinds)
        flags = f"f{'+' * shape.field}n{'+' * shape.new}"
        # A part that is asked for is never null in a rule, and neither is an array with a null in it equal to a key.
        parts = [F.lit(flags), kind, field if shape.field else nothing, new if shape.new else nothing]
        labels = [part for name in shape.labels for part in (F.lit(name), values[name])]
        keys.append(F.when(wanted, F.array(*parts, *labels)))
    return events.withColumn("_key", F.explode(F.array(*keys))).where(F.col("_key").isNotNull())


def match_rules(events: DataFrame, rules: DataFrame) -> DataFrame:
    """Every (event, rule) pair where the rule fires, with the columns of both.

    ``events`` has ``kind, field, new, labels``, ``rules`` the same as ``rule_...``. Unset
    parts of a rule (null, no labels) accept everything; every label entry has to be equal,
    and one that asks for null selects events without that label. Rules without a kind and
    events without one match nothing.

    The join is on equal keys only. Rules are broadcast while they are few; otherwise both
    sides are shuffled on the whole key, so the events of one kind spread over its values,
    and adaptive execution splits what is still skewed.
    """
    shapes, n_rules = shapes_of(rules)
    if not shapes:
        kept = [F.lit(None).cast(f.dataType).alias(f.name) for f in rules.schema if f.name not in _PARTS]
        return events.where(F.lit(False)).select("*", *kept)
    keyed = small_side(_rule_keys(rules), n_rules)
    parts = [
        _event_keys(events, shapes[at : at + PASS_SHAPES]).join(keyed, "_key").drop("_key")
        for at in range(0, len(shapes), PASS_SHAPES)
    ]
    return reduce(DataFrame.unionByName, parts)
