"""User handlers: functions over DataFrames, run on the events their rule selects."""

from __future__ import annotations

import logging
from collections.abc import Callable, Mapping
from dataclasses import dataclass
from functools import reduce
from importlib.metadata import entry_points
from types import MappingProxyType

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from musterroll.functions.labels import empty_map
from musterroll.session import scratch_path

ENTRY_POINT_GROUP = "musterroll_handlers"
_ROUTE = "route_to_handler"
_log = logging.getLogger(__name__)


@dataclass(frozen=True)
class Rule:
    """Which events a handler wants; unset parts accept everything."""

    kind: str
    field: str | None = None
    new: str | None = None
    labels: Mapping[str, str] = MappingProxyType({})

    def selects(self) -> Column:
        terms = [F.col("kind") == self.kind]
        if self.field is not None:
            terms.append(F.col("field") == self.field)
        if self.new is not None:
            terms.append(F.col("new") == self.new)
        terms += [F.col("labels")[k] == v for k, v in self.labels.items()]
        return reduce(lambda a, b: a & b, terms)


class Handlers:
    """A registry of (name, rule, function); functions map a DataFrame to a DataFrame."""

    def __init__(self):
        self._entries: list[tuple[str, Rule, Callable[[DataFrame], DataFrame]]] = []

    def register_handler(
        self, rule: Rule, function: Callable[[DataFrame], DataFrame], name: str | None = None
    ) -> None:
        self._entries.append((name or function.__name__, rule, function))

    def load_plugins(self, group: str = ENTRY_POINT_GROUP) -> list[str]:
        """Let installed plugins register themselves; one that fails to import is skipped.

        An entry point names a function that takes this registry.
        """
        loaded = []
        for point in entry_points(group=group):
            try:
                setup = point.load()
            except (ImportError, AttributeError):
                _log.warning("handler plugin %s could not be imported", point.name)
                continue
            setup(self)
            loaded.append(point.name)
        return loaded

    def _routed(self, events: DataFrame) -> list[DataFrame]:
        """The events of each handler, from one pass over ``events``.

        A row gets the numbers of all handlers that want it and is written once for each,
        in a folder of its own, so a handler reads its rows only.
        """
        if len(self._entries) == 1 or events.isStreaming:
            return [events.where(rule.selects()) for _, rule, _ in self._entries]
        wanted = F.array(*[F.when(rule.selects(), F.lit(i)) for i, (_, rule, _) in enumerate(self._entries)])
        path = scratch_path(events.sparkSession, "routed")
        routed = events.withColumn(_ROUTE, F.explode(wanted)).where(F.col(_ROUTE).isNotNull())
        routed.write.partitionBy(_ROUTE).parquet(path)
        schema = T.StructType([*events.schema.fields, T.StructField(_ROUTE, T.IntegerType())])
        table = events.sparkSession.read.schema(schema).parquet(path)
        return [table.where(F.col(_ROUTE) == i).drop(_ROUTE) for i in range(len(self._entries))]

    def run_handlers(self, events: DataFrame) -> DataFrame:
        """Outputs of all handlers, each with the handler's name.

        A batch of events is read once, however many handlers there are; on a stream each
        handler filters for itself.
        """
        if not self._entries:
            raise ValueError("no handler is registered")
        outputs = [
            own.transform(function).withColumn("handler", F.lit(name))
            for (name, _, function), own in zip(self._entries, self._routed(events), strict=True)
        ]
        return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), outputs)


def rule_rows(spark, rules: Mapping[str, Rule]) -> DataFrame:
    """Rules as the table that ``match_rules`` joins."""
    rows = [(n, r.kind, r.field, r.new, dict(r.labels)) for n, r in rules.items()]
    table = spark.createDataFrame(
        rows, "rule STRING, rule_kind STRING, rule_field STRING, rule_new STRING,"
        " rule_labels MAP<STRING, STRING>",
    )
    return table.withColumn("rule_labels", F.coalesce("rule_labels", empty_map()))
