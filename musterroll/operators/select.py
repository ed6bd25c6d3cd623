"""Selectors, list views and checks over resource rows."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from musterroll.functions.clock import seconds_between
from musterroll.functions.names import name_problem
from musterroll.functions.phases import is_running, service_phase

# The declared list-view columns of each kind; Age is added to all.
PRINTER_COLUMNS = {
    "cluster": {"workers": "spec.worker.replicas", "status": "status.phase"},
    "workergroup": {"workers": "spec.worker.replicas"},
    "job": {
        "status": "status.jobStatus",
        "number_of_workers": "spec.cluster.spec.worker.replicas",
    },
    "autoscaler": {
        "cluster": "spec.cluster",
        "minimum": "spec.minimum",
        "maximum": "spec.maximum",
    },
}
RESOURCE_KEYS = ("limits", "requests")


def parsed_selector(selector: str | Mapping[str, str]) -> dict[str, str]:
    """``"a=b,c=d"`` or a mapping as a dict."""
    if isinstance(selector, Mapping):
        return dict(selector)
    pairs = [term.strip().split("=", 1) for term in selector.split(",") if term.strip()]
    return {key.strip(): value.strip() for key, value in pairs}


def select_labels(
    df: DataFrame,
    selector: str | Mapping[str, str],
    labels: str = "labels",
    columns: Mapping[str, str] | None = None,
) -> DataFrame:
    """Rows whose labels contain every ``key=value``; an empty selector keeps all.

    ``columns`` names the label keys that are stored as columns of their own. Their
    conditions reach the scan, which a lookup in a map cannot.
    """
    columns = columns or {}
    terms = [
        (F.col(columns[key]) if key in columns else F.col(labels)[key]) == value
        for key, value in parsed_selector(selector).items()
    ]
    return df.where(reduce(lambda a, b: a & b, terms)) if terms else df


def select_field(df: DataFrame, selector: str) -> DataFrame:
    """Rows whose nested field equals a value, as in ``status.phase=Running``."""
    path, value = selector.split("=", 1)
    return df.where(F.col(path.strip()) == value.strip())


def printer_columns(df: DataFrame, kind: str, as_of: Column) -> DataFrame:
    """List view of a kind: name, its declared columns and the age in seconds."""
    return df.select(
        F.col("metadata.name").alias("name"),
        *[F.col(path).alias(title) for title, path in PRINTER_COLUMNS[kind].items()],
        seconds_between("metadata.creationTimestamp", as_of).alias("age_s"),
    )


def split_valid_names(df: DataFrame, name_col: str) -> DataFrame:
    """Add ``reason`` (null if valid) and the initial ``phase``, Created or Error."""
    return df.withColumn("reason", name_problem(F.col(name_col))).withColumn(
        "phase", F.when(F.col("reason").isNull(), "Created").otherwise("Error")
    )


def is_ready(df: DataFrame, phase: str = "status.phase", out: str = "ready") -> DataFrame:
    """Add whether the phase exists and is Running; false, never null."""
    return df.withColumn(out, is_running(F.col(phase)))


def with_service_phase(df: DataFrame, service_type: str, ingress: str, out: str) -> DataFrame:
    """Add the phase a scheduler service gives its cluster."""
    return df.withColumn(out, service_phase(F.col(service_type), F.col(ingress)))


@dataclass(frozen=True)
class Required:
    field: str

    def breach(self) -> Column:
        return F.col(self.field).isNull()


@dataclass(frozen=True)
class OneOf:
    field: str
    values: tuple[str, ...]

    def breach(self) -> Column:
        return ~F.col(self.field).isin(*self.values)


@dataclass(frozen=True)
class IntegerValue:
    """A field ingested as text must hold a whole number."""

    field: str

    def breach(self) -> Column:
        return ~F.col(self.field).rlike(r"\A[-+]?[0-9]+\z")


def fill_defaults(df: DataFrame, defaults: Mapping[str, object]) -> DataFrame:
    """Missing fields take their declared default."""
    return df.withColumns(
        {field: F.coalesce(F.col(field), F.lit(value)) for field, value in defaults.items()}
    )


def check_constraints(df: DataFrame, key: list[str], rules: list) -> DataFrame:
    """One row per breached rule: the key, the field and the rule's name.

    A null breaches ``Required`` only.
    """
    found = F.array(*[
        F.when(rule.breach(), F.struct(
            F.lit(rule.field).alias("field"), F.lit(type(rule).__name__).alias("rule")))
        for rule in rules
    ])
    breaches = df.withColumn("_breach", F.explode(F.filter(found, lambda b: b.isNotNull())))
    return breaches.select(*key, "_breach.field", "_breach.rule")


def check_resource_keys(df: DataFrame, key: list[str], map_col: str) -> DataFrame:
    """Entries of a resources map with an unknown key, or that hold no mapping.

    Values are JSON text as ingested; those of the known keys must be JSON objects.
    """
    entry = df.select(*key, F.explode(map_col).alias("field", "_value"))
    known = F.col("field").isin(*RESOURCE_KEYS)
    is_mapping = F.json_object_keys("_value").isNotNull()
    problem = F.when(~known, "unknown field").when(~is_mapping, "not a mapping")
    return entry.select(*key, "field", problem.alias("problem")).where(
        F.col("problem").isNotNull()
    )
