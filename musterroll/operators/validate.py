"""Documents of several kinds against the schema of their kind, in one pass.

A schema is an OpenAPI one as a dict: ``type``, ``properties``, ``required``, ``items``,
``additionalProperties`` (a schema, or True), ``enum``, ``minimum`` and ``pattern``. It is
compiled into one expression over the document as a variant, so a document is parsed once.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_FOUND = "array<struct<path: string, problem: string>>"
_SCALARS = {"string": ["STRING"], "integer": ["BIGINT"], "boolean": ["BOOLEAN"]}


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once."""
    return F.transform(F.array(value), use)[0]


def _one(path: Column, problem: str) -> Column:
    return F.array(F.struct(path.alias("path"), F.lit(problem).alias("problem")))


def _none() -> Column:
    return F.array().cast(_FOUND)


def _at(path: Column, name: str) -> Column:
    return F.concat(path, F.when(path == "", F.lit(name)).otherwise(F.lit(f".{name}")))


def _object(value: Column, spec: Mapping, path: Column) -> Column:
    known: Mapping = spec.get("properties", {})
    other = spec.get("additionalProperties", not known)

    def inside(fields: Column) -> Column:
        parts = []
        for name, own in known.items():
            missing = _one(_at(path, name), "missing") if name in spec.get("required", ()) else _none()
            there = F.map_contains_key(fields, name) & ~F.is_variant_null(fields[name])
            parts.append(F.when(there, problems_of(fields[name], own, _at(path, name))).otherwise(missing))
        others = F.map_filter(fields, lambda k, _: ~k.isin(*known)) if known else fields
        if other is False:
            parts.append(F.transform(F.map_keys(others), lambda k: F.struct(
                F.concat(path, F.when(path == "", k).otherwise(F.concat(F.lit("."), k))).alias("path"), F.lit("unknown").alias("problem"))))
        elif other is not True:
            parts.append(F.flatten(F.transform(F.map_entries(others), lambda e: problems_of(
                e["value"], other, F.concat(path, F.lit("["), e["key"], F.lit("]"))))))
        return F.concat(_none(), *parts)

    as_map = F.try_variant_get(value, "$", "map<string,variant>")
    return _let(as_map, lambda m: F.when(m.isNull(), _one(path, "not an object")).otherwise(inside(m)))


def _array(value: Column, spec: Mapping, path: Column) -> Column:
    def inside(items: Column) -> Column:
        if "items" not in spec:
            return _none()
        return F.flatten(F.transform(items, lambda item, at: problems_of(
            item, spec["items"], F.concat(path, F.lit("["), at.cast("string"), F.lit("]")))))

    as_array = F.try_variant_get(value, "$", "array<variant>")
    return _let(as_array, lambda a: F.when(a.isNull(), _one(path, "not an array")).otherwise(inside(a)))


def _scalar(value: Column, spec: Mapping, path: Column) -> Column:
    kind = spec.get("type")
    found = F.lit(None).cast(_FOUND)
    if "enum" in spec:
        given = F.try_variant_get(value, "$", "string")
        found = F.when(~F.coalesce(given.isin(*map(str, spec["enum"])), F.lit(False)), _one(path, "not one of the values"))
    if "minimum" in spec:
        low = F.try_variant_get(value, "$", "double") < spec["minimum"]
        found = F.when(low, _one(path, "too small")).otherwise(found)
    if "pattern" in spec:
        bad = ~F.try_variant_get(value, "$", "string").rlike(spec["pattern"])
        found = F.when(bad, _one(path, "not of the form")).otherwise(found)
    if kind in _SCALARS:
        found = F.when(~F.schema_of_variant(value).isin(*_SCALARS[kind]), _one(path, f"not of type {kind}")).otherwise(found)
    return F.coalesce(found, _none())


def problems_of(value: Column, spec: Mapping, path: Column) -> Column:
    """What is wrong with a variant, as an array of path and problem."""
    made = {"object": _object, "array": _array}.get(spec.get("type", ""), _scalar)
    return made(value, spec, path)


def check_documents(
    df: DataFrame, key: list[str], json: str, kind: Column, schemas: Mapping[str, Mapping]
) -> DataFrame:
    """One row per problem: the key, the kind, the path and the problem.

    ``json`` is the column with the document's text, ``kind`` names its schema. Fields that
    a schema does not name are ``unknown`` unless it has ``additionalProperties``; a schema
    of an object without properties takes everything. A null breaches ``required`` only, and
    a null document, or one of a kind without schema, nothing. Text that is no JSON is one
    problem at the empty path.
    """
    rows = df.select(*key, kind.alias("_kind"), F.col(json).alias("_json"))
    own = F.col("_kind")

    def checked(doc: Column) -> Column:
        found = _none()
        for name, spec in schemas.items():
            found = F.when(own == name, problems_of(doc, spec, F.lit(""))).otherwise(found)
        unreadable = F.when(own.isin(*schemas), _one(F.lit(""), "not JSON")).otherwise(_none())
        return F.when(doc.isNull(), unreadable).otherwise(found)

    problems = F.when(F.col("_json").isNotNull(), _let(F.try_parse_json("_json"), checked))
    rows = rows.select(*key, "_kind", F.explode(problems).alias("_found"))
    return rows.select(*key, F.col("_kind").alias("kind"), "_found.path", "_found.problem")
