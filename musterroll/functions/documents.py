"""Nested documents as columns that know their schema.

What a document has is read from its schema, so a part that it cannot have is absent from
what is built of it, and merging two documents goes field by field.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass(frozen=True)
class Value:
    """A column with its type."""

    column: Column
    kind: T.DataType

    @classmethod
    def of(cls, df: DataFrame, name: str) -> Value:
        return cls(F.col(name), df.schema[name].dataType)

    def field(self, name: str) -> Value | None:
        if not isinstance(self.kind, T.StructType) or name not in self.kind.names:
            return None
        return Value(self.column.getField(name), self.kind[name].dataType)

    def at(self, path: str) -> Value | None:
        """The part at a dotted path, None if the schema has none."""
        here: Value | None = self
        for name in path.split("."):
            here = here.field(name) if here is not None else None
        return here


def text(value: str | Column) -> Value:
    return Value(F.lit(value) if isinstance(value, str) else value, T.StringType())


def text_map(value: Column) -> Value:
    return Value(value, T.MapType(T.StringType(), T.StringType()))


def record(**parts: Value | None) -> Value:
    """A struct of the parts that there are."""
    there = {name: part for name, part in parts.items() if part is not None}
    kind = T.StructType([T.StructField(name, part.kind) for name, part in there.items()])
    return Value(F.struct(*[part.column.alias(name) for name, part in there.items()]), kind)


def _is_named_list(kind: T.DataType) -> bool:
    return isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.StructType) and "name" in kind.elementType.names


def merged_kind(lower: T.DataType, upper: T.DataType) -> T.DataType:
    """The type that holds everything that values of both types have."""
    if isinstance(lower, T.StructType) and isinstance(upper, T.StructType):
        names = [*lower.names, *[n for n in upper.names if n not in lower.names]]

        def part(name: str) -> T.DataType:
            if name not in lower.names:
                return upper[name].dataType
            return merged_kind(lower[name].dataType, upper[name].dataType) if name in upper.names else lower[name].dataType

        return T.StructType([T.StructField(n, part(n)) for n in names])
    if isinstance(lower, T.MapType) and isinstance(upper, T.MapType):
        return T.MapType(upper.keyType, merged_kind(lower.valueType, upper.valueType))
    if _is_named_list(lower) and _is_named_list(upper):
        return T.ArrayType(merged_kind(lower.elementType, upper.elementType))
    return upper


def widened(value: Value, kind: T.DataType) -> Column:
    """The value in a type that ``merged_kind`` made of its own: what is new there is null."""
    if value.kind == kind:
        return value.column
    if isinstance(kind, T.StructType):
        parts = []
        for f in kind.fields:
            own = value.field(f.name)
            parts.append((widened(own, f.dataType) if own is not None else F.lit(None).cast(f.dataType)).alias(f.name))
        return F.when(value.column.isNotNull(), F.struct(*parts))
    if isinstance(kind, T.ArrayType):
        return F.transform(value.column, lambda e: widened(Value(e, value.kind.elementType), kind.elementType))
    if isinstance(kind, T.MapType):
        return F.transform_values(value.column, lambda _, v: widened(Value(v, value.kind.valueType), kind.valueType))
    return value.column.cast(kind)


def _merged_lists(lower: Value, upper: Value, kind: T.ArrayType, whole: tuple[str, ...], as_whole: bool) -> Column:
    low, high, element = lower.kind.elementType, upper.kind.elementType, kind.elementType
    nothing = F.array().cast(kind)

    def with_lower(item: Column) -> Column:
        own = Value(item, high)
        if as_whole:
            return widened(own, element)
        same = F.filter(lower.column, lambda other: other["name"] == item["name"])
        return widened(merged(Value(F.try_element_at(same, F.lit(1)), low), own, whole), element)

    names = F.coalesce(F.transform(upper.column, lambda e: e["name"].cast("string")), F.array().cast("array<string>"))
    rest = F.filter(lower.column, lambda e: ~F.array_contains(names, F.coalesce(e["name"].cast("string"), F.lit(""))))
    rest = F.transform(rest, lambda e: widened(Value(e, low), element))
    both = F.concat(F.coalesce(F.transform(upper.column, with_lower), nothing), F.coalesce(rest, nothing))
    return F.when(lower.column.isNotNull() | upper.column.isNotNull(), both)


def merged(lower: Value | None, upper: Value | None, whole: tuple[str, ...] = (), name: str = "") -> Value | None:
    """One document of two; the upper one wins.

    Structs merge field by field and maps entry by entry. Lists of things with a ``name``
    merge by name: those of the upper list come first, in its order, each merged with its
    namesake, then the lower ones that it does not name. Things in lists under one of the
    fields ``whole`` are not merged inside. Any other value is that of the upper document,
    unless it is null.
    """
    if lower is None or upper is None:
        return upper if lower is None else lower
    kind = merged_kind(lower.kind, upper.kind)
    if isinstance(kind, T.StructType) and isinstance(lower.kind, T.StructType):
        parts = {}
        for f in kind.fields:
            part = merged(lower.field(f.name), upper.field(f.name), whole, f.name)
            parts[f.name] = Value(widened(part, f.dataType), f.dataType)
        there = lower.column.isNotNull() | upper.column.isNotNull()
        return Value(F.when(there, record(**parts).column), kind)
    if isinstance(kind, T.MapType) and isinstance(lower.kind, T.MapType):
        def value(_, low: Column, high: Column) -> Column:
            both = merged(Value(low, lower.kind.valueType), Value(high, upper.kind.valueType), whole, name)
            return widened(both, kind.valueType)

        nothing = [F.create_map().cast(v.kind) for v in (lower, upper)]
        both = F.map_zip_with(F.coalesce(lower.column, nothing[0]), F.coalesce(upper.column, nothing[1]), value)
        return Value(F.when(lower.column.isNotNull() | upper.column.isNotNull(), both), kind)
    if _is_named_list(lower.kind) and _is_named_list(upper.kind):
        return Value(_merged_lists(lower, upper, kind, whole, name in whole), kind)
    return Value(F.coalesce(upper.column, lower.column.cast(kind)), kind)


def with_field(doc: Value, name: str, value: Value) -> Value:
    """The document with one of its fields set; a null document stays null."""
    parts = {n: doc.field(n) for n in doc.kind.names} | {name: value}
    made = record(**parts)
    return Value(F.when(doc.column.isNotNull(), made.column), made.kind)


_LEAF = "array<struct<path: string, value: string>>"


def leaves(value: Value, path: Column) -> Column:
    """All parts of a document that are not null, as paths with their texts.

    A part of a struct is ``path.field``, of a map ``path[key]``, of a list ``path[name]``
    if it has a name and no earlier one has the same, else ``path[#place]``.
    """
    none, kind = F.array().cast(_LEAF), value.kind
    if isinstance(kind, T.StructType):
        parts = [leaves(value.field(n), F.concat(path, F.lit(f".{n}"))) for n in kind.names]
        return F.concat(*parts) if parts else none
    if isinstance(kind, T.MapType):
        entries = F.map_entries(value.column)
        under = F.transform(entries, lambda e: leaves(
            Value(e["value"], kind.valueType), F.concat(path, F.lit("["), e["key"].cast("string"), F.lit("]"))))
        return F.coalesce(F.flatten(under), none)
    if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, (T.StructType, T.MapType, T.ArrayType)):
        def place(item: Column, at: Column) -> Column:
            number = F.concat(F.lit("#"), at.cast("string"))
            if not _is_named_list(kind):
                return number
            named = item["name"].cast("string")
            first = F.array_position(value.column["name"].cast("array<string>"), named) == at + 1
            return F.when(named.isNotNull() & first, named).otherwise(number)

        under = F.transform(value.column, lambda item, at: leaves(
            Value(item, kind.elementType), F.concat(path, F.lit("["), place(item, at), F.lit("]"))))
        return F.coalesce(F.flatten(under), none)
    shown = F.to_json(value.column) if isinstance(kind, T.ArrayType) else value.column.cast("string")
    leaf = F.array(F.struct(path.alias("path"), shown.alias("value")))
    return F.when(value.column.isNotNull(), leaf).otherwise(none)
