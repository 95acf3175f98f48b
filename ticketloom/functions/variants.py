"""Strictly typed reads from VARIANT columns: a JSON string "true" is not a boolean."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def path_of(*keys: str) -> str:
    return "$" + "".join(f'["{k}"]' if not k.isidentifier() or not k.isascii() else f".{k}" for k in keys)


def part(value: Column, path: str) -> Column:
    return F.try_variant_get(value, path, "variant")


def type_of(value: Column, path: str = "$") -> Column:
    return F.schema_of_variant(value if path == "$" else part(value, path))


def is_object(value: Column, path: str = "$") -> Column:
    return F.coalesce(type_of(value, path).startswith("OBJECT"), F.lit(False))


def string_at(value: Column, path: str) -> Column:
    """The string at a path, null for any other type."""
    return F.when(type_of(value, path) == "STRING", F.try_variant_get(value, path, "string"))


def filled_string_at(value: Column, path: str) -> Column:
    found = string_at(value, path)
    return F.when(found != "", found)


def bool_at(value: Column, path: str) -> Column:
    return F.when(type_of(value, path) == "BOOLEAN", F.try_variant_get(value, path, "boolean"))


def is_true(value: Column, path: str) -> Column:
    return F.coalesce(bool_at(value, path), F.lit(False))


def is_false(value: Column, path: str) -> Column:
    return F.coalesce(~bool_at(value, path), F.lit(False))


def is_truthy(value: Column, path: str) -> Column:
    """False for missing, null, false, zero and empty strings, arrays or objects."""
    text = F.to_json(part(value, path))
    return F.coalesce(~text.rlike(r'^(null|false|""|\[\]|\{\}|-?0(\.0*)?([eE].*)?)$'), F.lit(False))


def strings_at(value: Column, path: str) -> Column:
    """The string items of an array, or a lone string as a one-item array."""
    items = F.try_variant_get(value, path, "array<variant>")
    kept = F.filter(items, lambda v: F.schema_of_variant(v) == "STRING")
    return F.coalesce(
        F.when(type_of(value, path) == "STRING", F.array(F.try_variant_get(value, path, "string"))),
        F.transform(kept, lambda v: F.try_variant_get(v, "$", "string")),
        F.array().cast("array<string>"),
    )
