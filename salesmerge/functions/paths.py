"""JSON paths and column names."""

from __future__ import annotations

import itertools

from pyspark.sql import Column
from pyspark.sql import functions as F


def _variant_paths(path: str) -> list[str]:
    """Every reading of a dotted path; a digit step is a list index or a key."""
    steps = path.split(".")
    readings = []
    for step in steps:
        key = "['" + step + "']" if "'" not in step else '["' + step + '"]'
        readings.append([f"[{int(step)}]", key] if step.isdigit() else [key])
    return ["$" + "".join(parts) for parts in itertools.product(*readings)]


def json_path(payload: Column, path: str, kind: str = "variant") -> Column:
    """Follow a dotted path into a VARIANT; a missing step gives null."""
    if not path:
        return payload if kind == "variant" else F.try_variant_get(payload, "$", kind)
    return F.coalesce(*[F.try_variant_get(payload, p, kind) for p in _variant_paths(path)])


def variant_kind(value: Column) -> Column:
    """Coarse JSON type of a VARIANT: object, array, string, number, boolean, null."""
    shape = F.schema_of_variant(value)
    return (
        F.when(shape.startswith("OBJECT"), "object")
        .when(shape.startswith("ARRAY"), "array")
        .when(shape == "STRING", "string")
        .when(shape == "BOOLEAN", "boolean")
        .when(shape == "VOID", "null")
        .when(shape.isNotNull(), "number")
    )


def normalize_column_name(name: Column) -> Column:
    """Lower case, everything but letters and digits folded to single underscores."""
    folded = F.regexp_replace(F.lower(F.coalesce(name, F.lit(""))), "[^a-z0-9]+", "_")
    return F.trim(folded, F.lit("_"))
