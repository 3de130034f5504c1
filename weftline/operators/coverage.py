"""Boundary states: each field cycles through its nulls, booleans or string sizes along the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.model import Entity, Field


def boundary(field: Field, row: Column) -> Column | None:
    """The field's value by row, or None if it has no axis; a null condition means: keep what is there."""
    own = F.col(f"`{field.name}`")
    if field.nullable:
        return F.when(row % 2 != 0, own)
    if field.is_bool:
        turn = row % 2 == 1
        return F.when(row < 2, turn).otherwise(own) if field.unique else turn
    if field.is_string and field.size > 0:
        return F.when(row % 3 == 0, "").when(row % 3 == 1, "x").otherwise(F.lit("y" * field.size))
    return None


def apply_overrides(rows: DataFrame, entity: Entity, row_index: str = "row_idx") -> DataFrame:
    """Keys and references stay as they are."""
    axes = {f.name: boundary(f, F.col(row_index)) for f in entity.fields if not f.primary_key and f.name not in entity.reference_fields}
    axes = {n: c.cast(entity.field(n).type) for n, c in axes.items() if c is not None}
    return rows.withColumns(axes) if axes else rows
