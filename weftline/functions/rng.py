"""Deterministic randomness: every draw is a pure Column of its position (seed, entity, row, field, salts).

No draw depends on partitioning, so a row made alone equals the same row made in a batch. Each
function has a twin that writes the same draw in DuckDB's SQL.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: 2 to the 52: the 13 hexadecimal digits of a draw.
SPAN = 4503599627370496.0


def uniform(*path: Column | str | int) -> Column:
    """Uniform in [0, 1) from a position. No part may be null: nulls would shift the position."""
    parts = [p.cast("string") if isinstance(p, Column) else F.lit(str(p)) for p in path]
    return F.conv(F.substring(F.md5(F.concat_ws("|", *parts)), 1, 13), 16, 10).cast("long") / F.lit(SPAN)


def uniform_sql(*path: str | int) -> str:
    """DuckDB's twin of ``uniform``; parts are SQL expressions."""
    return f"(('0x' || substr(md5(concat_ws('|', {', '.join(map(str, path))})), 1, 13))::BIGINT / {SPAN})"


def pick(pool: tuple[str, ...] | list[str], u: Column) -> Column:
    """One of the pool."""
    return F.element_at(F.array(*map(F.lit, pool)), (F.floor(u * len(pool)) + 1).cast("int"))


def pick_sql(pool: tuple[str, ...] | list[str], u: str) -> str:
    return f"([{', '.join(repr(x) for x in pool)}])[(floor({u} * {len(pool)}) + 1)::INTEGER]"


def long_tail(u: Column, mean: float = 3.0) -> Column:
    """A rounded exponential draw."""
    return F.round(F.lit(-mean) * F.log(F.lit(1.0) - u)).cast("long")
