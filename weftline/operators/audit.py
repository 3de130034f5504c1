"""Integrity audits: orphans, duplicates, cardinality, coherence and boundary states."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def orphans(child: DataFrame, fk: tuple[str, ...], parent: DataFrame, pk: tuple[str, ...], nullable: bool = False) -> DataFrame:
    """Child rows whose key no parent has. Where the reference is nullable, a null key is none."""
    keys = parent.select(*(F.col(p).alias(f"_pk_{i}") for i, p in enumerate(pk)))
    rows = child.where(reduce(Column.__and__, (F.col(c).isNotNull() for c in fk))) if nullable else child
    return rows.join(keys, reduce(Column.__and__, (F.col(c) == F.col(f"_pk_{i}") for i, c in enumerate(fk))), "left_anti")


def reference_report(name: str, child: DataFrame, fk: str, parent_name: str, parent: DataFrame, pk: str) -> DataFrame:
    """One row: child, fk, parent, total, orphans, childless_parents, max_children.

    Children are counted by key first, so the join meets one row a key.
    """
    counts = child.groupBy(F.col(fk).alias("k")).agg(F.count("*").alias("n"))
    both = counts.join(parent.select(F.col(pk).alias("p")), F.col("k") == F.col("p"), "full_outer")
    of = lambda c, v: F.coalesce(F.sum(F.when(c, v)), F.lit(0)).cast("long")
    return both.agg(
        of(F.col("n").isNotNull(), F.col("n")).alias("total"),
        of(F.col("p").isNull(), F.col("n")).alias("orphans"),
        of(F.col("n").isNull(), F.lit(1)).alias("childless_parents"),
        F.coalesce(F.max(F.when(F.col("p").isNotNull(), F.col("n"))), F.lit(0)).cast("long").alias("max_children"),
    ).select(F.lit(name).alias("child"), F.lit(fk).alias("fk"), F.lit(parent_name).alias("parent"), "total", "orphans", "childless_parents", "max_children")


def bridge_orphans(bridge: DataFrame, sides: list[tuple[str, DataFrame, str]]) -> DataFrame:
    """Bridge rows that lack a parent on any side; each side is (key column, parent, parent key)."""
    rows = bridge
    for i, (fk, parent, pk) in enumerate(sides):
        keys = parent.select(F.col(pk).alias(f"_k{i}"), F.lit(True).alias(f"_has{i}"))
        rows = rows.join(keys, F.col(fk) == F.col(f"_k{i}"), "left")
    missing = reduce(Column.__or__, (F.col(f"_has{i}").isNull() for i in range(len(sides))))
    return rows.where(missing).select(*bridge.columns)


def tuple_counts(rows: DataFrame, *keys: str) -> DataFrame:
    """One row: total and distinct_tuples."""
    return rows.groupBy(*keys).agg(F.count("*").alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("total"), F.count("*").alias("distinct_tuples"))


def duplicates(rows: DataFrame, *keys: str) -> DataFrame:
    """Keys that occur more than once, and how often; nulls exempt a row."""
    return rows.dropna(subset=list(keys)).groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def self_loops(rows: DataFrame, a: str, b: str) -> DataFrame:
    return rows.where(F.col(a) == F.col(b))


def soft_delete_split(rows: DataFrame, deleted: str) -> DataFrame:
    """One row: total, deleted, visible."""
    gone = F.col(deleted).isNotNull()
    return rows.agg(F.count("*").alias("total"), F.count_if(gone).alias("deleted"), F.count_if(~gone).alias("visible"))


def visible(rows: DataFrame, deleted: str) -> DataFrame:
    """The default scope: rows not deleted."""
    return rows.where(F.col(deleted).isNull())


def cardinality(parent: DataFrame, pk: str, child: DataFrame, fk: str) -> DataFrame:
    """children ('zero', 'one', 'many') and the number of parents, those without children included."""
    counts = child.groupBy(F.col(fk).alias("_k")).agg(F.count("*").alias("_n"))
    n = F.coalesce("_n", F.lit(0))
    bucket = F.when(n == 0, "zero").when(n == 1, "one").otherwise("many")
    return parent.join(counts, parent[pk] == counts["_k"], "left").groupBy(bucket.alias("children")).agg(F.count("*").alias("parents"))


def violations(rows: DataFrame, **checks: Column) -> DataFrame:
    """One row: total, and for each named check the rows where it is false."""
    return rows.agg(F.count("*").alias("total"), *(F.count_if(~c).alias(n) for n, c in checks.items()))


def states(rows: DataFrame, column: str, size: int = 0) -> DataFrame:
    """One row of booleans: whether nulls, values and, for strings, the lengths 0, 1 and ``size`` occur."""
    c = F.col(column)
    found = [F.bool_or(c.isNull()).alias("has_null"), F.bool_or(c.isNotNull()).alias("has_value")]
    if size:
        found += [F.coalesce(F.bool_or(F.length(c) == k), F.lit(False)).alias(f"has_length_{k}") for k in dict.fromkeys((0, 1, size))]
    return rows.agg(*found)


def same_rows(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: rows only in one or the other, repeats counted."""
    left, right = a.exceptAll(b), b.exceptAll(a)
    return left.agg(F.count("*").alias("only_left")).crossJoin(right.agg(F.count("*").alias("only_right")))
