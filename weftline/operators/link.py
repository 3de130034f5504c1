"""Linking: children of driver rows, dense indices and foreign keys, all as equi-joins and arithmetic."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.errors import InvalidReference

#: Rows of one bucket of the two-level prefix sum.
BUCKET = 65536


def expand_children(counts: DataFrame) -> DataFrame:
    """(driver_row, n) to one row a child: driver_row, block_idx. Rows without children give none."""
    some = counts.where(F.col("n") > 0)
    return some.select("driver_row", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n").cast("long") - 1)).alias("block_idx"))


def dense_children(counts: DataFrame) -> DataFrame:
    """Children with row_idx from 0 without gaps, blocks in driver order.

    The prefix sum has two levels: within buckets of driver rows, and over the buckets' totals, which
    are one row for 65,536 driver rows.
    """
    bucketed = counts.select("driver_row", F.col("n").cast("long").alias("n"), F.floor(F.col("driver_row") / BUCKET).alias("bucket"))
    totals = bucketed.groupBy("bucket").agg(F.sum("n").alias("total"))
    before = F.sum("total").over(Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))
    totals = totals.select("bucket", F.coalesce(before, F.lit(0).cast("long")).alias("base"))
    within = F.sum("n").over(Window.partitionBy("bucket").orderBy("driver_row").rowsBetween(Window.unboundedPreceding, -1))
    placed = bucketed.withColumn("within", F.coalesce(within, F.lit(0).cast("long"))).join(totals, "bucket")
    some = placed.where(F.col("n") > 0).withColumn("block_idx", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)))
    return some.select((F.col("base") + F.col("within") + F.col("block_idx")).alias("row_idx"), "driver_row", "block_idx")


def round_robin(row: Column, parents: int) -> Column:
    """Parent row by turns; null where there is no parent."""
    return F.try_mod(row, F.lit(parents).cast("long"))


def deferred_parent(row: Column, parents: int, own: bool) -> Column:
    """Parent row of the second pass: by turns, and never oneself; a single row of its own kind stays without."""
    turn = round_robin(row, parents)
    if not own:
        return turn
    return F.when(turn != row, turn).when(F.lit(parents > 1), F.try_mod(turn + 1, F.lit(parents).cast("long")))


def copy_key(child: DataFrame, parent: DataFrame, parent_row: str, child_fields: tuple[str, ...], parent_fields: tuple[str, ...]) -> DataFrame:
    """Fill the child's foreign key from the parent row that ``parent_row`` names; without one it stays null.

    ``parent`` carries row_idx. Fields correspond by position.
    """
    if len(child_fields) != len(parent_fields):
        raise InvalidReference(f"{len(child_fields)} reference fields for a key of {len(parent_fields)}")
    keys = parent.select(F.col("row_idx").alias("_parent_row"), *(F.col(p).alias(f"_key_{i}") for i, p in enumerate(parent_fields)))
    joined = child.join(keys, child[parent_row] == keys["_parent_row"], "left")
    return joined.withColumns({c: F.col(f"_key_{i}") for i, c in enumerate(child_fields)}).drop("_parent_row", *(f"_key_{i}" for i in range(len(child_fields))))
