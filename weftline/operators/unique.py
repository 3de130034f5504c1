"""Uniqueness: the first row of a value keeps it, later ones are rewritten with a suffix.

Only rows of repeated values are ever ranked: the keys that repeat are found by counting first,
so a column without duplicates costs one aggregation. All first occurrences win at once, and
suffixes are drawn anew each round for what still collides. When ``ROUNDS`` do not settle it, the
lowest free suffix by rank does, and a domain that is too small raises.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.errors import UnsatisfiableUniqueness
from weftline.functions.rng import uniform
from weftline.model import Entity
from weftline.scratch import materialize

ROUNDS = 64


def conflicts(rows: DataFrame, key: tuple[str, ...], row_index: str = "row_idx") -> DataFrame:
    """row_index of every row whose key an earlier row has; a null anywhere exempts a row."""
    full = rows.dropna(subset=list(key))
    repeated = full.groupBy(*key).agg(F.min(row_index).alias("_first"), F.count("*").alias("_n")).where("_n > 1")
    return full.join(repeated.drop("_n"), list(key)).where(F.col(row_index) > F.col("_first")).select(row_index)


def suffixed(value: Column, size: int, u: Column) -> Column:
    """``value-<n>`` within ``size`` characters; the front gives way."""
    digits = 9 if size <= 0 else min(size - 1, 9)
    suffix = F.concat(F.lit("-"), F.floor(u * 10**digits).cast("string"))
    return F.concat(value if size <= 0 else F.substring(value, F.lit(1), F.lit(size) - F.length(suffix)), suffix)


def rewrite_target(entity: Entity, key: tuple[str, ...]) -> str | None:
    """The field to rewrite: the key's last string; none if the key has no string or touches a reference."""
    if set(key) & entity.reference_fields:
        return None
    strings = [n for n in key if (f := entity.field(n)) and f.is_string]
    return strings[-1] if strings else None


def keys_of(entity: Entity) -> list[tuple[tuple[str, ...], str]]:
    """Keys that repair deals with and the field it rewrites: unique strings, then composite constraints."""
    single = [((f.name,), f.name) for f in entity.fields if f.unique and f.is_string and f.name not in entity.reference_fields]
    return single + [(k, t) for k in entity.unique_constraints if (t := rewrite_target(entity, k))]


def ensure_unique(rows: DataFrame, entity: Entity, seed: int, row_index: str = "row_idx", tag: str = "unique") -> DataFrame:
    """Rewrite what collides until every key of the entity is unique."""
    keys = keys_of(entity)
    if not keys:
        return rows
    originals = rows
    for turn in range(ROUNDS + 1):
        flagged = None
        for key, target in keys:
            hit = conflicts(rows, key, row_index).withColumn("_target", F.lit(target))
            flagged = hit if flagged is None else flagged.unionByName(hit)
        flagged = materialize(flagged.distinct(), "conflicts", tag)
        if flagged.isEmpty():
            return rows
        if turn == ROUNDS:
            break
        by_row = flagged.groupBy(row_index).agg(F.collect_set("_target").alias("_targets"))
        marked = rows.join(by_row, row_index, "left")
        changed = {}
        for target in {t for _, t in keys}:
            size = entity.field(target).size
            if size == 1:
                worst = flagged.where(F.col("_target") == target)
                if not worst.isEmpty():
                    raise UnsatisfiableUniqueness(f"no unique value fits {entity.name}.{target} of 1 character")
                continue
            fresh = suffixed(F.col(f"_own_{target}"), size, uniform(seed, entity.name, F.col(row_index), target, "unique", turn))
            changed[target] = F.when(F.array_contains("_targets", target), fresh).otherwise(F.col(target))
        own = originals.select(row_index, *(F.col(t).alias(f"_own_{t}") for t in changed))
        marked = marked.join(own, row_index)
        rows = materialize(marked.withColumns(changed).select(*originals.columns), "repaired", tag)
    return _by_rank(rows, entity, keys, row_index, tag)


def _by_rank(rows: DataFrame, entity: Entity, keys: list, row_index: str, tag: str) -> DataFrame:
    """The last resort for tight domains: what still collides takes the lowest free suffixes in row order.

    Suffixes of one digit come first, then those of two, and so on. Rows whose values leave the same
    front before the suffix compete for it: the k-th of them takes the k-th number that no value of that
    front has. It is k and as many more as there are taken numbers with at most k free ones below
    them, so one sorted pass over each front's rows and numbers finds it.
    """
    for key, target in keys:
        size = entity.field(target).size
        rest = [k for k in key if k != target]
        for digits in range(1, (9 if size <= 0 else min(size - 1, 9)) + 1):
            left = materialize(conflicts(rows, key, row_index), "conflicts", tag)
            if left.isEmpty():
                break
            least, room = (0, 10) if digits == 1 else (10 ** (digits - 1), 9 * 10 ** (digits - 1))
            front = F.col(target) if size <= 0 else F.substring(target, 1, size - 1 - digits)
            group = Window.partitionBy(*rest, "_front")
            stuck = rows.join(left, row_index, "left_semi").select(*rest, front.alias("_front"), F.col(row_index).alias("_row"))
            stuck = stuck.withColumn("_at", F.row_number().over(group.orderBy("_row")) - 1)
            pattern = "(?s)^(.*)-([0-9])$" if digits == 1 else f"(?s)^(.*)-([1-9][0-9]{{{digits - 1}}})$"
            taken = rows.dropna(subset=list(key)).where(F.col(target).rlike(pattern))
            taken = taken.select(*rest, F.regexp_extract(target, pattern, 1).alias("_front"), (F.regexp_extract(target, pattern, 2).cast("long") - least).alias("_at")).distinct()
            taken = taken.join(stuck.select(*rest, "_front").distinct(), [*rest, "_front"], "left_semi")
            # Free numbers below each taken one.
            taken = taken.withColumn("_at", F.col("_at") - (F.row_number().over(group.orderBy("_at")) - 1)).withColumn("_row", F.lit(None))
            both = taken.unionByName(stuck).withColumn("_more", F.count_if(F.col("_row").isNull()).over(group.orderBy("_at", F.col("_row").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)))
            chosen = both.where(F.col("_row").isNotNull() & (F.col("_at") + F.col("_more") < room))
            chosen = chosen.select(F.col("_row").alias(row_index), F.concat("_front", F.lit("-"), (F.col("_at") + F.col("_more") + least).cast("string")).alias("_new"))
            rows = rows.join(chosen, row_index, "left").withColumn(target, F.coalesce("_new", target)).drop("_new")
            rows = materialize(rows, "repaired", tag)
        if not conflicts(rows, key, row_index).isEmpty():
            raise UnsatisfiableUniqueness(f"too few unique values for {entity.name}.{target} after {ROUNDS} rounds")
    for key, target in keys:
        if not conflicts(rows, key, row_index).isEmpty():
            raise UnsatisfiableUniqueness(f"could not make {entity.name}.{target} unique")
    return rows
