"""Row counts: how many rows each entity gets, and how many of them each row of its driver hosts.

Counts a driver row are a DataFrame (driver_row, n); only totals come to the driver program, in
insertion order, since caps, floors and backstops need them.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from itertools import accumulate
from math import prod

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.errors import InvalidScale, MissingSeed
from weftline.functions.rng import long_tail, uniform
from weftline.model import Entity, Options, Reference
from weftline.plans.graph import Deferred


@dataclass(frozen=True)
class Participant:
    """A required reference other than the driver that completes a composite key."""

    target: str
    fields: tuple[str, ...]


@dataclass(frozen=True)
class EntityPlan:
    """``children``: driver_row, n of a dependent; None for a root."""

    entity: str
    rows: int
    driver: Reference | None = None
    children: DataFrame | None = None
    participants: tuple[Participant, ...] = ()


def required(entity: Entity, deferred: set[tuple[str, tuple[str, ...]]]) -> list[Reference]:
    """References that must hold at insertion, by (target, fields)."""
    refs = [r for r in entity.references if not r.nullable and (entity.name, tuple(r.fields)) not in deferred]
    return sorted(refs, key=lambda r: (r.target, r.fields))


def candidate_keys(entity: Entity) -> list[tuple[str, ...]]:
    """Composite keys: the primary key first, then the unique constraints as declared."""
    return [k for k in (entity.primary_key, *entity.unique_constraints) if len(k) >= 2]


def _partners(key: tuple[str, ...], driver: Reference, refs: list[Reference]) -> tuple[Participant, ...] | None:
    """The references that cover the key besides the driver, each field once; None if they don't."""
    rest = set(key) - set(driver.fields)
    if not set(driver.fields) <= set(key) or not rest:
        return None
    found = [r for r in refs if r.fields != driver.fields and set(r.fields) <= rest]
    covered = [f for r in found for f in r.fields]
    if len(covered) != len(set(covered)) or set(covered) != rest:
        return None
    return tuple(Participant(r.target, tuple(r.fields)) for r in found)


def junction(entity: Entity, driver: Reference, refs: list[Reference]) -> tuple[Participant, ...]:
    """Participants of the first composite key that the driver and other required references make up."""
    return next((p for key in candidate_keys(entity) if (p := _partners(key, driver, refs)) is not None), ())


def select_driver(entity: Entity, deferred: set) -> Reference | None:
    """The least required reference; one inside a key that references cover wins, so that the key's cap applies."""
    refs = required(entity, deferred)
    return next((r for r in refs if junction(entity, r, refs)), refs[0] if refs else None)


def shares_key(entity: Entity, driver: Reference, refs: list[Reference]) -> bool:
    """Whether the driver, the only required reference, is the primary key itself: one to one at most."""
    return len(refs) == 1 and set(entity.primary_key) == set(driver.fields)


def cap_of(driver: Reference, participants: tuple[Participant, ...], rows: dict[str, int]) -> int:
    """Distinct combinations that one driver row can enter; a row never pairs with itself."""
    return prod(max(0, rows[p.target] - (p.target == driver.target)) for p in participants)


def boosted(counts: list[int], cap: int | None, floor: int) -> list[int]:
    """One more child a driver row in turn, within the cap, until the floor is met or nothing fits."""
    counts, missing = list(counts), floor - sum(counts)
    while missing > 0:
        open_ = [i for i, n in enumerate(counts) if cap is None or n < cap][:missing]
        if not open_:
            break
        for i in open_:
            counts[i] += 1
        missing -= len(open_)
    return counts


def drawn_children(spark: SparkSession, seed: int, name: str, driver_rows: int, cap: int | None) -> DataFrame:
    """Long-tailed child counts of each driver row."""
    n = long_tail(uniform(seed, "plan", name, F.col("id")))
    n = F.least(n, F.lit(cap).cast("long")) if cap is not None else n
    return spark.range(driver_rows).select(F.col("id").alias("driver_row"), n.alias("n"))


def plan_generation(spark: SparkSession, entities: list[Entity], order: list[str], deferred: list[Deferred], options: Options) -> list[EntityPlan]:
    """Roots get ``scale`` rows; dependents a long-tailed number for each driver row."""
    if options.seed is None:
        raise MissingSeed("no seed")
    if options.scale < 0:
        raise InvalidScale(f"scale must not be negative: got {options.scale}")

    def children(name: str, driver_rows: int, cap: int | None) -> tuple[DataFrame, int]:
        drawn = drawn_children(spark, options.seed, name, driver_rows, cap)
        return drawn, drawn.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]

    return _plan(entities, order, deferred, lambda e: options.scale, children)


def axis_rows(entity: Entity) -> int:
    """Rows that the fields' boundary states take: 2 for a nullable or boolean field, 3 for a sized string."""
    return max([1, *(2 for f in entity.fields if f.nullable or f.is_bool), *(3 for f in entity.fields if f.is_string and f.size > 0)])


def coverage_counts(driver_rows: int, cap: int | None, floor: int) -> list[int]:
    """0, 1 and 2 children in turn, capped, then boosted to the floor."""
    counts = [min(i % 3, i % 3 if cap is None else cap) for i in range(driver_rows)]
    return boosted(counts, cap, floor)


def plan_coverage(spark: SparkSession, entities: list[Entity], order: list[str], deferred: list[Deferred]) -> list[EntityPlan]:
    """The smallest plan that shows every boundary state; tens of rows, so counts are plain lists."""
    late = {(d.entity, d.fields) for d in deferred}
    drivers = {d.target for e in entities if (d := select_driver(e, late))}
    floor = {e.name: max(3 if e.name in drivers else 1, axis_rows(e)) for e in entities}

    def children(name: str, driver_rows: int, cap: int | None) -> tuple[DataFrame, int]:
        counts = coverage_counts(driver_rows, cap, floor[name])
        return spark.createDataFrame(list(enumerate(counts)), "driver_row long, n long"), sum(counts)

    return _plan(entities, order, deferred, lambda e: floor[e.name], children)


def _plan(entities: list[Entity], order: list[str], deferred: list[Deferred], root_rows: Callable[[Entity], int], children: Callable) -> list[EntityPlan]:
    by_name = {e.name: e for e in entities}
    late = {(d.entity, d.fields) for d in deferred}
    targets = {r.target for e in entities for r in required(e, late)}
    rows: dict[str, int] = {}
    plans = []
    for name in order:
        entity = by_name[name]
        driver = select_driver(entity, late)
        if driver is None:
            plan = EntityPlan(name, root_rows(entity))
        else:
            refs = required(entity, late)
            participants = junction(entity, driver, refs)
            cap = cap_of(driver, participants, rows) if participants else 1 if shares_key(entity, driver, refs) else None
            counts, total = children(name, rows[driver.target], cap)
            if not total and name in targets and rows[driver.target]:
                # Someone requires this entity: its first driver row hosts one.
                counts, total = counts.withColumn("n", F.when(F.col("driver_row") == 0, 1).otherwise(F.col("n")).cast("long")), 1
            plan = EntityPlan(name, total, driver, counts, participants)
        rows[name] = plan.rows
        plans.append(plan)
    return plans


def junction_index(block: Column, driver_row: Column, sizes: list[int], same: list[bool]) -> list[Column]:
    """Parent row of each participant for the ``block``-th child of a driver row: its mixed-radix digits.

    sizes: usable rows of each participant (one less than it has where ``same`` says that it is the
    driver's own entity). There the digit is turned past the driver row, so no row pairs with itself.
    """
    digits = []
    for before, size, own in zip(accumulate([1, *sizes[:-1]], lambda a, b: a * b), sizes, same, strict=True):
        # An empty participant has no digit: null, and no division by zero.
        digit = F.try_mod(F.floor(block / F.lit(before or 1)).cast("long"), F.lit(size).cast("long"))
        digits.append((digit + driver_row + 1) % F.lit(size + 1) if own else digit)
    return digits


