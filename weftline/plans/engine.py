"""Seeding: a model to linked, constrained DataFrames, entity after entity in insertion order."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.errors import InvalidReference, MissingSession
from weftline.functions.rules import Rule, generate, rules_for
from weftline.model import Entity, ModelSource, Options, Reference
from weftline.operators.coverage import apply_overrides
from weftline.operators.link import copy_key, deferred_parent, dense_children, round_robin
from weftline.operators.unique import ensure_unique
from weftline.plans.generation import EntityPlan, junction_index, plan_coverage, plan_generation
from weftline.plans.graph import DependencyGraph
from weftline.scratch import materialize


class Engine:
    """Seeds models on a Spark session; ``cancel`` stops the jobs of a run by its tag."""

    def __init__(self, spark: SparkSession, extra_rules: tuple[Rule, ...] = (), tag: str = "weftline-seed"):
        if spark is None:
            raise MissingSession("no Spark session")
        self.spark, self.extra_rules, self.tag = spark, extra_rules, tag

    def seed(self, source: ModelSource, options: Options = Options()) -> dict[str, DataFrame]:
        """Random rows: roots of ``scale`` rows, long-tailed children. Each frame carries row_idx."""
        return self._run(source, options, False)

    def seed_coverage(self, source: ModelSource, options: Options = Options()) -> dict[str, DataFrame]:
        """The smallest rows that show every boundary state; the nil rate does not apply."""
        return self._run(source, replace(options, nil_rate=0.0), True)

    def cancel(self) -> None:
        self.spark.sparkContext.cancelJobsWithTag(self.tag)

    def _run(self, source: ModelSource, options: Options, coverage: bool) -> dict[str, DataFrame]:
        self.spark.sparkContext.addJobTag(self.tag)
        try:
            entities = source.entities()
            order, deferred = DependencyGraph(entities).resolve()
            plan = plan_coverage(self.spark, entities, order, deferred) if coverage else plan_generation(self.spark, entities, order, deferred, options)
            by_name = {e.name: e for e in entities}
            late = {(d.entity, d.fields) for d in deferred}
            rows: dict[str, DataFrame] = {}
            counts = {p.entity: p.rows for p in plan}
            for p in plan:
                rows[p.entity] = self._entity(by_name, p, rows, counts, late, options, coverage)
            for name in dict.fromkeys(d.entity for d in deferred):
                rows[name] = self._second_pass(by_name, name, rows, counts, late)
            return rows
        finally:
            self.spark.sparkContext.removeJobTag(self.tag)

    def _entity(self, by_name: dict[str, Entity], plan: EntityPlan, rows: dict, counts: dict[str, int], late: set, options: Options, coverage: bool) -> DataFrame:
        entity = by_name[plan.entity]
        if plan.children is None:
            base = self.spark.range(plan.rows).select(F.col("id").alias("row_idx"), F.lit(None).cast("long").alias("_driver"), F.lit(0).cast("long").alias("_block"))
        else:
            base = dense_children(plan.children).select("row_idx", F.col("driver_row").alias("_driver"), F.col("block_idx").alias("_block"))
        made = generate(base, entity, options, rules=rules_for(options.locale, self.extra_rules))
        for f in entity.fields:
            if f.primary_key and f.auto_increment and f.name not in entity.reference_fields:
                made = made.withColumn(f.name, (F.col("row_idx") + 1).cast(f.type))
        for ref in entity.references:
            if (entity.name, tuple(ref.fields)) in late:
                made = made.withColumns({f: F.lit(None).cast(entity.field(f).type if entity.field(f) else "long") for f in ref.fields})
            else:
                made = self._link(made, by_name, ref, self._parent_row(plan, ref, counts), rows.get(ref.target), counts)
        if coverage:
            made = apply_overrides(made, entity)
        names = [f.name for f in entity.fields] + [n for r in entity.references for n in r.fields if entity.field(n) is None]
        made = materialize(made.select("row_idx", *dict.fromkeys(names)), entity.name, self.tag)
        return ensure_unique(made, entity, options.seed, tag=self.tag)

    @staticmethod
    def _parent_row(plan: EntityPlan, ref: Reference, counts: dict[str, int]) -> Column:
        if plan.driver is not None and ref.fields == plan.driver.fields:
            return F.col("_driver")
        place = next((i for i, p in enumerate(plan.participants) if p.fields == tuple(ref.fields)), None)
        if place is None:
            return round_robin(F.col("row_idx"), counts.get(ref.target, 0))
        same = [p.target == plan.driver.target for p in plan.participants]
        sizes = [max(0, counts[p.target] - own) for p, own in zip(plan.participants, same, strict=True)]
        return junction_index(F.col("_block"), F.col("_driver"), sizes, same)[place]

    def _link(self, made: DataFrame, by_name: dict[str, Entity], ref: Reference, parent_row: Column, parent: DataFrame | None, counts: dict[str, int]) -> DataFrame:
        target = by_name[ref.target]
        key = target.primary_key
        if len(key) != len(ref.fields):
            raise InvalidReference(f"{ref.key}: {len(ref.fields)} reference fields for {ref.target}'s key of {len(key)}")
        if len(key) == 1 and target.field(key[0]).auto_increment:
            # The key is the row's number: no join is needed.
            value = (parent_row + 1).cast(target.field(key[0]).type)
            return made.withColumn(ref.fields[0], F.when(F.lit(counts.get(ref.target, 0) > 0), value))
        if parent is None:
            return made.withColumns({c: F.lit(None).cast(target.field(k).type) for c, k in zip(ref.fields, key, strict=True)})
        return copy_key(made.withColumn("_parent", parent_row), parent, "_parent", tuple(ref.fields), key).drop("_parent")

    def _second_pass(self, by_name: dict[str, Entity], name: str, rows: dict, counts: dict[str, int], late: set) -> DataFrame:
        entity, made = by_name[name], rows[name]
        columns = made.columns
        for ref in entity.references:
            if (name, tuple(ref.fields)) in late:
                made = made.drop(*ref.fields)
                turn = deferred_parent(F.col("row_idx"), counts[ref.target], ref.target == name)
                made = self._link(made, by_name, ref, turn, rows[ref.target], counts)
        return materialize(made.select(*columns), name, self.tag)
