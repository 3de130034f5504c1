"""Mutations as rewrites: a new DataFrame for each changed table, published only when all are written."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from typing import Any

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.errors import ConstraintFailed, ValidationFailed
from weftline.model import Entity
from weftline.scratch import delete_path, new_path


_WHOLE = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)


def widens(given: T.DataType, wanted: T.DataType) -> bool:
    """Whether every value of one type is a value of the other; whole numbers also fit floating ones."""
    if given == wanted or isinstance(given, T.NullType):
        return True
    if isinstance(given, _WHOLE):
        if isinstance(wanted, _WHOLE):
            return _WHOLE.index(type(given)) <= _WHOLE.index(type(wanted))
        if isinstance(wanted, T.DecimalType):
            return wanted.precision - wanted.scale >= (3, 5, 10, 19)[_WHOLE.index(type(given))]
        return isinstance(wanted, (T.FloatType, T.DoubleType))
    if isinstance(given, T.DecimalType):
        if isinstance(wanted, T.DecimalType):
            return wanted.scale >= given.scale and wanted.precision - wanted.scale >= given.precision - given.scale
        return isinstance(wanted, T.DoubleType)
    if isinstance(given, T.FloatType):
        return isinstance(wanted, T.DoubleType)
    return isinstance(given, T.StringType) and isinstance(wanted, T.StringType)


def _fitting(given: T.DataType, wanted: T.DataType, name: str) -> None:
    if not widens(given, wanted):
        raise ValidationFailed(f"unexpected type {given.simpleString()} for field {name} of type {wanted.simpleString()}")


def create(rows: DataFrame, new: DataFrame, entity: Entity) -> DataFrame:
    """Append rows; fields that must be given are there and not null, and types fit after widening."""
    needed = [f.name for f in entity.fields if not (f.nullable or f.auto_increment or f.soft_delete)]
    for name in needed:
        if name not in new.columns:
            raise ValidationFailed(f"missing required field {entity.name}.{name}")
    unknown = set(new.columns) - set(rows.columns)
    if unknown:
        raise ValidationFailed(f"unknown column {entity.name}.{min(unknown)}")
    for c in new.columns:
        _fitting(new.schema[c].dataType, rows.schema[c].dataType, f"{entity.name}.{c}")
    if needed:
        empty = new.agg(*(F.bool_or(F.col(c).isNull()).alias(c) for c in needed)).first()
        if missing := [c for c in needed if empty[c]]:
            raise ValidationFailed(f"missing required field {entity.name}.{missing[0]}: null in some row")
    columns = [(F.col(c) if c in new.columns else F.lit(None)).cast(rows.schema[c].dataType).alias(c) for c in rows.columns]
    return rows.unionByName(new.select(*columns))


def create_mapped(rows: DataFrame, items: Iterable[Any], values: Callable[[Any, int], dict[str, Any]], entity: Entity) -> DataFrame:
    """Append a row for each item, from ``values(item, position)``; for lists that the driver has at hand."""
    made = [values(item, i) for i, item in enumerate(items)]
    names = list(dict.fromkeys(n for m in made for n in m))
    if not made:
        return rows
    unknown = set(names) - set(rows.columns)
    if unknown:
        raise ValidationFailed(f"unknown column {entity.name}.{min(unknown)}")
    schema = T.StructType([T.StructField(n, rows.schema[n].dataType) for n in names])
    try:
        new = rows.sparkSession.createDataFrame([tuple(m.get(n) for n in names) for m in made], schema)
    except PySparkException as error:
        raise ValidationFailed(f"unexpected type for a field of {entity.name}: {error}") from error
    return create(rows, new, entity)


def update_where(rows: DataFrame, predicate: Column, entity: Entity | None = None, **values: Any) -> DataFrame:
    """Set columns where the predicate is true; None clears, which an entity allows nullable fields alone. Types fit after widening."""
    unknown = set(values) - set(rows.columns)
    if unknown:
        raise ValidationFailed(f"unknown column {min(unknown)}")
    hit = F.coalesce(predicate, F.lit(False))
    given = {c: v if isinstance(v, Column) else F.lit(v) for c, v in values.items()}
    types = rows.select(*(v.alias(c) for c, v in given.items())).schema
    for c, v in values.items():
        _fitting(types[c].dataType, rows.schema[c].dataType, c)
        field = entity.field(c) if entity else None
        if v is None and field is not None and not (field.nullable or field.soft_delete):
            raise ValidationFailed(f"clearing a required field {entity.name}.{c}")
    return rows.withColumns({c: F.when(hit, v.cast(rows.schema[c].dataType)).otherwise(F.col(c)) for c, v in given.items()})


def add_children(child: DataFrame, pk: str, fk: str, links: DataFrame) -> DataFrame:
    """Children whose key ``links`` (child, parent) names refer to that parent."""
    named = links.select(F.col("child").alias("_child"), F.col("parent").alias("_parent")).dropDuplicates(["_child"])
    joined = child.select(F.struct("*").alias("_row")).join(named, F.col(f"_row.{pk}") == F.col("_child"), "left")
    return joined.select(*(F.coalesce("_parent", f"_row.{c}").alias(c) if c == fk else F.col(f"_row.{c}") for c in child.columns))


def remove_children(child: DataFrame, pk: str, fk: str, links: DataFrame) -> DataFrame:
    """Children that refer to the parent named beside them in ``links`` (child, parent) do so no more."""
    named = links.select(F.col("child").alias("_child"), F.col("parent").alias("_parent")).distinct()
    rows = child.select(F.struct("*").alias("_row"))
    joined = rows.join(named, (F.col(f"_row.{pk}") == F.col("_child")) & (F.col(f"_row.{fk}") == F.col("_parent")), "left")
    return joined.select(*(F.when(F.col("_child").isNull(), F.col(f"_row.{c}")).alias(c) if c == fk else F.col(f"_row.{c}") for c in child.columns))


def clear_children(child: DataFrame, fk: str, parents: DataFrame, pk: str) -> DataFrame:
    """No child refers to any of the parents any more."""
    return on_delete_set_null(child, fk, parents, pk)


def add_links(bridge: DataFrame, links: DataFrame) -> DataFrame:
    """A bridge with the links that it lacks."""
    return bridge.unionByName(links.select(*bridge.columns).distinct().join(bridge, bridge.columns, "left_anti"))


def remove_links(bridge: DataFrame, links: DataFrame) -> DataFrame:
    """A bridge without the links; of ``links`` with the owner's column alone, without all of the owner's."""
    return bridge.join(links, links.columns, "left_anti").select(*bridge.columns)


def delete_where(rows: DataFrame, predicate: Column) -> DataFrame:
    return rows.where(~F.coalesce(predicate, F.lit(False)))


def on_delete_set_null(child: DataFrame, fk: str, gone: DataFrame, pk: str) -> DataFrame:
    """The child with its key cleared where the parent is among the deleted ones."""
    keys = gone.select(F.col(pk).alias("_gone")).distinct()
    joined = child.join(keys, child[fk] == keys["_gone"], "left")
    return joined.withColumn(fk, F.when(F.col("_gone").isNull(), F.col(fk))).drop("_gone")


def on_delete_cascade(child: DataFrame, fk: str, gone: DataFrame, pk: str) -> DataFrame:
    keys = gone.select(F.col(pk).alias("_gone"))
    return child.join(keys, child[fk] == keys["_gone"], "left_anti")


def on_delete_restrict(child: DataFrame, fk: str, gone: DataFrame, pk: str, name: str = "") -> None:
    """Raise if a child still refers to a deleted row."""
    keys = gone.select(F.col(pk).alias("_gone"))
    if not child.join(keys, child[fk] == keys["_gone"], "left_semi").isEmpty():
        raise ConstraintFailed(f"rows of {name or 'the child'} still refer to deleted rows through {fk}")


class Transaction:
    """Stages tables in shared scratch; ``commit`` publishes all, ``rollback`` none.

    Spark has no transaction over several tables: a failure while publishing can leave some published.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.staged: dict[str, str] = {}
        self.on_commit: list[Callable[[], None]] = []
        self.on_rollback: list[Callable[[], None]] = []

    def stage(self, target: str, rows: DataFrame) -> DataFrame:
        path = new_path(self.spark, "staged", "transaction")
        rows.write.parquet(path)
        self.staged[target] = path
        return self.spark.read.parquet(path)

    def commit(self) -> None:
        for target, path in self.staged.items():
            self.spark.read.parquet(path).write.mode("overwrite").parquet(target)
        self._clear(self.on_commit)

    def rollback(self) -> None:
        self._clear(self.on_rollback)

    def _clear(self, hooks: list[Callable[[], None]]) -> None:
        for path in self.staged.values():
            delete_path(self.spark, path)
        self.staged.clear()
        for hook in hooks:
            hook()
