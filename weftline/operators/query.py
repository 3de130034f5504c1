"""A fluent relational query over declared entities.

Edges follow references. Predicates on edges are semi- and anti-joins and traversals are
semi-joins, so no result needs a DISTINCT.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.errors import NotFound, NotSingular, ValidationFailed
from weftline.operators.hooks import Hook, Mutation, chain


def equal_fold(column: str, value: str) -> Column:
    return F.lower(F.col(column)) == value.lower()


def contains_fold(column: str, value: str) -> Column:
    return F.lower(F.col(column)).contains(value.lower())


def all_of(*predicates: Column) -> Column:
    return reduce(Column.__and__, predicates)


def any_of(*predicates: Column) -> Column:
    return reduce(Column.__or__, predicates)


@dataclass(frozen=True)
class Edge:
    """From this entity's ``own`` column to ``other`` of the target; through a bridge (table, own side, other side) for many-to-many."""

    target: str
    own: str
    other: str
    bridge: tuple[str, str, str] | None = None


@dataclass
class Catalog:
    """Tables by name with their primary keys and named edges; interceptors wrap reads, hooks wrap writes."""

    tables: dict[str, DataFrame]
    keys: dict[str, str]
    edges: dict[tuple[str, str], Edge] = field(default_factory=dict)
    interceptors: list[Callable[[str, DataFrame], DataFrame]] = field(default_factory=list)
    hooks: list[Hook] = field(default_factory=list)

    def query(self, table: str) -> Query:
        rows = self.tables[table]
        for wrap in self.interceptors:
            rows = wrap(table, rows)
        return Query(self, table, rows)

    def write(self, table: str, op: str, rows: DataFrame, fields: tuple[str, ...] = ()) -> DataFrame:
        """The table's rows after a mutation, once all hooks have seen them; later queries read them."""
        stored = chain(*self.hooks)(Mutation(table, op, frozenset(fields)), rows)
        self.tables[table] = stored
        return stored

    def get(self, table: str, key: Any) -> Query:
        return self.query(table).where(F.col(self.keys[table]) == key)


@dataclass(frozen=True)
class Query:
    """An immutable builder; every method returns a new one."""

    catalog: Catalog
    table: str
    rows: DataFrame

    def _with(self, rows: DataFrame) -> Query:
        return replace(self, rows=rows)

    def _known(self, *columns: str) -> None:
        for c in columns:
            if c not in self.rows.columns:
                raise ValidationFailed(f"unknown column {self.table}.{c}")

    def where(self, *predicates: Column) -> Query:
        return self._with(self.rows.where(all_of(*predicates))) if predicates else self

    def select(self, *columns: str) -> Query:
        self._known(*columns)
        return self._with(self.rows.select(*columns))

    def order(self, *columns: Column | str) -> Query:
        """Nulls come last, in either direction, unless a column says otherwise."""
        return self._with(self.rows.orderBy(*(F.asc_nulls_last(c) if isinstance(c, str) else c for c in columns)))

    def limit(self, n: int) -> Query:
        return self._with(self.rows.limit(n))

    def offset(self, n: int) -> Query:
        return self._with(self.rows.offset(n))

    def unique(self) -> Query:
        return self._with(self.rows.distinct())

    # Edges.

    def _edge(self, name: str) -> Edge:
        if (self.table, name) not in self.catalog.edges:
            raise ValidationFailed(f"unknown edge {self.table}.{name}")
        return self.catalog.edges[self.table, name]

    def _neighbour_keys(self, edge: Edge, predicates: tuple[Column, ...]) -> DataFrame:
        """The ``own`` values that have a neighbour under the predicates, as _own."""
        target = self.catalog.query(edge.target).where(*predicates).rows.select(F.col(edge.other).alias("_other"))
        if edge.bridge is None:
            return target.select(F.col("_other").alias("_own"))
        table, own, other = edge.bridge
        links = self.catalog.tables[table].select(F.col(own).alias("_own"), F.col(other).alias("_other"))
        return links.join(target, "_other", "left_semi").select("_own")

    def has(self, name: str, *predicates: Column) -> Query:
        """Rows with a neighbour over the edge, under the predicates."""
        edge = self._edge(name)
        keys = self._neighbour_keys(edge, predicates)
        return self._with(self.rows.join(keys, self.rows[edge.own] == keys["_own"], "left_semi"))

    def has_not(self, name: str, *predicates: Column) -> Query:
        edge = self._edge(name)
        keys = self._neighbour_keys(edge, predicates)
        return self._with(self.rows.join(keys, self.rows[edge.own] == keys["_own"], "left_anti"))

    def traverse(self, name: str) -> Query:
        """The neighbours of these rows, each once."""
        edge = self._edge(name)
        own = self.rows.select(F.col(edge.own).alias("_own"))
        if edge.bridge is not None:
            table, mine, other = edge.bridge
            own = self.catalog.tables[table].select(F.col(mine).alias("_own"), F.col(other).alias("_o")).join(own, "_own", "left_semi").select(F.col("_o").alias("_own"))
        target = self.catalog.query(edge.target)
        return target._with(target.rows.join(own, target.rows[edge.other] == own["_own"], "left_semi"))

    def with_edge(self, name: str, *predicates: Column, columns: tuple[str, ...] = (), order: str | None = None) -> Query:
        """Eager loading: the neighbours as an array of structs named after the edge, empty where there are none."""
        edge = self._edge(name)
        target = self.catalog.query(edge.target).where(*predicates).rows
        names = columns or tuple(target.columns)
        item = F.struct(*([F.col(order).alias("_order")] if order else []), *names)
        if edge.bridge is None:
            links = target.select(F.col(edge.other).alias("_own"), item.alias("_item"))
        else:
            table, own, other = edge.bridge
            pairs = self.catalog.tables[table].select(F.col(own).alias("_own"), F.col(other).alias("_other")).distinct()
            links = pairs.join(target.select(F.col(edge.other).alias("_other"), item.alias("_item")), "_other").select("_own", "_item")
        lists = links.groupBy("_own").agg(F.sort_array(F.collect_list("_item")).alias("_items"))
        plain = F.transform("_items", lambda x: F.struct(*(x[n].alias(n) for n in names)))
        lists = lists.select("_own", plain.alias("_list"))
        empty = F.array().cast(lists.schema["_list"].dataType)
        return self._beside(edge, lists, F.coalesce("_list", empty), name)

    def _beside(self, edge: Edge, found: DataFrame, value: Column, name: str) -> Query:
        """The rows with a column from ``found`` (by _own). They travel as one struct, so their own names can't clash with its."""
        rows = self.rows.select(F.struct("*").alias("_row"))
        joined = rows.join(found, F.col("_row")[edge.own] == F.col("_own"), "left")
        return self._with(joined.select(*(F.col("_row")[c].alias(c) for c in self.rows.columns if c != name), value.alias(name)))

    def with_neighbour_count(self, name: str, alias: str) -> Query:
        edge = self._edge(name)
        counts = self._neighbour_keys(edge, ()).groupBy("_own").agg(F.count("*").alias("_n"))
        return self._beside(edge, counts, F.coalesce("_n", F.lit(0)).cast("long"), alias)

    def with_neighbour_field(self, name: str, column: str, alias: str) -> Query:
        """A column of the one neighbour over a to-one edge."""
        edge = self._edge(name)
        other = self.catalog.query(edge.target).rows.select(F.col(edge.other).alias("_own"), F.col(column).alias("_value"))
        return self._beside(edge, other, F.col("_value"), alias)

    # Aggregation.

    def group_by(self, *columns: str) -> Grouped:
        self._known(*columns)
        return Grouped(self, columns)

    def aggregate(self, **functions: Column) -> DataFrame:
        return self.rows.agg(*(f.alias(n) for n, f in functions.items()))

    # Terminals.

    def all(self) -> DataFrame:
        return self.rows

    def count(self) -> int:
        return self.rows.count()

    def exist(self) -> bool:
        return not self.rows.isEmpty()

    def ids(self) -> DataFrame:
        return self.rows.select(self.catalog.keys[self.table])

    def first(self):
        found = self.rows.limit(1).collect()
        if not found:
            raise NotFound(f"{self.table} not found")
        return found[0]

    def only(self):
        found = self.rows.limit(2).collect()
        if not found:
            raise NotFound(f"{self.table} not found")
        if len(found) > 1:
            raise NotSingular(f"{self.table} not singular")
        return found[0]

    def scalars(self, column: str) -> list:
        """A column's values, for results that fit the driver."""
        self._known(column)
        return [r[0] for r in self.rows.select(column).collect()]

    def explain(self) -> None:
        self.rows.explain("formatted")


@dataclass(frozen=True)
class Grouped:
    query: Query
    columns: tuple[str, ...]

    def aggregate(self, **functions: Column) -> DataFrame:
        return self.query.rows.groupBy(*self.columns).agg(*(f.alias(n) for n, f in functions.items()))
