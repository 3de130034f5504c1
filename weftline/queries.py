"""The registered queries of the relational engine, each with its DuckDB twin."""

from __future__ import annotations

import datetime
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.functions import rules as R
from weftline.functions.rng import long_tail, pick_sql, uniform, uniform_sql
from weftline.model import Declared, Entity, Field, Options, Reference
from weftline.errors import NotFound, NotSingular, UnsatisfiableCycle
from weftline.operators import audit, hooks, link, mutate, unique
from weftline.operators.coverage import apply_overrides
from weftline.operators.query import Catalog, Edge, Query, contains_fold, equal_fold
from weftline.plans.generation import coverage_counts, plan_coverage, plan_generation
from weftline.plans.graph import DependencyGraph
from weftline.sources.readers import belongs_to, column, has_many, read_classes, read_tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
SEED = 42


def registered(oracle: str | None = None):
    def add(query: Callable[[SparkSession, str], DataFrame]):
        QUERIES[query.__name__] = query
        if oracle is not None:
            ORACLES[query.__name__] = oracle
        return query

    return add


#: The driver tables' references: child, key, parent, parent key.
REFERENCES = (
    ("nation", "n_regionkey", "region", "r_regionkey"),
    ("customer", "c_nationkey", "nation", "n_nationkey"),
    ("supplier", "s_nationkey", "nation", "n_nationkey"),
    ("orders", "o_custkey", "customer", "c_custkey"),
    ("lineitem", "l_orderkey", "orders", "o_orderkey"),
    ("lineitem", "l_partkey", "part", "p_partkey"),
    ("lineitem", "l_suppkey", "supplier", "s_suppkey"),
    ("events", "user_id", "customer", "c_custkey"),
    ("labels", "doc_id", "documents", "doc_id"),
)
TABLE_KEYS = {"region": "r_regionkey", "nation": "n_nationkey", "customer": "c_custkey", "supplier": "s_suppkey", "part": "p_partkey", "orders": "o_orderkey", "lineitem": "l_orderkey", "events": "event_id", "documents": "doc_id", "labels": "doc_id"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def catalog(spark: SparkSession, sf_dir: str) -> Catalog:
    """The driver tables with edges both ways, and the many-to-many edge of parts and suppliers."""
    tables = {name: table(spark, sf_dir, name) for name in TABLE_KEYS}
    edges = {}
    for child, fk, parent, pk in REFERENCES:
        edges[child, parent] = Edge(parent, fk, pk)
        edges[parent, child] = Edge(child, pk, fk)
    edges["part", "suppliers"] = Edge("supplier", "p_partkey", "s_suppkey", ("lineitem", "l_partkey", "l_suppkey"))
    edges["supplier", "parts"] = Edge("part", "s_suppkey", "p_partkey", ("lineitem", "l_suppkey", "l_partkey"))
    # A customer's manager: a derived self reference.
    tables["customer"] = tables["customer"].withColumn("manager", F.when(F.col("c_custkey") % 7 != 0, F.floor(F.col("c_custkey") / 10)))
    edges["customer", "managers"] = Edge("customer", "manager", "c_custkey")
    edges["customer", "reports"] = Edge("customer", "c_custkey", "manager")
    return Catalog(tables, TABLE_KEYS, edges)


_MANAGER = "CASE WHEN c_custkey % 7 <> 0 THEN c_custkey // 10 END"


# Audits.


def _report_sql(child: str, fk: str, parent: str, pk: str) -> str:
    return f"""SELECT '{child}' AS child, '{fk}' AS fk, '{parent}' AS parent,
  (SELECT count({fk}) FROM {child}) + (SELECT count(*) FROM {child} WHERE {fk} IS NULL) AS total,
  (SELECT count(*) FROM {child} c WHERE NOT EXISTS (SELECT 1 FROM {parent} p WHERE p.{pk} = c.{fk})) AS orphans,
  (SELECT count(*) FROM {parent} p WHERE NOT EXISTS (SELECT 1 FROM {child} c WHERE p.{pk} = c.{fk})) AS childless_parents,
  coalesce((SELECT max(n) FROM (SELECT count(*) AS n FROM {child} c JOIN {parent} p ON p.{pk} = c.{fk} GROUP BY p.{pk})), 0) AS max_children"""


@registered(" UNION ALL ".join(_report_sql(*r) for r in REFERENCES))
def audit_orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each declared reference."""
    reports = [audit.reference_report(c, table(spark, sf_dir, c), fk, p, table(spark, sf_dir, p), pk) for c, fk, p, pk in REFERENCES]
    return reduce(DataFrame.unionByName, reports)


@registered("SELECT o_orderkey, o_custkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM customer WHERE c_custkey = o_custkey AND c_mktsegment = 'BUILDING')")
def audit_orphans_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A1 against one segment's customers."""
    parents = table(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING'")
    return audit.orphans(table(spark, sf_dir, "orders"), ("o_custkey",), parents, ("c_custkey",)).select("o_orderkey", "o_custkey")


@registered(f"SELECT c_custkey, {_MANAGER} AS manager FROM customer c WHERE {_MANAGER} IS NOT NULL AND NOT EXISTS (SELECT 1 FROM customer p WHERE p.c_custkey = CASE WHEN c.c_custkey % 7 <> 0 THEN c.c_custkey // 10 END AND p.c_acctbal > 0)")
def audit_orphans_nullable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A2: a nullable self reference, against managers in credit."""
    people = catalog(spark, sf_dir).tables["customer"]
    return audit.orphans(people, ("manager",), people.where("c_acctbal > 0"), ("c_custkey",), nullable=True).select("c_custkey", "manager")


@registered("SELECT l_returnflag, count(*) AS bridge_orphans FROM lineitem LEFT JOIN (SELECT * FROM part WHERE p_size > 5) ON p_partkey = l_partkey LEFT JOIN (SELECT * FROM supplier WHERE s_acctbal > 0) ON s_suppkey = l_suppkey WHERE p_partkey IS NULL OR s_suppkey IS NULL GROUP BY l_returnflag")
def audit_bridge_orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A3: order lines that lack a part or a supplier."""
    sides = [("l_partkey", table(spark, sf_dir, "part").where("p_size > 5"), "p_partkey"), ("l_suppkey", table(spark, sf_dir, "supplier").where("s_acctbal > 0"), "s_suppkey")]
    return audit.bridge_orphans(table(spark, sf_dir, "lineitem"), sides).groupBy("l_returnflag").agg(F.count("*").alias("bridge_orphans"))


@registered("""SELECT 'orderkey+linenumber' AS key, count(*) AS total, count(DISTINCT (l_orderkey, l_linenumber)) AS distinct_tuples FROM lineitem
UNION ALL SELECT 'partkey+suppkey', count(*), count(DISTINCT (l_partkey, l_suppkey)) FROM lineitem
UNION ALL SELECT 'orderkey+partkey+suppkey', count(*), count(DISTINCT (l_orderkey, l_partkey, l_suppkey)) FROM lineitem""")
def audit_tuple_uniqueness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A4, A13."""
    lines = table(spark, sf_dir, "lineitem")
    keys = ("orderkey", "linenumber"), ("partkey", "suppkey"), ("orderkey", "partkey", "suppkey")
    return reduce(DataFrame.unionByName, (audit.tuple_counts(lines, *(f"l_{k}" for k in key)).select(F.lit("+".join(key)).alias("key"), "total", "distinct_tuples") for key in keys))


@registered("SELECT p_name, count(*) AS n FROM part GROUP BY p_name HAVING count(*) > 1")
def audit_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A6."""
    return audit.duplicates(table(spark, sf_dir, "part"), "p_name")


@registered("SELECT n_nationkey FROM nation WHERE n_regionkey = n_nationkey")
def audit_self_loop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Over a column that does hold some rows' own keys."""
    return audit.self_loops(table(spark, sf_dir, "nation"), "n_regionkey", "n_nationkey").select("n_nationkey")


_CARDINALITY = "SELECT '{0}' AS reference, CASE WHEN n = 0 THEN 'zero' WHEN n = 1 THEN 'one' ELSE 'many' END AS children, count(*) AS parents FROM (SELECT p.{3}, count(c.{1}) AS n FROM {2} p LEFT JOIN {4} c ON p.{3} = c.{1} GROUP BY p.{3}) GROUP BY ALL"


@registered(" UNION ALL ".join(_CARDINALITY.format(*x) for x in (("orders-lineitem", "l_orderkey", "orders", "o_orderkey", "lineitem"), ("customer-events", "user_id", "customer", "c_custkey", "events"), ("documents-labels", "doc_id", "documents", "doc_id", "labels"))))
def audit_cardinality_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parents by number of children, childless ones included."""
    cases = ("orders", "o_orderkey", "lineitem", "l_orderkey"), ("customer", "c_custkey", "events", "user_id"), ("documents", "doc_id", "labels", "doc_id")
    found = (audit.cardinality(table(spark, sf_dir, p), pk, table(spark, sf_dir, c), fk).select(F.lit(f"{p}-{c}").alias("reference"), "children", "parents") for p, pk, c, fk in cases)
    return reduce(DataFrame.unionByName, found)


# Predicates and edges.

_PREDICATES: dict[str, tuple[str, Callable[[], Column], str]] = {
    "and": ("customer", lambda: (F.col("c_acctbal") > 0) & (F.col("c_mktsegment") == "BUILDING"), "c_acctbal > 0 AND c_mktsegment = 'BUILDING'"),
    "or_not": ("customer", lambda: (F.col("c_acctbal") > 9000) | ~(F.col("c_nationkey") < 20), "c_acctbal > 9000 OR NOT (c_nationkey < 20)"),
    "eq": ("part", lambda: F.col("p_size") == 7, "p_size = 7"),
    "neq": ("part", lambda: F.col("p_size") != 7, "p_size <> 7"),
    "in": ("part", lambda: F.col("p_size").isin(1, 2, 3), "p_size IN (1, 2, 3)"),
    "not_in": ("part", lambda: ~F.col("p_size").isin(1, 2, 3), "p_size NOT IN (1, 2, 3)"),
    "gt": ("orders", lambda: F.col("o_totalprice") > 100000, "o_totalprice > 100000"),
    "lte_string": ("customer", lambda: F.col("c_mktsegment") <= "BUILDING", "c_mktsegment <= 'BUILDING'"),
    "contains": ("part", lambda: F.col("p_name").contains("e"), "contains(p_name, 'e')"),
    "prefix": ("part", lambda: F.col("p_type").startswith("S"), "starts_with(p_type, 'S')"),
    "suffix": ("part", lambda: F.col("p_type").endswith("L"), "ends_with(p_type, 'L')"),
    "equal_fold": ("customer", lambda: equal_fold("c_mktsegment", "building"), "lower(c_mktsegment) = 'building'"),
    "contains_fold": ("customer", lambda: contains_fold("c_mktsegment", "BUILD"), "contains(lower(c_mktsegment), 'build')"),
    "is_nil": ("customer", lambda: F.col("manager").isNull(), "c_custkey % 7 = 0"),
    "not_nil": ("customer", lambda: F.col("manager").isNotNull(), "c_custkey % 7 <> 0"),
    "id": ("orders", lambda: F.col("o_orderkey").between(10, 20), "o_orderkey BETWEEN 10 AND 20"),
}


@registered(" UNION ALL ".join(f"SELECT '{n}' AS predicate, count(*) AS n FROM {t} WHERE {sql}" for n, (t, _, sql) in _PREDICATES.items()))
def filter_predicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q1, Q4-Q12: matches of each kind of predicate; one scan a table."""
    known, parts = catalog(spark, sf_dir), []
    for name in dict.fromkeys(t for t, _, _ in _PREDICATES.values()):
        own = {n: p for n, (t, p, _) in _PREDICATES.items() if t == name}
        counted = known.query(name).aggregate(**{n: F.count_if(p()) for n, p in own.items()})
        parts.append(counted.select(F.explode(F.array(*(F.struct(F.lit(n).alias("predicate"), F.col(n).alias("n")) for n in own))).alias("x")).select("x.*"))
    return reduce(DataFrame.unionByName, parts)


@registered("SELECT p_partkey, p_name, p_size FROM part WHERE p_partkey = 17")
def get_by_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q2, Q3: point lookup of chosen columns."""
    return catalog(spark, sf_dir).get("part", 17).select("p_partkey", "p_name", "p_size").all()


@registered("""SELECT 'first' AS terminal, (SELECT c_name FROM customer ORDER BY c_custkey LIMIT 1) AS found
UNION ALL SELECT 'only', (SELECT p_name FROM part WHERE p_partkey = 17)
UNION ALL SELECT 'only of none', CASE WHEN (SELECT count(*) FROM part WHERE p_partkey = -1) = 0 THEN 'NotFound' END
UNION ALL SELECT 'only of many', CASE WHEN (SELECT count(*) FROM part) > 1 THEN 'NotSingular' END
UNION ALL SELECT 'exist', (count(*) > 0)::VARCHAR FROM orders
UNION ALL SELECT 'count', count(*)::VARCHAR FROM orders
UNION ALL SELECT 'ids', sum(c_custkey)::BIGINT::VARCHAR FROM customer
UNION ALL SELECT 'scalars', string_agg(r_name, ',' ORDER BY r_regionkey) FROM region""")
def terminals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q33-Q38: first, only, its errors, exist, count, ids, scalars."""
    db = catalog(spark, sf_dir)

    def error(query: Query) -> str | None:
        try:
            query.only()
        except (NotFound, NotSingular) as raised:
            return type(raised).__name__
        return None

    found = [
        ("first", db.query("customer").order("c_custkey").first()["c_name"]),
        ("only", db.get("part", 17).only()["p_name"]),
        ("only of none", error(db.get("part", -1))),
        ("only of many", error(db.query("part"))),
        ("exist", str(db.query("orders").exist()).lower()),
        ("count", str(db.query("orders").count())),
        ("ids", str(db.query("customer").ids().agg(F.sum("c_custkey")).first()[0])),
        ("scalars", ",".join(db.query("region").order("r_regionkey").scalars("r_name"))),
    ]
    return spark.createDataFrame(found, "terminal string, found string")


@registered("SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def edge_exists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q13, Q16."""
    return catalog(spark, sf_dir).query("customer").has("orders").ids()


@registered("SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000) AND EXISTS (SELECT 1 FROM nation WHERE n_nationkey = c_nationkey AND n_regionkey = 1)")
def edge_exists_with(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q14, Q16, Q19: predicates on edges both ways."""
    return catalog(spark, sf_dir).query("customer").has("orders", F.col("o_totalprice") > 300000).has("nation", F.col("n_regionkey") == 1).ids()


@registered("""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem WHERE EXISTS (SELECT 1 FROM orders WHERE o_orderkey = l_orderkey AND o_totalprice > 200000)
AND EXISTS (SELECT 1 FROM part WHERE p_partkey = l_partkey AND p_size < 20) AND EXISTS (SELECT 1 FROM supplier WHERE s_suppkey = l_suppkey AND s_nationkey < 12)""")
def edge_ternary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q19: rows that join three entities, with a predicate on each."""
    lines = catalog(spark, sf_dir).query("lineitem").has("orders", F.col("o_totalprice") > 200000).has("part", F.col("p_size") < 20)
    return lines.has("supplier", F.col("s_nationkey") < 12).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").all()


@registered("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM events WHERE user_id = c_custkey AND event_type = 'purchase')")
def edge_not_exists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q15."""
    return catalog(spark, sf_dir).query("customer").has_not("events", F.col("event_type") == "purchase").ids()


@registered(f"""WITH c AS (SELECT *, {_MANAGER} AS manager FROM customer)
SELECT c_custkey FROM c WHERE EXISTS (SELECT 1 FROM c m WHERE m.c_custkey = c.manager AND m.c_acctbal > 0) AND EXISTS (SELECT 1 FROM c r WHERE r.manager = c.c_custkey)""")
def edge_self(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q17: a manager in credit, and someone who reports."""
    return catalog(spark, sf_dir).query("customer").has("managers", F.col("c_acctbal") > 0).has("reports").ids()


@registered("SELECT p_partkey FROM part WHERE EXISTS (SELECT 1 FROM lineitem JOIN supplier ON s_suppkey = l_suppkey WHERE l_partkey = p_partkey AND s_acctbal > 5000)")
def edge_many_to_many(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q18: through the bridge."""
    return catalog(spark, sf_dir).query("part").has("suppliers", F.col("s_acctbal") > 5000).ids()


@registered("SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'MACHINERY')")
def traverse_o2m(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q20."""
    return catalog(spark, sf_dir).query("customer").where(F.col("c_mktsegment") == "MACHINERY").traverse("orders").select("o_orderkey", "o_custkey", "o_totalprice").all()


@registered("SELECT n_nationkey, n_name FROM nation WHERE n_nationkey IN (SELECT c_nationkey FROM customer WHERE c_acctbal > 9900)")
def traverse_m2o(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q20, Q23: many to one, each neighbour once."""
    return catalog(spark, sf_dir).query("customer").where(F.col("c_acctbal") > 9900).traverse("nation").select("n_nationkey", "n_name").all()


@registered("SELECT s_suppkey, s_name FROM supplier WHERE s_suppkey IN (SELECT l_suppkey FROM lineitem JOIN part ON p_partkey = l_partkey WHERE p_size = 1)")
def traverse_m2m(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q22."""
    return catalog(spark, sf_dir).query("part").where(F.col("p_size") == 1).traverse("suppliers").select("s_suppkey", "s_name").all()


@registered(f"SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT {_MANAGER} FROM customer WHERE c_acctbal < 0)")
def traverse_self(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q21."""
    return catalog(spark, sf_dir).query("customer").where(F.col("c_acctbal") < 0).traverse("managers").ids()


@registered("SELECT n_nationkey, coalesce(string_agg(c_custkey::VARCHAR, ',' ORDER BY c_custkey) FILTER (WHERE c_acctbal > 9000), '') AS customers FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY n_nationkey")
def eager_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q24: nations with their customers, empty lists kept."""
    loaded = catalog(spark, sf_dir).query("nation").with_edge("customer", F.col("c_acctbal") > 9000, columns=("c_custkey",)).all()
    return loaded.select("n_nationkey", F.array_join(F.transform("customer", lambda x: x["c_custkey"].cast("string")), ",").alias("customers"))


@registered("SELECT p_partkey, coalesce((SELECT string_agg(s::VARCHAR, ',' ORDER BY s) FROM (SELECT DISTINCT l_suppkey AS s FROM lineitem WHERE l_partkey = p_partkey)), '') AS suppliers FROM part WHERE p_size <= 3")
def eager_load_m2m(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q25."""
    loaded = catalog(spark, sf_dir).query("part").where(F.col("p_size") <= 3).with_edge("suppliers", columns=("s_suppkey",)).all()
    return loaded.select("p_partkey", F.array_join(F.transform("suppliers", lambda x: x["s_suppkey"].cast("string")), ",").alias("suppliers"))


@registered("SELECT c_custkey, n_orders, row_number() OVER (ORDER BY n_orders DESC, c_custkey)::INTEGER AS place FROM (SELECT c_custkey, count(o_orderkey) AS n_orders FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey) ORDER BY n_orders DESC, c_custkey LIMIT 20")
def order_by_neighbor_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q27, Q29: the twenty customers with the most orders."""
    top = catalog(spark, sf_dir).query("customer").with_neighbour_count("orders", "n_orders").order(F.desc("n_orders"), "c_custkey").limit(20).all()
    listed = top.select("c_custkey", "n_orders").groupBy().agg(F.sort_array(F.collect_list(F.struct((-F.col("n_orders")).alias("down"), "c_custkey", "n_orders"))).alias("rows"))
    return listed.select(F.posexplode("rows").alias("i", "x")).select("x.c_custkey", "x.n_orders", (F.col("i") + 1).alias("place"))


@registered("SELECT s_suppkey, n_name FROM supplier JOIN nation ON n_nationkey = s_nationkey ORDER BY n_name, s_suppkey LIMIT 15")
def order_by_neighbor_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q28."""
    return catalog(spark, sf_dir).query("supplier").with_neighbour_field("nation", "n_name", "n_name").order("n_name", "s_suppkey").limit(15).all().select("s_suppkey", "n_name")


@registered("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25 OFFSET 50")
def page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q26, Q29, Q30."""
    return catalog(spark, sf_dir).query("orders").order(F.desc("o_totalprice"), "o_orderkey").offset(50).limit(25).select("o_orderkey", "o_totalprice").all()


@registered("SELECT DISTINCT p_brand, p_size FROM part")
def distinct_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q3, Q31."""
    return catalog(spark, sf_dir).query("part").select("p_brand", "p_size").unique().all()


@registered("SELECT count(DISTINCT p_brand) AS brands, count(DISTINCT p_name) AS names, count(*) AS n FROM part")
def count_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q36, A5."""
    return catalog(spark, sf_dir).query("part").aggregate(brands=F.count_distinct("p_brand"), names=F.count_distinct("p_name"), n=F.count("*"))


def _aggregates() -> dict[str, Column]:
    return {"n": F.count("*"), "sum_quantity": F.round(F.sum("l_quantity"), 2), "mean_price": F.round(F.avg("l_extendedprice"), 2), "min_discount": F.min("l_discount"), "max_tax": F.max("l_tax")}


_AGGREGATES_SQL = "count(*) AS n, round(sum(l_quantity), 2) AS sum_quantity, round(avg(l_extendedprice), 2) AS mean_price, min(l_discount) AS min_discount, max(l_tax) AS max_tax"


@registered(f"SELECT l_returnflag, l_linestatus, {_AGGREGATES_SQL} FROM lineitem GROUP BY l_returnflag, l_linestatus")
def group_aggregate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q41-Q45."""
    return catalog(spark, sf_dir).query("lineitem").group_by("l_returnflag", "l_linestatus").aggregate(**_aggregates())


@registered(f"SELECT {_AGGREGATES_SQL} FROM lineitem")
def global_aggregate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q42-Q45 without groups."""
    return catalog(spark, sf_dir).query("lineitem").aggregate(**_aggregates())


# Mutations.


@registered("SELECT c_custkey, CASE WHEN c_mktsegment = 'BUILDING' THEN c_acctbal + 100 ELSE c_acctbal END AS c_acctbal, CASE WHEN c_mktsegment = 'BUILDING' THEN NULL ELSE c_name END AS c_name FROM customer")
def update_where(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q48, Q49: set one column and clear another."""
    rows = table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal", "c_name", "c_mktsegment")
    return mutate.update_where(rows, F.col("c_mktsegment") == "BUILDING", c_acctbal=F.col("c_acctbal") + 100, c_name=None).drop("c_mktsegment")


@registered("SELECT o_orderkey FROM orders WHERE NOT (o_totalprice < 50000)")
def delete_where(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q50."""
    return mutate.delete_where(table(spark, sf_dir, "orders"), F.col("o_totalprice") < 50000).select("o_orderkey")


@registered("SELECT o_orderkey, CASE WHEN c_custkey IS NULL THEN o_custkey END AS o_custkey FROM orders LEFT JOIN (SELECT c_custkey FROM customer WHERE c_acctbal < 0) ON c_custkey = o_custkey")
def delete_set_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q51: deleted customers clear their orders' key."""
    gone = table(spark, sf_dir, "customer").where("c_acctbal < 0")
    return mutate.on_delete_set_null(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), "o_custkey", gone, "c_custkey")


@registered("SELECT l_returnflag, count(*) AS n FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size > 25) GROUP BY l_returnflag")
def delete_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q51: deleted parts take their bridge rows along."""
    gone = table(spark, sf_dir, "part").where("p_size > 25")
    return mutate.on_delete_cascade(table(spark, sf_dir, "lineitem"), "l_partkey", gone, "p_partkey").groupBy("l_returnflag").agg(F.count("*").alias("n"))


@registered("SELECT count(*) AS n, count(r_name) AS named, max(r_regionkey) AS last FROM (SELECT r_regionkey, r_name FROM region UNION ALL SELECT 100, 'NEW' UNION ALL SELECT 101, NULL)")
def create_bulk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q46, Q47."""
    rows = table(spark, sf_dir, "region").select("r_regionkey", "r_name")
    entity = Entity("region", (Field("r_regionkey", T.IntegerType(), primary_key=True), Field("r_name", nullable=True)))
    new = spark.createDataFrame([(100, "NEW"), (101, None)], "r_regionkey int, r_name string")
    return mutate.create(rows, new, entity).agg(F.count("*").alias("n"), F.count("r_name").alias("named"), F.max("r_regionkey").alias("last"))


# Randomness, counts and links.

_U = uniform_sql(f"'{SEED}'", "'plan'", "'orders'", "c_custkey::VARCHAR")
_DRAW = f"CAST(round(-3.0 * ln(1.0 - {_U})) AS BIGINT)"


def _draws(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("driver_row"), long_tail(uniform(SEED, "plan", "orders", F.col("c_custkey"))).alias("n"))


@registered(f"SELECT c_custkey, {_U} AS u FROM customer")
def rng_uniform(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Draws by position."""
    return table(spark, sf_dir, "customer").select("c_custkey", uniform(SEED, "plan", "orders", F.col("c_custkey")).alias("u"))


@registered(f"SELECT n, count(*) AS drivers FROM (SELECT {_DRAW} AS n FROM customer) GROUP BY n")
def child_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The long tail."""
    return _draws(spark, sf_dir).groupBy("n").agg(F.count("*").alias("drivers"))


def _planned(name: str) -> str:
    u = uniform_sql(f"'{SEED}'", "'plan'", f"'{name}'", "id::VARCHAR")
    return _DRAW.replace(uniform_sql(f"'{SEED}'", "'plan'", "'orders'", "c_custkey::VARCHAR"), u)


@registered(f"""WITH ids AS (SELECT unnest(range(400)) AS id),
profile AS (SELECT sum(least({_planned("Profile")}, 1)) AS n FROM ids), membership AS (SELECT sum(least({_planned("Membership")}, 400 - 1)) AS n FROM ids)
SELECT 'Member' AS entity, 400::BIGINT AS n_rows, 0 AS participants UNION ALL SELECT 'Profile', n::BIGINT, 0 FROM profile UNION ALL SELECT 'Membership', n::BIGINT, 1 FROM membership""")
def planned_caps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A shared key allows one row, a junction with its own entity one less than it has."""
    key = Field("ID", T.LongType(), primary_key=True, auto_increment=True)
    part = lambda n: Field(n, T.LongType(), primary_key=True)
    entities = [
        Entity("Member", (key,)),
        Entity("Profile", (part("MemberID"),), (Reference(("MemberID",), "Member"),)),
        Entity("Membership", (part("AID"), part("BID")), (Reference(("AID",), "Member"), Reference(("BID",), "Member"))),
    ]
    plans = plan_generation(spark, entities, *DependencyGraph(entities).resolve(), Options(SEED, 400))
    return spark.createDataFrame([(p.entity, p.rows, len(p.participants)) for p in plans], "entity string, n_rows long, participants int")


@registered("""WITH RECURSIVE edge(source, target, nullable) AS (VALUES ('Order', 'Contact', false), ('Contact', 'Order', true), ('Contact', 'Address', true), ('Address', 'Contact', false), ('Employee', 'Employee', true)),
reach(a, b) AS (SELECT source, target FROM edge UNION SELECT r.a, e.target FROM reach r JOIN edge e ON r.b = e.source),
cut AS (SELECT source, target FROM edge e WHERE nullable AND EXISTS (SELECT 1 FROM reach r WHERE r.a = e.target AND r.b = e.source)),
kept AS (SELECT source, target FROM edge EXCEPT SELECT source, target FROM cut),
depth(name, d) AS (SELECT DISTINCT source, 0 FROM edge WHERE source NOT IN (SELECT source FROM kept) UNION ALL SELECT k.source, d + 1 FROM kept k JOIN depth ON k.target = depth.name)
SELECT name AS entity, max(d)::BIGINT AS depth, (SELECT string_agg(target, ',' ORDER BY target) FROM cut WHERE source = name) AS deferred, 'A -> B -> A; C -> D -> C' AS stuck FROM depth GROUP BY name""")
def cycle_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nullable references that close a cycle are deferred; every required cycle is named."""
    make = lambda name, *refs: Entity(name, (), tuple(Reference((f"{t}ID",), t, n) for t, n in refs))
    order, deferred = DependencyGraph([make("Order", ("Contact", False)), make("Contact", ("Order", True), ("Address", True)), make("Address", ("Contact", False)), make("Employee", ("Employee", True))]).resolve()
    try:
        DependencyGraph([make("A", ("B", False)), make("B", ("A", False)), make("C", ("D", False)), make("D", ("C", False), ("E", True)), make("E", ("C", False))]).resolve()
        stuck = ""
    except UnsatisfiableCycle as error:
        stuck = str(error).split(": ", 1)[1]
    late = {n: ",".join(sorted(d.target for d in deferred if d.entity == n)) or None for n in order}
    held = {"Order": ["Contact"], "Address": ["Contact"]}
    depth: dict[str, int] = {}
    for name in order:
        depth[name] = max((depth[t] + 1 for t in held.get(name, ())), default=0)
    return spark.createDataFrame([(n, depth[n], late[n], stuck) for n in order], "entity string, depth long, deferred string, stuck string")


@registered(f"SELECT row_number() OVER (ORDER BY driver_row, block_idx) - 1 AS row_idx, driver_row, block_idx FROM (SELECT c_custkey AS driver_row, unnest(range({_DRAW})) AS block_idx FROM customer)")
def expand_children(spark: SparkSession, sf_dir: str) -> DataFrame:
    """L1, L2: children in blocks, densely numbered."""
    return link.dense_children(_draws(spark, sf_dir))


@registered("SELECT o_orderkey, s_suppkey FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS i FROM orders) JOIN (SELECT s_suppkey, row_number() OVER (ORDER BY s_suppkey) - 1 AS j, count(*) OVER () AS n FROM supplier) ON i % n = j")
def round_robin_fk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders take suppliers by turns."""
    orders = _numbered(table(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey")
    suppliers = _numbered(table(spark, sf_dir, "supplier").select("s_suppkey"), "s_suppkey")
    n = suppliers.count()
    turned = orders.withColumn("_turn", link.round_robin(F.col("row_idx"), n))
    named = suppliers.withColumnRenamed("s_suppkey", "_key")
    return link.copy_key(turned, named, "_turn", ("s_suppkey",), ("_key",)).select("o_orderkey", "s_suppkey")


def _numbered(rows: DataFrame, key: str) -> DataFrame:
    """Dense row_idx in the order of an integer key, by prefix sums over ranges of the key."""
    counted = rows.groupBy(F.col(key).cast("long").alias("driver_row")).agg(F.count("*").alias("n"))
    return link.dense_children(counted).select("row_idx", F.col("driver_row").cast(rows.schema[key].dataType).alias(key))


@registered(f"""WITH p AS (SELECT count(*) AS n FROM region), s AS (SELECT 3 AS n)
SELECT driver_row, block_idx, block_idx % (SELECT n FROM p) AS region_row, (block_idx // (SELECT n FROM p)) % 3 AS size_row
FROM (SELECT c_custkey AS driver_row, unnest(range(least({_DRAW}, 15))) AS block_idx FROM customer)""")
def junction_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mixed-radix participants, no pair twice below a driver row."""
    from weftline.plans.generation import junction_index

    regions = table(spark, sf_dir, "region").count()
    counts = _draws(spark, sf_dir).withColumn("n", F.least("n", F.lit(regions * 3).cast("long")))
    first, second = junction_index(F.col("block_idx"), F.col("driver_row"), [regions, 3], [False, False])
    return link.expand_children(counts).select("driver_row", "block_idx", first.alias("region_row"), second.alias("size_row"))


@registered("""WITH s AS (SELECT row_number() OVER (ORDER BY s_suppkey) - 1 AS d, count(*) OVER () AS n FROM supplier)
SELECT d AS driver_row, (b % (n - 1) + d + 1) % n AS partner FROM (SELECT d, n, unnest(range(least(3, n - 1))) AS b FROM s)""")
def self_junction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs with one's own kind, never with oneself."""
    from weftline.plans.generation import junction_index

    n = table(spark, sf_dir, "supplier").count()
    counts = spark.range(n).select(F.col("id").alias("driver_row"), F.lit(min(3, n - 1)).cast("long").alias("n"))
    partner = junction_index(F.col("block_idx"), F.col("driver_row"), [n - 1], [True])[0]
    return link.expand_children(counts).select("driver_row", partner.alias("partner"))


@registered("""WITH c AS (SELECT c_custkey, row_number() OVER (ORDER BY c_custkey) - 1 AS i, count(*) OVER () AS n FROM customer)
SELECT c.c_custkey, p.c_custkey AS manager FROM c LEFT JOIN c p ON p.i = CASE WHEN c.n > 1 THEN (c.i + 1) % c.n END""")
def deferred_self_ref(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second pass of a self reference."""
    people = _numbered(table(spark, sf_dir, "customer").select("c_custkey"), "c_custkey")
    turned = people.withColumn("_turn", link.deferred_parent(F.col("row_idx"), people.count(), True))
    return link.copy_key(turned, people.withColumnRenamed("c_custkey", "_key"), "_turn", ("manager",), ("_key",)).select("c_custkey", "manager")


# Values.


def _u(entity: str, field: str, *salts: str, row: str = "c_custkey") -> str:
    return uniform_sql(f"'{SEED}'", f"'{entity}'", f"{row}::VARCHAR", f"'{field}'", *(f"'{s}'" for s in salts))


def _rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("row_idx"))


def _values(spark: SparkSession, sf_dir: str, entity: Entity, options: Options = Options(SEED)) -> DataFrame:
    return R.generate(_rows(spark, sf_dir), entity, options)


_PERSON = Entity("Person", (Field("FirstName"), Field("LastName"), Field("Email"), Field("Phone"), Field("City"), Field("Street"), Field("Website")))


def _person_sql(first: str = "first", last: str = "last") -> str:
    def pool(field: str, pool: tuple[str, ...], *salts: str) -> str:
        return pick_sql(pool, _u("Person", field, *salts))

    return f"""SELECT c_custkey AS row_idx, {pool("FirstName", R.FIRST_NAMES)} AS "FirstName", {pool("LastName", R.LAST_NAMES)} AS "LastName",
  lower({pool("FirstName", R.FIRST_NAMES)}) || '.' || lower({pool("LastName", R.LAST_NAMES)}) || '@' || {pool("Email", R.DOMAINS, "domain")} AS "Email",
  lpad(floor({_u("Person", "Phone")} * 10000000000.0)::BIGINT::VARCHAR, 10, '0') AS "Phone",
  {pool("City", R.CITIES)} AS "City", {pool("Street", R.STREETS)} AS "Street",
  'https://www.' || {pool("Website", R.WORDS, "host")} || '.com/' || {pool("Website", R.WORDS, "path")} AS "Website" FROM customer"""


@registered(_person_sql())
def values_person(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coherent people."""
    return _values(spark, sf_dir, _PERSON)


def _check_sql(n: int, weights: tuple) -> str:
    digit = lambda i: f"d[{i + 1}]"
    first = " + ".join(f"{digit(i)} * {w}" for i, w in enumerate(weights[0]))
    second = " + ".join(f"{digit(i)} * {w}" for i, w in enumerate(weights[1][:n]))
    return f"(CASE WHEN ({first}) % 11 < 2 THEN 0 ELSE 11 - ({first}) % 11 END)", second


def _document_sql(field: str, n: int, weights: tuple) -> str:
    first, second = _check_sql(n, weights)
    digits = ", ".join(f"floor({_u('Paper', field, f'digit{i}')} * 10)::INTEGER" for i in range(n))
    return f"""(SELECT array_to_string(d, '') || a || CASE WHEN ({second} + a * {weights[1][n]}) % 11 < 2 THEN 0 ELSE 11 - ({second} + a * {weights[1][n]}) % 11 END
      FROM (SELECT d, {first} AS a FROM (SELECT [{digits}] AS d)))"""


@registered(f"""SELECT c_custkey AS row_idx, {_document_sql("Cpf", 9, R.CPF_WEIGHTS)} AS "Cpf", {_document_sql("Cnpj", 12, R.CNPJ_WEIGHTS)} AS "Cnpj" FROM customer""")
def values_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V1: document numbers with their check digits."""
    return _values(spark, sf_dir, Entity("Paper", (Field("Cpf"), Field("Cnpj"))))


_LINE = Entity("Line", (Field("Price", T.DoubleType()), Field("Quantity", T.LongType()), Field("Total", T.DoubleType())))
_PRICE, _QUANTITY = f"round(1 + {_u('Line', 'Price')} * 998.99, 2)", f"(1 + floor({_u('Line', 'Quantity')} * 20))::BIGINT"


@registered(f"""SELECT c_custkey AS row_idx, {_PRICE} AS "Price", {_QUANTITY} AS "Quantity", round({_PRICE} * {_QUANTITY} * 100) / 100 AS "Total" FROM customer""")
def values_money(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals follow price and quantity."""
    return _values(spark, sf_dir, _LINE)


_LOG = Entity("Log", (Field("CreatedAt", T.TimestampType()), Field("UpdatedAt", T.TimestampType()), Field("DeletedAt", T.TimestampType(), soft_delete=True), Field("SeenAt", T.TimestampType())))
_CREATED = f"({R.NOW_MICROS} - floor({_u('Log', 'CreatedAt')} * {float(R.CREATED_DAYS * R.DAY_MICROS)})::BIGINT)"
_UPDATED = f"({_CREATED} + floor({_u('Log', 'UpdatedAt', 'later')} * {float(R.UPDATED_DAYS * R.DAY_MICROS)})::BIGINT)"
_SEEN = f"({R.NOW_MICROS} - floor({_u('Log', 'SeenAt')} * {float(R.CREATED_DAYS * R.DAY_MICROS)})::BIGINT)"
_DELETED = f"CASE WHEN {_u('Log', 'DeletedAt', 'visible')} >= {R.VISIBLE} THEN CASE WHEN {_UPDATED} >= {R.NOW_MICROS} THEN {_UPDATED} ELSE {_UPDATED} + floor({_u('Log', 'DeletedAt', 'when')} * ({R.NOW_MICROS} - {_UPDATED}))::BIGINT END END"


@registered(f"SELECT c_custkey AS row_idx, {_CREATED} AS created, {_UPDATED} AS updated, {_SEEN} AS seen FROM customer")
def values_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Instants in microseconds."""
    made = _values(spark, sf_dir, _LOG)
    return made.select("row_idx", *(F.unix_micros(c).alias(a) for c, a in (("CreatedAt", "created"), ("UpdatedAt", "updated"), ("SeenAt", "seen"))))


@registered(f"SELECT c_custkey AS row_idx, {_DELETED} AS deleted FROM customer")
def values_soft_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V12."""
    return _values(spark, sf_dir, _LOG).select("row_idx", F.unix_micros("DeletedAt").alias("deleted"))


@registered(f"SELECT count(*) AS total, count({_DELETED}) AS deleted, count(*) - count({_DELETED}) AS visible FROM customer")
def audit_soft_delete_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A8, A9, V12."""
    return audit.soft_delete_split(_values(spark, sf_dir, _LOG), "DeletedAt")


_WORDS3 = lambda field: " || ' ' || ".join(pick_sql(R.WORDS, _u("Thing", field, f"word{i}")) for i in range(3))


@registered(f"""SELECT c_custkey AS row_idx, substr({_WORDS3("Note")}, 1, 10) AS "Note", {_WORDS3("Body")} AS "Body",
  floor({_u("Thing", "Rank")} * 1001)::BIGINT AS "Rank", {_u("Thing", "Weight")} * 1000 AS "Weight", {_u("Thing", "Active")} < 0.5 AS "Active" FROM customer""")
def values_generic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V13-V15, V22, V25."""
    fields = Field("Note", size=10), Field("Body"), Field("Rank", T.LongType()), Field("Weight", T.DoubleType()), Field("Active", T.BooleanType())
    return _values(spark, sf_dir, Entity("Thing", fields))


@registered(f"""SELECT c_custkey AS row_idx, {pick_sql(R.PT_FIRST_NAMES, _u("Pessoa", "FirstName"))} AS "FirstName", {pick_sql(R.PT_LAST_NAMES, _u("Pessoa", "LastName"))} AS "LastName",
  {pick_sql(R.PT_CITIES, _u("Pessoa", "City"))} AS "City", {pick_sql(R.PT_STREET_TYPES, _u("Pessoa", "Street", "kind"))} || ' ' || {pick_sql(R.PT_STREETS, _u("Pessoa", "Street", "name"))} AS "Street",
  '+55 (' || {pick_sql(R.PT_AREAS, _u("Pessoa", "Phone", "area"))} || ') 9' || lpad(floor({_u("Pessoa", "Phone", "front")} * 10000)::BIGINT::VARCHAR, 4, '0') || '-' || lpad(floor({_u("Pessoa", "Phone", "back")} * 10000)::BIGINT::VARCHAR, 4, '0') AS "Phone" FROM customer""")
def values_locale(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V17-V20."""
    fields = tuple(map(Field, ("FirstName", "LastName", "City", "Street", "Phone")))
    return _values(spark, sf_dir, Entity("Pessoa", fields), Options(SEED, locale="pt_BR"))


@registered(f"""SELECT c_custkey AS row_idx, CASE WHEN {_u("Opt", "Rank", "NilRate")} >= 0.25 THEN floor({_u("Opt", "Rank")} * 1001)::BIGINT END AS "Rank" FROM customer""")
def nil_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V23, V24, D4."""
    return _values(spark, sf_dir, Entity("Opt", (Field("Rank", T.LongType(), nullable=True),)), Options(SEED, nil_rate=0.25))


@registered("SELECT count(*) AS total, 0::BIGINT AS total_off, 0::BIGINT AS email_off FROM customer")
def audit_coherence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Generated values agree with each other."""
    made = R.generate(_values(spark, sf_dir, _PERSON), _LINE, Options(SEED))
    total = F.abs(F.col("Total") - F.col("Price") * F.col("Quantity")) <= 0.011
    email = F.col("Email").startswith(F.concat(F.lower("FirstName"), F.lit("."), F.lower("LastName"), F.lit("@")))
    return audit.violations(made, total_off=total, email_off=email & (F.col("Street") != ""))


# Uniqueness.


@registered("SELECT doc_id AS row_idx FROM (SELECT doc_id, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS r FROM documents WHERE text IS NOT NULL) WHERE r > 1")
def unique_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows whose text an earlier row has."""
    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("row_idx"), F.sha2("text", 256).alias("text"))
    return unique.conflicts(rows, ("text",))


_SUFFIX = f"'-' || floor({uniform_sql(f'{chr(39)}{SEED}{chr(39)}', chr(39) + 'part' + chr(39), 'p_partkey::VARCHAR', chr(39) + 'p_name' + chr(39))} * 1000000000)::BIGINT::VARCHAR"


@registered(f"SELECT p_partkey, CASE WHEN row_number() OVER (PARTITION BY p_name ORDER BY p_partkey) = 1 THEN p_name ELSE substr(p_name, 1, (20 - length({_SUFFIX}))::INTEGER) || {_SUFFIX} END AS p_name FROM part")
def unique_rewrite_single(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One round of suffixes within 20 characters."""
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("row_idx"), "p_name")
    hit = unique.conflicts(rows, ("p_name",)).withColumn("_hit", F.lit(True))
    fresh = unique.suffixed(F.col("p_name"), 20, uniform(SEED, "part", F.col("row_idx"), "p_name"))
    joined = rows.join(hit, "row_idx", "left")
    return joined.select(F.col("row_idx").alias("p_partkey"), F.when(F.col("_hit"), fresh).otherwise(F.col("p_name")).alias("p_name"))


@registered("""SELECT count(*) AS total, count(*) AS brand_names, count(*) AS type_names, 0::BIGINT AS too_long, count(*) FILTER (WHERE b = 1 AND t = 1) AS kept
FROM (SELECT row_number() OVER (PARTITION BY p_brand, p_name ORDER BY p_partkey) AS b, row_number() OVER (PARTITION BY p_type, p_name ORDER BY p_partkey) AS t FROM part)""")
def unique_rewrite_joint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two constraints that share a field, repaired together; the first row of each pair keeps its values."""
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("row_idx"), "p_brand", "p_type", "p_name")
    entity = Entity("part", (Field("p_brand"), Field("p_type"), Field("p_name", size=24)), (), (("p_brand", "p_name"), ("p_type", "p_name")))
    before = rows.select("row_idx", F.struct("p_brand", "p_type", "p_name").alias("before"))
    fixed = unique.ensure_unique(rows, entity, SEED).join(before, "row_idx")
    same = F.struct("p_brand", "p_type", "p_name") == F.col("before")
    return fixed.agg(
        F.count("*").alias("total"), F.count_distinct("p_brand", "p_name").alias("brand_names"), F.count_distinct("p_type", "p_name").alias("type_names"),
        F.count_if(F.length("p_name") > 24).alias("too_long"), F.count_if(same).alias("kept"),
    )


# Plans of a declared model.

_COVERED = Declared(
    [
        Entity("Customer", (Field("ID", T.LongType(), primary_key=True, auto_increment=True), Field("Bio", nullable=True), Field("Active", T.BooleanType()), Field("Code", size=5))),
        Entity("Order", (Field("ID", T.LongType(), primary_key=True, auto_increment=True), Field("CustomerID", T.LongType())), (Reference(("CustomerID",), "Customer"),)),
    ]
)


@registered("SELECT * FROM (VALUES ('Customer', 3::BIGINT, NULL::VARCHAR), ('Order', 3, '0,1,2')) AS t(entity, n_rows, children)")
def coverage_plan_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G18, G19, G21-G24."""
    entities = _COVERED.entities()
    plans = plan_coverage(spark, entities, *DependencyGraph(entities).resolve())
    counts = {p.entity: ",".join(map(str, coverage_counts(3, None, p.rows))) for p in plans if p.children is not None}
    return spark.createDataFrame([(p.entity, p.rows, counts.get(p.entity)) for p in plans], "entity string, n_rows long, children string")


@registered("SELECT * FROM (VALUES ('Bio', true, true, false, false, false), ('Code', false, true, true, true, true)) AS t(field, has_null, has_value, has_length_0, has_length_1, has_length_5)")
def audit_boundary_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every boundary state occurs."""
    entity = _COVERED.entities()[0]
    rows = apply_overrides(R.generate(spark.range(3).withColumnRenamed("id", "row_idx"), entity, Options(SEED)), entity)
    bio = audit.states(rows, "Bio").withColumns({f"has_length_{k}": F.lit(False) for k in (0, 1, 5)})
    return bio.select(F.lit("Bio").alias("field"), "*").unionByName(audit.states(rows, "Code", 5).select(F.lit("Code").alias("field"), "*"))


@registered("""WITH RECURSIVE e(child, parent) AS (VALUES """ + ", ".join(f"('{c}', '{p}')" for c, _, p, _ in REFERENCES) + """),
depth(name, d) AS (SELECT DISTINCT parent, 0 FROM e WHERE parent NOT IN (SELECT child FROM e) UNION SELECT e.child, d + 1 FROM e JOIN depth ON e.parent = depth.name)
SELECT name AS entity, max(d)::BIGINT AS depth FROM depth GROUP BY name""")
def insertion_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities of the driver tables by depth; each comes after all it refers to."""
    names = sorted({x for c, _, p, _ in REFERENCES for x in (c, p)})
    entities = [Entity(n, (), tuple(Reference((fk,), p) for c, fk, p, _ in REFERENCES if c == n)) for n in names]
    order, _ = DependencyGraph(entities).resolve()
    depth: dict[str, int] = {}
    for name in order:
        depth[name] = max((depth[p] + 1 for c, _, p, _ in REFERENCES if c == name), default=0)
    return spark.createDataFrame(list(depth.items()), "entity string, depth long")


@registered("SELECT count(*) AS customers, count(*) AS emails, 0::BIGINT AS orphan_orders, 0::BIGINT AS orphan_items, 0::BIGINT AS totals_off FROM range(200)")
def seed_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A required chain, seeded and audited."""
    from weftline.plans.engine import Engine

    key = Field("ID", T.LongType(), primary_key=True, auto_increment=True)
    model = Declared(
        [
            Entity("Customer", (key, Field("Email", unique=True, size=40))),
            Entity("Order", (key, Field("CustomerID", T.LongType()), Field("Street")), (Reference(("CustomerID",), "Customer"),)),
            Entity("Item", (key, Field("OrderID", T.LongType()), *_LINE.fields), (Reference(("OrderID",), "Order"),)),
        ]
    )
    made = Engine(spark).seed(model, Options(SEED, 200))
    customers, orders, items = made["Customer"], made["Order"], made["Item"]
    people = customers.agg(F.count("*").alias("customers"), F.count_distinct("Email").alias("emails"))
    lost = audit.orphans(orders, ("CustomerID",), customers, ("ID",)).agg(F.count("*").alias("orphan_orders"))
    lost_items = audit.orphans(items, ("OrderID",), orders, ("ID",)).agg(F.count("*").alias("orphan_items"))
    off = audit.violations(items, totals_off=F.abs(F.col("Total") - F.col("Price") * F.col("Quantity")) <= 0.011).select("totals_off")
    # One row each: constants in size.
    return people.crossJoin(F.broadcast(lost)).crossJoin(F.broadcast(lost_items)).crossJoin(F.broadcast(off))


def _columns(name: str, key: str, to: dict[str, str]) -> str:
    target = "CASE column_name " + " ".join(f"WHEN '{c}' THEN '{t}'" for c, t in to.items()) + " END" if to else "NULL::VARCHAR"
    return f"SELECT '{name}' AS entity, column_name AS field, column_type = 'VARCHAR' AS is_string, column_type IN ('INTEGER', 'BIGINT', 'HUGEINT') AS is_integer, column_name = '{key}' AS is_key, {target} AS refers_to FROM (DESCRIBE {name})"


@registered(" UNION ALL ".join(_columns(n, TABLE_KEYS[n], {fk: p for c, fk, p, _ in REFERENCES if c == n}) for n in ("region", "nation", "customer", "orders")))
def read_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities, fields, keys and references of existing tables."""
    names = ("region", "nation", "customer", "orders")
    model = read_tables({n: table(spark, sf_dir, n) for n in names}, {n: (TABLE_KEYS[n],) for n in names}, {n: tuple(Reference((fk,), p) for c, fk, p, _ in REFERENCES if c == n) for n in names})
    rows = []
    for e in model.entities():
        to = {f: r.target for r in e.references for f in r.fields}
        rows += [(e.name, f.name, f.is_string, f.is_integer, f.primary_key, to.get(f.name)) for f in e.fields]
    return spark.createDataFrame(rows, "entity string, field string, is_string boolean, is_integer boolean, is_key boolean, refers_to string")


@dataclass
class _Region:
    r_regionkey: int = column(pk=True, kind="int32")
    r_name: str = column()


@dataclass
class _Nation:
    references = (belongs_to("_Region", "n_regionkey"),)
    n_nationkey: int = column(pk=True, kind="int32")
    n_name: str = column()
    n_regionkey: int = column(kind="int32")


@dataclass
class _Customer:
    # Orders don't say whose they are: their customer does.
    references = (belongs_to("_Nation", "c_nationkey"),)
    children = (has_many("_Orders", "o_custkey"),)
    c_custkey: int = column(pk=True)
    c_name: str = column()
    c_nationkey: int = column(kind="int32")
    c_acctbal: float = column()
    c_mktsegment: str = column()


@dataclass
class _Orders:
    o_orderkey: int = column(pk=True)
    o_custkey: int = column()
    o_orderstatus: str = column()
    o_totalprice: float = column()
    o_orderdate: datetime.datetime = column()
    o_orderpriority: str = column()


def _class_sql(name: str) -> str:
    to = "CASE column_name " + " ".join(f"WHEN '{fk}' THEN '{p}'" for _, fk, p, _ in REFERENCES) + " END"
    kind = "CASE column_type WHEN 'INTEGER' THEN 'int' WHEN 'VARCHAR' THEN 'string' ELSE lower(column_type) END"
    return f"SELECT '{name}' AS entity, column_name AS field, {kind} AS type, column_name = '{TABLE_KEYS[name]}' AS is_key, {to} AS refers_to FROM (DESCRIBE {name})"


@registered(" UNION ALL ".join(map(_class_sql, ("region", "nation", "customer", "orders"))))
def read_classes_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes that describe existing tables give those tables' fields, types, keys and references."""
    # A class that is given twice counts once.
    model = read_classes(_Region, _Nation, _Customer, _Orders, _Nation)
    rows = []
    for e in model.entities():
        to = {f: r.target.strip("_").lower() for r in e.references for f in r.fields}
        rows += [(e.name.strip("_").lower(), f.name, f.type.simpleString(), f.primary_key, to.get(f.name)) for f in e.fields]
    return spark.createDataFrame(rows, "entity string, field string, type string, is_key boolean, refers_to string")


@registered("SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN 1 WHEN o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING') THEN NULL WHEN o_orderkey % 5 = 0 AND o_custkey % 2 = 1 THEN NULL ELSE o_custkey END AS o_custkey FROM orders")
def edge_mutations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q48: edges of a set of parents are cleared, some removed, some added."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    building = table(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING'")
    odd = orders.where("o_orderkey % 5 = 0 and o_custkey % 2 = 1").select(F.col("o_orderkey").alias("child"), F.col("o_custkey").alias("parent"))
    moved = orders.where("o_orderkey % 7 = 0").select(F.col("o_orderkey").alias("child"), F.lit(1).cast(orders.schema["o_custkey"].dataType).alias("parent"))
    rows = mutate.clear_children(orders, "o_custkey", building, "c_custkey")
    return mutate.add_children(mutate.remove_children(rows, "o_orderkey", "o_custkey", odd), "o_orderkey", "o_custkey", moved)


@registered("""SELECT n_nationkey, n_name, n_regionkey FROM nation UNION ALL SELECT 100 + i, upper('land ' || i), 1 FROM range(3) AS t(i)""")
def hooked_create(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q47, Q52, Q54: rows from a list, checked, and a hook that only creates go through."""
    db = catalog(spark, sf_dir)
    upper = lambda m, rows: rows.withColumn("n_name", F.upper("n_name"))
    db.hooks = [hooks.only_if(hooks.both(hooks.on_tables("nation"), hooks.has_fields("n_name")), hooks.on(upper, hooks.CREATE)), hooks.reject(hooks.DELETE)]
    nation = db.tables["nation"].select("n_nationkey", "n_name", "n_regionkey")
    entity = Entity("nation", (Field("n_nationkey", T.LongType(), primary_key=True), Field("n_name")))
    made = mutate.create_mapped(nation, range(3), lambda item, i: {"n_nationkey": 100 + i, "n_name": f"land {item}", "n_regionkey": 1}, entity)
    return db.write("nation", hooks.CREATE, made, ("n_nationkey", "n_name", "n_regionkey"))


@registered("SELECT count(*) FILTER (WHERE o_orderkey % 3 <> 0) AS only_left, count(*) FILTER (WHERE o_orderkey % 3 <> 0) AS only_right FROM orders")
def compare_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that two runs do not share."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    return audit.same_rows(orders, orders.withColumn("o_custkey", F.when(F.col("o_orderkey") % 3 == 0, F.col("o_custkey")).otherwise(-F.col("o_custkey") - 1)))
