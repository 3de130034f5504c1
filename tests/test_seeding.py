import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.errors import InvalidScale, MissingSession, UnsatisfiableUniqueness, UnsupportedField
from weftline.functions.rules import generate
from weftline.model import Declared, Entity, Field, Options, Reference
from weftline.operators import audit, unique
from weftline.operators.link import dense_children
from weftline.plans.engine import Engine
from weftline.plans.generation import boosted, coverage_counts, plan_coverage, plan_generation, select_driver
from weftline.plans.graph import DependencyGraph
from weftline.plans.sinks import create_table_sql, truncate, write_parquet

LONG, DOUBLE, BOOL, TIME = T.LongType(), T.DoubleType(), T.BooleanType(), T.TimestampType()
ID = Field("ID", LONG, primary_key=True, auto_increment=True)


def chain():
    return Declared(
        [
            Entity("Root", (ID, Field("Name", unique=True, size=12))),
            Entity("Middle", (ID, Field("RootID", LONG)), (Reference(("RootID",), "Root"),)),
            Entity("Leaf", (ID, Field("MiddleID", LONG), Field("Price", DOUBLE), Field("Quantity", LONG), Field("Total", DOUBLE)), (Reference(("MiddleID",), "Middle"),)),
        ]
    )


def test_chain_has_no_orphans_and_repeats_by_seed(spark):
    made = Engine(spark).seed(chain(), Options(42, 40))
    assert made["Root"].count() == 40
    assert audit.orphans(made["Middle"], ("RootID",), made["Root"], ("ID",)).isEmpty()
    assert audit.orphans(made["Leaf"], ("MiddleID",), made["Middle"], ("ID",)).isEmpty()
    assert made["Root"].select("Name").distinct().count() == 40
    off = F.abs(F.col("Total") - F.col("Price") * F.col("Quantity")) > 0.011
    assert made["Leaf"].where(off).isEmpty()
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    again = Engine(spark).seed(chain(), Options(42, 40))
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    for name, rows in made.items():
        assert audit.same_rows(rows, again[name]).first() == (0, 0)


def test_diamond_junction_and_self_junction(spark):
    model = Declared(
        [
            Entity("Warehouse", (ID,)),
            Entity("Product", (ID,)),
            Entity("Stock", (Field("WarehouseID", LONG, primary_key=True), Field("ProductID", LONG, primary_key=True)), (Reference(("WarehouseID",), "Warehouse"), Reference(("ProductID",), "Product"))),
            Entity("Person", (ID,)),
            Entity("Follow", (Field("FollowingID", LONG, primary_key=True), Field("FollowerID", LONG, primary_key=True)), (Reference(("FollowingID",), "Person"), Reference(("FollowerID",), "Person"))),
            Entity("Profile", (Field("ProductID", LONG, primary_key=True),), (Reference(("ProductID",), "Product"),)),
        ]
    )
    made = Engine(spark).seed(model, Options(3, 4))
    for name, key in (("Stock", ("WarehouseID", "ProductID")), ("Follow", ("FollowingID", "FollowerID")), ("Profile", ("ProductID",))):
        total, distinct = audit.tuple_counts(made[name], *key).first()
        assert total == distinct > 0
        for k in key:
            parent = {"WarehouseID": "Warehouse", "ProductID": "Product"}.get(k, "Person")
            assert audit.orphans(made[name], (k,), made[parent], ("ID",)).isEmpty()
    assert audit.self_loops(made["Follow"], "FollowingID", "FollowerID").isEmpty()


def test_deferred_references_never_point_to_themselves(spark):
    employee = Entity("Employee", (ID, Field("ManagerID", LONG, nullable=True)), (Reference(("ManagerID",), "Employee", True),))
    order = Entity("Order", (ID, Field("ContactID", LONG)), (Reference(("ContactID",), "Contact"),))
    contact = Entity("Contact", (ID, Field("DefaultOrderID", LONG)), (Reference(("DefaultOrderID",), "Order", True),))
    made = Engine(spark).seed(Declared([employee, order, contact]), Options(1, 10))
    assert made["Employee"].where("ManagerID is null or ManagerID = ID").isEmpty()
    assert audit.orphans(made["Contact"], ("DefaultOrderID",), made["Order"], ("ID",), nullable=True).isEmpty()
    alone = Engine(spark).seed(Declared([employee]), Options(1, 1))
    assert alone["Employee"].first()["ManagerID"] is None


def test_coverage_shows_every_state(spark):
    model = Declared([Entity("Customer", (ID, Field("Bio", nullable=True), Field("Active", BOOL), Field("Code", size=5, unique=True))), Entity("Order", (ID, Field("CustomerID", LONG)), (Reference(("CustomerID",), "Customer"),))])
    made = Engine(spark).seed_coverage(model, Options(5, 100, nil_rate=1.0))
    rows = made["Customer"].orderBy("row_idx").collect()
    assert [len(r["Code"]) for r in rows] == [0, 1, 5]
    assert [r["Bio"] is None for r in rows] == [True, False, True]
    assert {r["Active"] for r in rows} == {True, False}
    buckets = {r["children"]: r["parents"] for r in audit.cardinality(made["Customer"], "ID", made["Order"], "CustomerID").collect()}
    assert buckets == {"zero": 1, "one": 1, "many": 1}


def test_plans(spark):
    entities = chain().entities()
    plans = plan_generation(spark, entities, *DependencyGraph(entities).resolve(), Options(1, 30))
    assert plans[0].rows == 30
    assert plans[1].rows == plans[1].children.agg(F.sum("n")).first()[0]
    with pytest.raises(InvalidScale, match="-1"):
        plan_generation(spark, entities, *DependencyGraph(entities).resolve(), Options(1, -1))
    assert [p.rows for p in plan_coverage(spark, entities, *DependencyGraph(entities).resolve())] == [3, 3, 3]
    assert all(p.rows == 0 for p in plan_generation(spark, entities, *DependencyGraph(entities).resolve(), Options(1, 0)))


def test_backstop_over_seeds(spark):
    """A required, driven entity gets a row whenever its driver has one."""
    entities = [Entity("Root", (ID,)), Entity("Left", (ID,), (Reference(("RootID",), "Root"),)), Entity("Merge", (ID,), (Reference(("LeftID",), "Left"),))]
    for seed in range(12):
        plans = {p.entity: p.rows for p in plan_generation(spark, entities, *DependencyGraph(entities).resolve(), Options(seed, 1))}
        assert plans["Left"] >= 1


def test_driver_prefers_a_coverable_key():
    refs = Reference(("AuditID",), "Audit"), Reference(("CourseID",), "Course"), Reference(("StudentID",), "Student")
    bridge = Entity("Enrolment", (Field("CourseID", LONG, primary_key=True), Field("StudentID", LONG, primary_key=True), Field("AuditID", LONG)), refs)
    assert select_driver(bridge, set()).target == "Course"


def test_counts_helpers():
    assert coverage_counts(4, None, 0) == [0, 1, 2, 0]
    assert coverage_counts(3, 1, 0) == [0, 1, 1]
    assert boosted([0, 0], 1, 5) == [1, 1]
    assert boosted([1, 0, 2], None, 7) == [3, 1, 3] or sum(boosted([1, 0, 2], None, 7)) == 7


def test_dense_children_over_buckets(spark):
    counts = spark.range(70000).select(F.col("id").alias("driver_row"), (F.col("id") % 3).alias("n"))
    rows = dense_children(counts)
    n, low, high, distinct = rows.agg(F.count("*"), F.min("row_idx"), F.max("row_idx"), F.count_distinct("row_idx")).first()
    assert (n, low, high) == (distinct, 0, n - 1)


def test_rules_by_row(spark):
    fields = Field("first_name", nullable=True), Field("LastName"), Field("Email"), Field("CreatedAt", TIME), Field("UpdatedAt", TIME), Field("DeletedAt", TIME, soft_delete=True), Field("Note", size=4), Field("Flag", BOOL), Field("Cpf")
    rows = generate(spark.range(600).withColumnRenamed("id", "row_idx"), Entity("P", fields), Options(9, nil_rate=0.3))
    made = rows.collect()
    assert 0.2 < sum(r["first_name"] is None for r in made) / 600 < 0.4
    for r in made:
        assert r["Email"] is not None
        if r["first_name"]:
            assert r["Email"].startswith(f"{r['first_name']}.{r['LastName']}@".lower())
        assert r["UpdatedAt"] >= r["CreatedAt"]
        assert r["DeletedAt"] is None or r["DeletedAt"] >= r["UpdatedAt"]
        assert len(r["Note"]) <= 4
        assert len(r["Cpf"]) == 11
    assert 0 < sum(r["DeletedAt"] is not None for r in made) < 120
    one = generate(spark.range(17, 18).withColumnRenamed("id", "row_idx"), Entity("P", fields), Options(9, nil_rate=0.3)).first()
    assert one == next(r for r in made if r["row_idx"] == 17)
    with pytest.raises(UnsupportedField, match="P.Blob"):
        generate(spark.range(1).withColumnRenamed("id", "row_idx"), Entity("P", (Field("Blob", T.BinaryType()),)), Options())


def test_unique_single_and_joint(spark):
    entity = Entity("Invoice", (Field("Series", size=3), Field("Number", size=3), Field("Code", size=4, unique=True)), (), (("Series", "Number"), ("Code", "Number")))
    data = [(i, "é" * 3 if i % 2 else "ab", ["1", "2"][i % 2] if i % 9 else None, ["aaaa", "bbbb", "é€ö9"][i % 3]) for i in range(60)]
    rows = spark.createDataFrame(data, "row_idx long, Series string, Number string, Code string")
    fixed = unique.ensure_unique(rows, entity, 3)
    for key in (("Series", "Number"), ("Code", "Number"), ("Code",)):
        assert unique.conflicts(fixed, key).isEmpty()
    got = {r["row_idx"]: r for r in fixed.collect()}
    assert got[0]["Code"] == "aaaa" and got[0]["Number"] is None
    assert all(len(v) <= 4 for r in got.values() for v in (r["Series"], r["Number"] or "", r["Code"]))
    single = spark.createDataFrame([(i, "x") for i in range(200)], "row_idx long, C string")
    with pytest.raises(UnsatisfiableUniqueness, match="E.C"):
        unique.ensure_unique(single, Entity("E", (Field("C", size=1, unique=True),)), 1)


def test_tight_domain_takes_the_lowest_free_suffix(spark, monkeypatch):
    monkeypatch.setattr(unique, "ROUNDS", 1)
    rows = spark.createDataFrame([(i, "a") for i in range(9)], "row_idx long, C string")
    fixed = unique.ensure_unique(rows, Entity("E", (Field("C", size=2, unique=True),)), 1)
    assert fixed.select("C").distinct().count() == 9


def test_sinks_and_guards(spark, tmp_path):
    made = Engine(spark).seed(chain(), Options(2, 5))
    write_parquet(made, str(tmp_path), storage={"Root": {"Name": "root_name"}})
    back = spark.read.parquet(f"{tmp_path}/Root")
    assert back.columns == ["ID", "root_name"] and back.count() == 5
    truncate(spark, str(tmp_path), chain().entities()[0])
    assert spark.read.parquet(f"{tmp_path}/Root").count() == 0
    assert create_table_sql(chain().entities()[0]).startswith("CREATE TABLE Root (ID bigint NOT NULL")
    with pytest.raises(MissingSession):
        Engine(None)


def test_lowest_free_suffixes_by_rank(spark):
    """Straight to the last resort: suffixes that others have are passed over, longer ones follow."""
    entity = Entity("E", (Field("C", size=4, unique=True),))
    taken = ["ab-0", "ab-3", "ab-9", "abcd"] + ["abcd"] * 9 + ["a-10", "a-12", "zz"]
    rows = spark.createDataFrame(list(enumerate(taken)), "row_idx long, C string")
    fixed = unique._by_rank(rows, entity, unique.keys_of(entity), "row_idx", "unique")
    got = [r["C"] for r in fixed.orderBy("row_idx").collect()]
    assert got == taken[:4] + ["ab-1", "ab-2", "ab-4", "ab-5", "ab-6", "ab-7", "ab-8"] + ["a-11", "a-13"] + taken[-3:]
