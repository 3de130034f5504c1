import subprocess
import sys
from dataclasses import dataclass
from datetime import datetime

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.errors import ConstraintFailed, InvalidReference, NotFound, NotSingular, UnsupportedField, ValidationFailed
from weftline.model import Entity, Field, Reference
from weftline.operators import hooks, mutate
from weftline.operators.query import Catalog, Edge
from weftline.sources.readers import Schema, SchemaEdge, belongs_to, column, has_many, many_to_many, read_classes, read_schema, read_schemas, read_tables, spark_type


@dataclass
class Address:
    street: str = ""
    city: str = column(size=30)


@dataclass
class Author:
    id: int = column(pk=True)
    name: str = column(size=20, unique=True)
    address: Address = None
    deleted_at: datetime | None = column(soft_delete=True)
    links = (many_to_many("Tag", "author_tags"),)


@dataclass
class Tag:
    id: int = column(pk=True)
    label: str = ""
    links = (many_to_many("Author", "author_tags"),)
    children = (has_many("Post", "tag_id"),)
    polymorphic = ("Owner",)


@dataclass
class Post:
    id: int = column(pk=True)
    author_id: int = column(not_null=True)
    tag_id: int = 0
    nick: str | None = column(storage="nick_name")
    references = (belongs_to("Author", "author_id"),)
    unique_together = (("author_id", "nick"), ("nick",))


def test_classes():
    model = read_classes(Author, Tag, Post, Post)
    found = {e.name: e for e in model.entities()}
    assert set(found) == {"Author", "Tag", "Post", "author_tags"}
    author = found["Author"]
    assert [f.name for f in author.fields] == ["id", "name", "street", "city", "deleted_at"]
    assert author.field("id").auto_increment and author.field("deleted_at").soft_delete and author.field("city").size == 30
    post = found["Post"]
    assert [(r.target, r.fields, r.nullable) for r in post.references] == [("Author", ("author_id",), False), ("Tag", ("tag_id",), True)]
    assert post.unique_constraints == (("author_id", "nick"),)
    assert [r.target for r in found["author_tags"].references] == ["Author", "Tag"]
    assert model.skipped[0].entity == "Tag"
    assert model.storage["Post"]["nick"] == "nick_name"


def test_composite_reference_alignment_and_types(spark):
    @dataclass
    class Target:
        b: int = column(pk=True)
        a: int = column(pk=True)

    @dataclass
    class Child:
        id: int = column(pk=True)
        fa: int = 0
        fb: int = 0
        references = (belongs_to("Target", "fa", "fb"),)
        key_of = {"fa": "a", "fb": "b"}

    child = read_classes(Target, Child).entities()[1]
    assert child.references[0].fields == ("fb", "fa")
    Child.references = (belongs_to("Target", "fa"),)
    with pytest.raises(InvalidReference, match="Child"):
        read_classes(Target, Child)
    assert spark_type("uint64") == T.DecimalType(20, 0)
    with pytest.raises(UnsupportedField, match="json"):
        spark_type("json", "X.y")
    with pytest.raises(UnsupportedField):
        read_schema("X", T.StructType([T.StructField("a", T.ArrayType(T.LongType()))]))
    tables = read_tables({"t": spark.range(3)}, {"t": ("id",)}, {"t": (Reference(("id",), "t"),)})
    assert tables.entities()[0].primary_key == ("id",)


@pytest.fixture(scope="module")
def shop(spark):
    people = spark.createDataFrame([(1, "Ann", None), (2, "Bob", 1), (3, "Cy", 1)], "id long, name string, boss long")
    orders = spark.createDataFrame([(10, 1, 5.0), (11, 1, 7.0), (12, 2, None)], "oid long, person long, price double")
    return Catalog(
        {"people": people, "orders": orders},
        {"people": "id", "orders": "oid"},
        {("people", "orders"): Edge("orders", "id", "person"), ("people", "reports"): Edge("people", "id", "boss"), ("people", "managers"): Edge("people", "boss", "id")},
    )


def test_query_builder(shop):
    people = shop.query("people")
    assert sorted(people.has("orders").scalars("id")) == [1, 2]
    assert people.has_not("orders").scalars("id") == [3]
    assert people.has("orders", F.col("price") > 6).scalars("id") == [1]
    assert sorted(people.where(F.col("id") > 1).traverse("managers").scalars("id")) == [1]
    loaded = {r["id"]: len(r["orders"]) for r in people.with_edge("orders").all().collect()}
    assert loaded == {1: 2, 2: 1, 3: 0}
    assert people.with_neighbour_count("reports", "n").order(F.desc("n"), "id").first()["id"] == 1
    assert people.group_by("boss").aggregate(n=F.count("*")).count() == 2
    assert [r["id"] for r in people.order("boss", "id").all().collect()] == [2, 3, 1]
    assert people.count() == 3 and people.exist()
    with pytest.raises(ValidationFailed, match="people.nope"):
        people.select("nope")
    with pytest.raises(NotFound):
        shop.get("people", 99).only()
    with pytest.raises(NotSingular):
        people.only()


def test_interceptors(shop):
    scoped = Catalog(shop.tables, shop.keys, shop.edges, [lambda name, rows: rows.where("price is not null") if name == "orders" else rows])
    assert scoped.query("orders").count() == 2
    assert scoped.query("people").has("orders").scalars("id") == [1]


def test_mutations(spark, shop, tmp_path):
    people, orders = shop.tables["people"], shop.tables["orders"]
    changed = {r["id"]: r["name"] for r in mutate.update_where(people, F.col("boss") == 1, name=F.lit("X")).collect()}
    assert changed == {1: "Ann", 2: "X", 3: "X"}
    assert mutate.delete_where(people, F.col("boss") == 1).count() == 1
    gone = people.where("id = 1")
    assert mutate.on_delete_cascade(orders, "person", gone, "id").count() == 1
    assert mutate.on_delete_set_null(orders, "person", gone, "id").where("person is null").count() == 2
    with pytest.raises(ConstraintFailed, match="orders"):
        mutate.on_delete_restrict(orders, "person", gone, "id", "orders")
    entity = Entity("people", (Field("id", T.LongType()), Field("name"), Field("boss", T.LongType(), nullable=True)))
    with pytest.raises(ValidationFailed, match="people.name"):
        mutate.create(people, spark.createDataFrame([(4,)], "id long"), entity)
    assert mutate.create(people, spark.createDataFrame([(4, "Di")], "id int, name string"), entity).count() == 4
    work = mutate.Transaction(spark)
    work.stage(f"{tmp_path}/people", people)
    work.rollback()
    assert not (tmp_path / "people").exists()
    work.stage(f"{tmp_path}/people", people)
    work.commit()
    assert spark.read.parquet(f"{tmp_path}/people").count() == 3


def test_command_line():
    def run(*args):
        return subprocess.run([sys.executable, "-m", "weftline", *args], capture_output=True, text=True, timeout=120)

    done = run("explain", "--model", "tests.models:SHOP")
    assert done.returncode == 0 and done.stdout == "Insertion order:\n  1. Customer\n  2. Order\n"
    assert run("explain").returncode == 2
    assert run("nonsense").returncode == 2
    assert run("--help").returncode == 0
    assert run("explain", "--model", "tests.models:NONE").returncode == 1


def test_writes_are_checked(spark):
    entity = Entity("person", (Field("id", T.LongType(), primary_key=True), Field("name"), Field("nick", nullable=True)))
    rows = spark.createDataFrame([(1, "a", None)], "id long, name string, nick string")
    for bad in ("2.7D AS id, 'b' AS name", "2L AS id, 5 AS name", "CAST(NULL AS BIGINT) AS id, 'b' AS name", "2L AS id", "2L AS id, 'b' AS name, 1 AS other"):
        with pytest.raises(ValidationFailed):
            mutate.create(rows, spark.sql(f"SELECT {bad}"), entity)
    assert {r["id"] for r in mutate.create(rows, spark.sql("SELECT 2 AS id, 'b' AS name"), entity).collect()} == {1, 2}
    with pytest.raises(ValidationFailed):
        mutate.update_where(rows, F.col("id") == 1, entity, name=None)
    with pytest.raises(ValidationFailed):
        mutate.update_where(rows, F.col("id") == 1, id=1.5)
    with pytest.raises(ValidationFailed):
        mutate.create_mapped(rows, [1], lambda item, i: {"id": "x", "name": "b"}, entity)
    assert mutate.create_mapped(rows, [], lambda item, i: {}, entity).count() == 1


def test_hooks_wrap_writes(spark):
    rows = spark.createDataFrame([(1, "a")], "id long, name string")
    mark = lambda text: lambda m, r: r.withColumn("name", F.concat("name", F.lit(text)))
    db = Catalog({"t": rows, "u": rows}, {"t": "id", "u": "id"})
    db.hooks = [hooks.chain(mark("1"), hooks.unless(mark("2"), hooks.UPDATE)), hooks.only_if(hooks.negated(hooks.on_tables("u")), mark("3")), hooks.on(mark("4"), hooks.UPDATE), hooks.reject(hooks.DELETE)]
    assert db.write("t", hooks.CREATE, rows).first()["name"] == "a123"
    assert db.query("t").only()["name"] == "a123"
    assert db.write("u", hooks.UPDATE, rows).first()["name"] == "a14"
    with pytest.raises(ValidationFailed, match="delete operation is not allowed on t"):
        db.write("t", hooks.DELETE, rows)


def test_edges_beside_columns_of_the_same_names(spark):
    rows = spark.createDataFrame([(1, 5, 6, 7, 8)], "id long, _own long, _items long, _n long, _row long")
    pets = spark.createDataFrame([(1, "x")], "owner long, name string")
    db = Catalog({"p": rows, "pets": pets}, {"p": "id", "pets": "name"}, {("p", "pets"): Edge("pets", "id", "owner")})
    got = db.query("p").with_edge("pets").with_neighbour_count("pets", "count").with_neighbour_field("pets", "name", "pet").only()
    assert (got["_own"], got["_items"], got["_n"], got["_row"], got["count"], got["pet"], got["pets"][0]["name"]) == (5, 6, 7, 8, 1, "x", "x")


def test_many_to_many_edges_of_schemas_are_reported_once():
    key = T.StructType([T.StructField("id", T.LongType(), False, {"pk": True}), T.StructField("boss", T.LongType())])
    model = read_schemas(
        Schema("User", key, (SchemaEdge("groups", "Group", many=True), SchemaEdge("boss", "User", ("boss",), nullable=True), SchemaEdge("staff", "User", inverse=True))),
        Schema("Group", key, (SchemaEdge("users", "User", many=True, inverse=True),)),
    )
    assert [(s.entity, s.field, s.reason) for s in model.skipped] == [("User", "groups", "many-to-many edge to Group")]
    assert [e.references for e in model.entities()] == [(Reference(("boss",), "User", True),), ()]


def test_links_of_a_bridge(spark):
    bridge = spark.createDataFrame([(1, 1), (1, 2), (2, 1)], "a long, b long")
    pair = spark.createDataFrame([(1, 2), (3, 3)], "a long, b long")
    rows = lambda x: sorted((r["a"], r["b"]) for r in x.collect())
    assert rows(mutate.add_links(bridge, pair)) == [(1, 1), (1, 2), (2, 1), (3, 3)]
    assert rows(mutate.remove_links(bridge, pair)) == [(1, 1), (2, 1)]
    assert rows(mutate.remove_links(bridge, pair.select("a"))) == [(2, 1)]
