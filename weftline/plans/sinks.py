"""Where seeded frames go: Parquet folders, tables or a JDBC database."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from weftline.functions.rules import pascal
from weftline.model import Entity

#: Rows of one JDBC batch.
BATCH_ROWS = 500


def stored(rows: DataFrame, storage: dict[str, str] | None = None) -> DataFrame:
    """The entity's columns under their storage names, without the row index."""
    names = {a: b for a, b in (storage or {}).items() if a in rows.columns and a != b}
    return rows.drop("row_idx").withColumnsRenamed(names)


def write_parquet(frames: dict[str, DataFrame], folder: str, mode: str = "overwrite", storage: dict[str, dict[str, str]] | None = None) -> None:
    for name, rows in frames.items():
        stored(rows, (storage or {}).get(name)).write.mode(mode).parquet(f"{folder}/{name}")


def write_tables(frames: dict[str, DataFrame], database: str, mode: str = "overwrite", storage: dict[str, dict[str, str]] | None = None) -> None:
    for name, rows in frames.items():
        stored(rows, (storage or {}).get(name)).write.mode(mode).saveAsTable(f"{database}.{name}")


def write_jdbc(frames: dict[str, DataFrame], url: str, properties: dict[str, str], storage: dict[str, dict[str, str]] | None = None) -> None:
    """In insertion order, so the database's own foreign keys hold."""
    for name, rows in frames.items():
        stored(rows, (storage or {}).get(name)).write.option("batchsize", BATCH_ROWS).mode("append").jdbc(url, name, properties=properties)


def truncate(spark: SparkSession, folder: str, entity: Entity) -> None:
    """Empty an entity's folder; numbering starts over with the next run."""
    spark.createDataFrame([], spark.read.parquet(f"{folder}/{entity.name}").schema).write.mode("overwrite").parquet(f"{folder}/{entity.name}")


def create_table_sql(entity: Entity, storage: dict[str, str] | None = None) -> str:
    """DDL of an entity."""
    names = storage or {}
    columns = ", ".join(f"{names.get(f.name, f.name)} {f.type.simpleString()}{'' if f.nullable else ' NOT NULL'}" for f in entity.fields)
    return f"CREATE TABLE {pascal(entity.name)} ({columns}) USING parquet"
