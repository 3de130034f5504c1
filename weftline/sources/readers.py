"""Reading models.

``read_classes`` reads Python dataclasses; ``read_schema`` and ``read_schemas`` read StructTypes whose
fields carry metadata, without and with declared edges; ``read_tables`` reads existing DataFrames with declared keys. All give entities and skip reasons.
"""

from __future__ import annotations

import dataclasses
import datetime
import types
import typing
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from weftline.errors import InvalidReference, UnsupportedField
from weftline.functions.rules import pascal
from weftline.model import Entity, Field, Reference, SkipReason

# The scalar kinds that readers map. Unsigned ones widen, since Spark has none.
SCALARS: dict[str, T.DataType] = {
    "string": T.StringType(), "enum": T.StringType(), "uuid": T.StringType(), "bool": T.BooleanType(),
    "int": T.LongType(), "int8": T.ByteType(), "int16": T.ShortType(), "int32": T.IntegerType(), "int64": T.LongType(),
    "uint": T.DecimalType(20, 0), "uint8": T.ShortType(), "uint16": T.IntegerType(), "uint32": T.LongType(), "uint64": T.DecimalType(20, 0),
    "float32": T.FloatType(), "float64": T.DoubleType(), "time": T.TimestampType(),
}

_PYTHON = {str: "string", bool: "bool", int: "int64", float: "float64", datetime.datetime: "time"}


def spark_type(kind: str, owner: str = "") -> T.DataType:
    if kind not in SCALARS:
        raise UnsupportedField(f"unsupported type {kind} of {owner}")
    return SCALARS[kind]


@dataclass(frozen=True)
class Model:
    """Entities that were read, what was skipped, and each entity's storage names by field."""

    read: tuple[Entity, ...]
    skipped: tuple[SkipReason, ...] = ()
    storage: dict[str, dict[str, str]] = field(default_factory=dict)

    def entities(self) -> list[Entity]:
        return list(self.read)


def belongs_to(target: type | str, *fields: str, nullable: bool | None = None) -> dict:
    """Metadata of a reference: the fields of this class that hold the target's key."""
    return {"target": target if isinstance(target, str) else target.__name__, "fields": fields, "nullable": nullable}


def has_many(target: type | str, *fields: str) -> dict:
    """Metadata on the parent: ``fields`` of the child hold this class's key, whether or not the child says so."""
    return belongs_to(target, *fields)


def many_to_many(target: type | str, bridge: str) -> dict:
    return {"target": target if isinstance(target, str) else target.__name__, "bridge": bridge}


def column(*, size: int = 0, unique: bool = False, pk: bool = False, auto: bool | None = None, soft_delete: bool = False, not_null: bool = False, storage: str = "", kind: str = "", default: object = None):
    """A dataclass field with column metadata."""
    meta = {"size": size, "unique": unique, "pk": pk, "auto": auto, "soft_delete": soft_delete, "not_null": not_null, "storage": storage, "kind": kind}
    return dataclasses.field(default=default, metadata=meta)


def _field(cls: type, f: dataclasses.Field, hint: object, only_key: bool) -> Field:
    meta, optional = f.metadata, False
    if isinstance(hint, types.UnionType) or typing.get_origin(hint) is typing.Union:
        args = [a for a in typing.get_args(hint) if a is not type(None)]
        optional, hint = len(args) < len(typing.get_args(hint)), args[0]
    kind = meta.get("kind") or _PYTHON.get(hint, getattr(hint, "__name__", str(hint)))
    kind_type = spark_type(kind, f"{cls.__name__}.{f.name}")
    pk = bool(meta.get("pk"))
    auto = meta.get("auto")
    integer = isinstance(kind_type, (T.IntegralType, T.DecimalType))
    return Field(
        f.name, kind_type, int(meta.get("size", 0)), optional and not pk and not meta.get("not_null"), bool(meta.get("unique")), pk,
        bool(auto) if auto is not None else pk and only_key and integer and f.name.lower() == "id", bool(meta.get("soft_delete")),
    )


def read_classes(*classes: type) -> Model:
    """Entities of dataclasses.

    Class attributes: ``references`` (belongs_to), ``children`` (has_many), ``links`` (many_to_many),
    ``polymorphic`` (field names), ``unique_together`` (tuples, in index order). A class given
    twice counts once. A dataclass as a field's type is embedded: its columns become the owner's.
    """
    classes = tuple(dict.fromkeys(classes))
    fields: dict[str, list[Field]] = {}
    storage: dict[str, dict[str, str]] = {}
    refs: dict[str, list[dict]] = {c.__name__: list(getattr(c, "references", ())) for c in classes}
    skipped = {SkipReason(c.__name__, name, "polymorphic association") for c in classes for name in getattr(c, "polymorphic", ())}
    for cls in classes:
        storage[cls.__name__] = {}
        fields[cls.__name__] = _flat(cls, storage[cls.__name__])
        for child in getattr(cls, "children", ()):
            refs.setdefault(child["target"], []).append(belongs_to(cls, *child["fields"]))
    by_name = {c.__name__: c for c in classes}
    key = {n: tuple(f.name for f in fs if f.primary_key) for n, fs in fields.items()}
    entities = []
    for name, cls in by_name.items():
        merged: dict[tuple, Reference] = {}
        for ref in refs[name]:
            aligned = _aligned(name, tuple(ref["fields"]), ref["target"], key, getattr(cls, "key_of", {}))
            own = [f for f in fields[name] if f.name in aligned]
            free = len(own) == len(aligned) and all(not f.primary_key and not _required(cls, f.name) for f in own)
            nullable = free if ref["nullable"] is None else ref["nullable"]
            merged[ref["target"], aligned] = Reference(aligned, ref["target"], nullable)
        entities.append(Entity(name, tuple(fields[name]), tuple(merged[k] for k in sorted(merged)), tuple(sorted(tuple(u) for u in getattr(cls, "unique_together", ()) if len(u) > 1))))
    seen: set[str] = {e.name for e in entities}
    for cls in classes:
        for link in getattr(cls, "links", ()):
            if link["bridge"] not in seen:
                seen.add(link["bridge"])
                entities.append(_bridge(link["bridge"], cls.__name__, link["target"], fields, key))
    return Model(tuple(entities), tuple(sorted(skipped, key=lambda s: (s.entity, s.field))), storage)


def _required(cls: type, name: str) -> bool:
    return any(f.name == name and f.metadata.get("not_null") for f in dataclasses.fields(cls))


def _flat(cls: type, storage: dict[str, str]) -> list[Field]:
    hints = typing.get_type_hints(cls)
    only_key = sum(bool(f.metadata.get("pk")) for f in dataclasses.fields(cls)) == 1
    out = []
    for f in dataclasses.fields(cls):
        if dataclasses.is_dataclass(hints[f.name]):
            out += _flat(hints[f.name], storage)
            continue
        out.append(_field(cls, f, hints[f.name], only_key))
        storage[f.name] = f.metadata.get("storage") or f.name
    return out


def _aligned(name: str, own: tuple[str, ...], target: str, key: dict[str, tuple[str, ...]], declared: dict[str, str]) -> tuple[str, ...]:
    """The reference's fields in the order of the target's key. ``declared`` maps own fields to key fields."""
    if target not in key:
        return own
    if len(own) != len(key[target]):
        raise InvalidReference(f"{name}: {len(own)} reference fields for {target}'s key of {len(key[target])}")
    if not declared or not all(f in declared for f in own):
        return own
    by_key = {declared[f]: f for f in own}
    if set(by_key) != set(key[target]):
        raise InvalidReference(f"{name}: {own} do not cover {target}'s key {key[target]}")
    return tuple(by_key[k] for k in key[target])


def _bridge(bridge: str, a: str, b: str, fields: dict[str, list[Field]], key: dict[str, tuple[str, ...]]) -> Entity:
    """The entity of a join table: exactly two required references, fields by name."""
    refs, columns = [], []
    names = (a, b) if a != b else (a, f"Other{b}")
    for target, prefix in zip((a, b), names, strict=True):
        own = tuple(f"{prefix}{pascal(k)}" for k in key[target])
        refs.append(Reference(own, target))
        types_of = {f.name: f.type for f in fields[target]}
        columns += [Field(o, types_of[k], primary_key=True) for o, k in zip(own, key[target], strict=True)]
    return Entity(bridge, tuple(sorted(columns, key=lambda f: f.name)), tuple(sorted(refs, key=lambda r: (r.target, r.fields))))


def read_schema(name: str, schema: T.StructType, references: tuple[Reference, ...] = (), unique: tuple[tuple[str, ...], ...] = ()) -> Entity:
    """An entity of a StructType; field metadata: size, unique, pk, auto_increment, soft_delete, nullable."""
    made = []
    for f in schema.fields:
        if isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType, T.BinaryType)):
            raise UnsupportedField(f"unsupported type {f.dataType.simpleString()} of {name}.{f.name}")
        m = f.metadata or {}
        pk = bool(m.get("pk"))
        made.append(Field(f.name, f.dataType, int(m.get("size", 0)), f.nullable and not pk if "nullable" not in m else bool(m["nullable"]), bool(m.get("unique")), pk, bool(m.get("auto_increment")), bool(m.get("soft_delete"))))
    known = {f.name for f in made}
    # A constraint over a column that was not read can't be kept.
    return Entity(name, tuple(made), references, tuple(u for u in unique if len(u) > 1 and set(u) <= known))


@dataclass(frozen=True)
class SchemaEdge:
    """An edge that a schema declares. ``fields`` hold the target's key where this side owns it; ``many``: both sides have many."""

    name: str
    target: str
    fields: tuple[str, ...] = ()
    inverse: bool = False
    many: bool = False
    nullable: bool = False


@dataclass(frozen=True)
class Schema:
    """A schema by name, with its edges and unique constraints."""

    name: str
    fields: T.StructType
    edges: tuple[SchemaEdge, ...] = ()
    unique: tuple[tuple[str, ...], ...] = ()


def read_schemas(*schemas: Schema) -> Model:
    """Entities of schemas. Edges that a side owns become its references; of an edge with many on both sides, which no column
    holds, the side that is not the inverse one reports that it was skipped."""
    entities, skipped = [], set()
    for schema in schemas:
        own = [e for e in schema.edges if e.fields and not e.inverse and not e.many]
        skipped |= {SkipReason(schema.name, e.name, f"many-to-many edge to {e.target}") for e in schema.edges if e.many and not e.inverse}
        entities.append(read_schema(schema.name, schema.fields, tuple(Reference(e.fields, e.target, e.nullable) for e in own), schema.unique))
    return Model(tuple(entities), tuple(sorted(skipped, key=lambda s: (s.entity, s.field))))


def read_tables(tables: dict[str, DataFrame], keys: dict[str, tuple[str, ...]], references: dict[str, tuple[Reference, ...]]) -> Model:
    """Entities of existing tables with declared keys."""
    out = []
    for name, rows in tables.items():
        entity = read_schema(name, rows.schema, references.get(name, ()))
        own = set(keys.get(name, ()))
        out.append(dataclasses.replace(entity, fields=tuple(dataclasses.replace(f, primary_key=f.name in own, nullable=f.nullable and f.name not in own) for f in entity.fields)))
    return Model(tuple(out))
