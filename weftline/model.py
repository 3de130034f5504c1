"""The declared model: entities, fields, references and options. Plain data, small by nature."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Protocol

from pyspark.sql import types as T


@dataclass(frozen=True)
class Field:
    """A column. ``nullable``: generation may leave it out. ``size``: most characters, 0 for no bound."""

    name: str
    type: T.DataType = T.StringType()
    size: int = 0
    nullable: bool = False
    unique: bool = False
    primary_key: bool = False
    auto_increment: bool = False
    soft_delete: bool = False

    @property
    def is_string(self) -> bool:
        return isinstance(self.type, T.StringType)

    @property
    def is_bool(self) -> bool:
        return isinstance(self.type, T.BooleanType)

    @property
    def is_integer(self) -> bool:
        return isinstance(self.type, T.IntegralType) or (isinstance(self.type, T.DecimalType) and self.type.scale == 0)

    @property
    def is_float(self) -> bool:
        return isinstance(self.type, T.FractionalType) and not self.is_integer

    @property
    def is_time(self) -> bool:
        return isinstance(self.type, (T.TimestampType, T.TimestampNTZType))


@dataclass(frozen=True)
class Reference:
    """A foreign key: ``fields`` hold the target's primary key, position by position."""

    fields: tuple[str, ...]
    target: str
    nullable: bool = False

    @property
    def key(self) -> str:
        return "+".join(self.fields)


@dataclass(frozen=True)
class Entity:
    name: str
    fields: tuple[Field, ...] = ()
    references: tuple[Reference, ...] = ()
    unique_constraints: tuple[tuple[str, ...], ...] = ()

    def field(self, name: str) -> Field | None:
        return next((f for f in self.fields if f.name == name), None)

    @property
    def primary_key(self) -> tuple[str, ...]:
        return tuple(f.name for f in self.fields if f.primary_key)

    @property
    def reference_fields(self) -> frozenset[str]:
        return frozenset(name for r in self.references for name in r.fields)


@dataclass(frozen=True)
class Options:
    """``scale``: rows of a root entity; ``nil_rate``: share of nulls, held within 0 and 1; ``locale``: of names and addresses."""

    seed: int = 0
    scale: int = 100
    nil_rate: float = 0.0
    locale: str = ""

    def __post_init__(self) -> None:
        object.__setattr__(self, "nil_rate", min(1.0, max(0.0, self.nil_rate)))


@dataclass(frozen=True)
class SkipReason:
    """A construct that a reader left out, and why."""

    entity: str
    field: str
    reason: str


class ModelSource(Protocol):
    """Whatever can state its entities."""

    def entities(self) -> list[Entity]: ...


@dataclass
class Declared:
    """A model source over entities that are at hand."""

    declared: list[Entity] = field(default_factory=list)

    def entities(self) -> list[Entity]:
        return list(self.declared)
