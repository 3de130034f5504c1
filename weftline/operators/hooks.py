"""Write hooks: functions around the rows that a mutation is about to store, with conditions and chains."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame

from weftline.errors import ValidationFailed

CREATE, UPDATE, DELETE = "create", "update", "delete"


@dataclass(frozen=True)
class Mutation:
    """What is being written: the table, the operation and the fields it sets."""

    table: str
    op: str
    fields: frozenset[str] = frozenset()


Hook = Callable[[Mutation, DataFrame], DataFrame]
Condition = Callable[[Mutation], bool]


def only_if(condition: Condition, hook: Hook) -> Hook:
    """The hook where the condition holds; elsewhere the rows as they are."""
    return lambda mutation, rows: hook(mutation, rows) if condition(mutation) else rows


def on(hook: Hook, *ops: str) -> Hook:
    return only_if(lambda m: m.op in ops, hook)


def unless(hook: Hook, *ops: str) -> Hook:
    return only_if(lambda m: m.op not in ops, hook)


def reject(*ops: str) -> Hook:
    """Forbids the operations."""

    def refuse(mutation: Mutation, rows: DataFrame) -> DataFrame:
        raise ValidationFailed(f"{mutation.op} operation is not allowed on {mutation.table}")

    return on(refuse, *ops)


def has_fields(*names: str) -> Condition:
    return lambda m: set(names) <= m.fields


def on_tables(*tables: str) -> Condition:
    return lambda m: m.table in tables


def both(*conditions: Condition) -> Condition:
    return lambda m: all(c(m) for c in conditions)


def either(*conditions: Condition) -> Condition:
    return lambda m: any(c(m) for c in conditions)


def negated(condition: Condition) -> Condition:
    return lambda m: not condition(m)


def chain(*hooks: Hook) -> Hook:
    """One hook of several, the first one first."""

    def run(mutation: Mutation, rows: DataFrame) -> DataFrame:
        for hook in hooks:
            rows = hook(mutation, rows)
        return rows

    return run
