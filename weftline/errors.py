"""The engine's exceptions. Messages name the entity and field that they are about."""


class WeftlineError(Exception):
    """Base of all errors raised here."""


class UnknownReference(WeftlineError):
    """A reference names an entity that the model lacks."""


class UnsatisfiableCycle(WeftlineError):
    """Required references form a cycle: no insertion order can satisfy them."""


class DuplicateEntity(WeftlineError):
    """Two entities share a name."""


class InvalidReference(WeftlineError):
    """A reference names no fields, or its fields do not fit the target's key."""


class UnsupportedField(WeftlineError):
    """No rule produces values for a field, or a reader meets a type it cannot map."""


class UnsatisfiableUniqueness(WeftlineError):
    """The values that a unique field can take are too few for its rows."""


class InvalidScale(WeftlineError):
    """A negative row count was asked for."""


class MissingSeed(WeftlineError):
    """A draw was asked for without a seed."""


class MissingSession(WeftlineError):
    """No Spark session was given."""


class NotFound(WeftlineError):
    """A query that must return a row returned none."""


class NotSingular(WeftlineError):
    """A query that must return one row returned several."""


class ValidationFailed(WeftlineError):
    """An unknown column, a missing required field or a value of the wrong type."""


class ConstraintFailed(WeftlineError):
    """A write would break a reference."""
