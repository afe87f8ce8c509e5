"""Errors of the engine; parse and analysis errors of SQL text are Spark's own."""

from __future__ import annotations


class EngineError(Exception):
    """Base of the engine's errors."""


class ConfigurationError(EngineError):
    """A setting has no valid value."""


class StorageError(EngineError):
    """Files of a table or log cannot be read or written."""


class CatalogError(EngineError):
    """A table, column or key is missing or already there."""


class TableNotFoundError(CatalogError):
    pass


class TableExistsError(CatalogError):
    pass


class KeyNotFoundError(CatalogError):
    pass


class StatementError(EngineError):
    """A statement has the wrong form or the wrong place."""


class ColumnError(StatementError):
    """A column of a statement cannot be used."""


class ColumnNotFoundError(ColumnError):
    pass


class TypeNameError(StatementError):
    """A type of CREATE TABLE is not known."""


class ConstraintError(EngineError):
    """Rows break a table's constraints."""


class NotNullError(ConstraintError):
    pass


class LengthError(ConstraintError):
    pass


class UniqueError(ConstraintError):
    pass


class TransactionError(EngineError):
    """A transaction cannot go on."""


class TransactionStateError(TransactionError):
    """There is no transaction, or there is one already."""


class WriteConflictError(TransactionError):
    """Another transaction changed the same rows, keys or table first."""


class ClosedError(EngineError):
    """The database or connection is closed."""


class MetricError(EngineError, ValueError):
    """A metric cannot take a value."""
