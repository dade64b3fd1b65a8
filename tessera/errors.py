"""Errors raised while building plans."""


class EngineError(Exception):
    """Base of all errors of this library."""


class QueryParseError(EngineError):
    """A filter, update or pipeline that has no meaning."""


class ValidationError(EngineError):
    """Documents that break their collection's schema."""


class DuplicateKeyError(EngineError):
    """Two documents with one key of a unique index."""


class NotFoundError(EngineError):
    """A collection, index or transaction that doesn't exist."""


class DimensionError(EngineError):
    """A vector of another length than its index."""


class TransactionTimeout(EngineError):
    """A transaction that was open for too long."""


class CapacityError(EngineError):
    """An insert beyond a capped collection's size."""


class ConflictError(EngineError):
    """A transaction that wrote what another has committed."""


class PermissionDenied(EngineError):
    """An action that none of the user's roles allows."""
