"""Errors that a caller can tell apart."""


class CatalogError(Exception):
    """Base of all errors of this library."""


class InvalidQuery(CatalogError):
    """The query text, a filter value or a scope cannot be understood."""


class InvalidRegex(CatalogError):
    """The regular expression does not compile."""


class CycleFound(CatalogError):
    """A chain of parents never reaches the top."""


class MoveRefused(CatalogError):
    """A subtree cannot be moved where it was asked to go."""


class StorageFailed(CatalogError):
    """A stored catalog cannot be opened or written."""


class Conflict(StorageFailed):
    """Another writer has committed since this transaction began."""
