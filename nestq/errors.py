"""The error that queries raise."""


class QueryError(ValueError):
    """A query that cannot be parsed, bound or run; shown to callers as ``{"message": ...}``."""
