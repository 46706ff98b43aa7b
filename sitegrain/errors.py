"""Errors raised by the table operators."""


class MissingRowsError(LookupError):
    """No row was changed or removed where at least one was expected."""


class DuplicateNameError(ValueError):
    """Two handlers were registered under one name."""
