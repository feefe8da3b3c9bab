"""Errors raised by keyloom."""


class KeyloomError(Exception):
    """Base of all errors that keyloom raises."""


class UnknownAttributeError(KeyloomError):
    """A name isn't in the heading."""


class LineageError(KeyloomError):
    """Attributes of one name stem from different origins."""


class DuplicateError(KeyloomError):
    """A primary or unique key is taken."""


class IntegrityError(KeyloomError):
    """A foreign key, a part's integrity or a constraint would be broken."""


class ConflictError(IntegrityError):
    """Another writer has committed since the transaction began."""


class MissingError(KeyloomError):
    """A table, namespace or stored object doesn't exist."""
