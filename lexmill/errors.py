"""Errors that callers can tell apart."""


class LibraryError(Exception):
    """The base of all errors of this library."""


class ConfigurationError(LibraryError, ValueError):
    """Settings that contradict each other."""


class NotFound(LibraryError, KeyError):
    """No document has this id or path."""


class Invalid(LibraryError, ValueError):
    """An argument outside its range."""


class Forbidden(LibraryError):
    """A document that must not be deleted while its file is in place."""
