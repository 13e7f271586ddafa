"""Errors that end a comparison; each carries the exit code of the command line."""


class CellweaveError(Exception):
    exit_code = 2


class SourceError(CellweaveError):
    """A source cannot be read, or its specification is not understood."""


class SchemaIncompatible(CellweaveError):
    """Nothing of the two schemas can be compared."""


class KeyNotUnique(CellweaveError):
    """Several rows of a side have the same key."""


class NoKeyFound(CellweaveError):
    """No key was given and none can be guessed."""
