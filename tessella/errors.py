"""Errors that the engine raises: before anything is run, but for ``Conflict`` and ``RepeatedId``."""


class EngineError(Exception):
    """Base of the engine's own errors."""


class UnknownColumn(EngineError):
    """A named column isn't in the input."""


class TypeMismatch(EngineError):
    """A constant or a join key has another type than the column it is compared with."""


class UnknownRelation(EngineError, KeyError):
    """No relation, segment or index of that name or id."""


class SchemaParserError(EngineError):
    """A CREATE TABLE script isn't accepted."""

    def __init__(self, line: int, reason: str):
        super().__init__(f"line {line}: {reason}")
        self.line = line


class Conflict(EngineError):
    """Another writer changed the same table or catalog meanwhile."""


class RepeatedId(EngineError):
    """Changes name a tuple id more than once."""
