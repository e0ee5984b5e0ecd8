"""Tuple streams whose columns are known by position.

The public schema may hold one name several times, so a frame carries its names beside a
DataFrame with unique internal ones.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import types as T

from tessella.errors import TypeMismatch, UnknownColumn

INTEGER, CHAR, OTHER = "Integer", "Char", "Other"
INT_MIN = -(2**31)


def tag_of(kind: T.DataType) -> str:
    if isinstance(kind, (T.IntegerType, T.LongType, T.ShortType, T.ByteType)):
        return INTEGER
    return CHAR if isinstance(kind, T.StringType) else OTHER


@dataclass(frozen=True)
class Frame:
    df: DataFrame
    names: tuple[str, ...]

    @classmethod
    def of(cls, df: DataFrame) -> Frame:
        return cls(df.toDF(*[f"c{k}" for k in range(len(df.columns))]), tuple(df.columns))

    def to_df(self) -> DataFrame:
        """A DataFrame with the public names, repeated ones included."""
        return self.df.toDF(*self.names)

    def column(self, position: int) -> Column:
        return self.df[self.df.columns[position]]

    def tag(self, position: int) -> str:
        return tag_of(self.df.schema[position].dataType)

    def first(self, name: str) -> int:
        """Position of the first column of that name."""
        if name not in self.names:
            raise UnknownColumn(f"no column {name!r} among {', '.join(self.names)}")
        return self.names.index(name)

    def same_type(self, position: int, other: Frame, other_position: int) -> None:
        mine, theirs = self.tag(position), other.tag(other_position)
        if mine != theirs or mine == OTHER:
            raise TypeMismatch(f"{self.names[position]} is {mine}, {other.names[other_position]} is {theirs}")

    def rows(self) -> Iterator[tuple]:
        """All rows, fetched partition by partition."""
        return map(tuple, self.df.toLocalIterator(prefetchPartitions=True))


@dataclass(frozen=True)
class Register:
    """A cell of the current tuple. Cells are equal if type and value are; names don't count."""

    name: str
    tag: str
    value: object

    @property
    def integer(self) -> int:
        return self.value if self.tag == INTEGER else INT_MIN

    @property
    def string(self) -> str:
        return self.value if self.tag == CHAR else ""

    def __eq__(self, other: object) -> bool:
        return isinstance(other, Register) and (self.tag, self.value) == (other.tag, other.value)

    def __hash__(self) -> int:
        return hash((self.tag, self.value))


class Cursor:
    """Tuple-at-a-time access to a frame: ``open``, ``next``, ``output``, ``close``."""

    def __init__(self, frame: Frame):
        self.frame = frame
        self._rows: Iterator[tuple] | None = None
        self._now: tuple | None = None

    def open(self) -> None:
        self._rows, self._now = self.frame.rows(), None

    def next(self) -> bool:
        """Go to the next tuple; after the end every call is false."""
        if self._rows is None:
            raise RuntimeError("the cursor isn't open")
        self._now = next(self._rows, None)
        return self._now is not None

    def output(self) -> list[Register]:
        values = self._now or (None,) * len(self.frame.names)
        return [Register(n, self.frame.tag(k), v) for k, (n, v) in enumerate(zip(self.frame.names, values, strict=True))]

    def close(self) -> None:
        self._rows = None
