"""Scan, equality filter, projections and inner equi-join; all keep bag semantics.

Defined results: a null equals no constant and no other cell (a comparison of columns is null
there), so it is neither selected nor joined; projections and scans keep nulls; repeated rows stay
repeated; empty inputs give empty results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella.errors import TypeMismatch, UnknownColumn
from tessella.operators.frame import CHAR, INTEGER, Frame


def scan(spark: SparkSession, path: str) -> Frame:
    """All rows of a Parquet table."""
    return Frame.of(spark.read.parquet(path))


def select_equal(frame: Frame, attribute: str, constant: int | str) -> Frame:
    """Rows whose first column of that name equals the constant.

    Strings are compared byte by byte, without padding. Unsigned 32-bit constants are taken as
    signed ones where the column is a 32-bit integer.
    """
    at = frame.first(attribute)
    wanted = CHAR if isinstance(constant, str) else INTEGER if isinstance(constant, int) and not isinstance(constant, bool) else type(constant).__name__
    if frame.tag(at) != wanted:
        raise TypeMismatch(f"{attribute} is {frame.tag(at)}, the constant is {wanted}")
    if isinstance(frame.df.schema[at].dataType, T.IntegerType) and 2**31 <= constant < 2**32:
        constant -= 2**32
    return Frame(frame.df.filter(frame.column(at) == F.lit(constant)), frame.names)


def project_positions(frame: Frame, positions: list[int]) -> Frame:
    """Columns by position, in the given order; repeats are allowed."""
    if wrong := [p for p in positions if not 0 <= p < len(frame.names)]:
        raise UnknownColumn(f"no column at {wrong} of {len(frame.names)}")
    chosen = [frame.column(p).alias(f"c{k}") for k, p in enumerate(positions)]
    return Frame(frame.df.select(*chosen), tuple(frame.names[p] for p in positions))


def project_names(frame: Frame, names: list[str], strict: bool = True) -> Frame:
    """For each name, all columns of that name. Unknown names are errors, or dropped if not ``strict``."""
    if strict and (unknown := [n for n in names if n not in frame.names]):
        raise UnknownColumn(f"no columns {', '.join(unknown)} among {', '.join(frame.names)}")
    return project_positions(frame, [k for name in names for k, own in enumerate(frame.names) if own == name])


def hash_join(left: Frame, right: Frame, left_attribute: str, right_attribute: str, build: str | None = None) -> Frame:
    """Inner join on one pair of columns: all combinations of rows with equal keys.

    The result has the left columns, then the right ones but those named like the right key.
    ``build="left"`` asks for the left side's hash table; otherwise Spark chooses by size.
    """
    at, other = left.first(left_attribute), right.first(right_attribute)
    left.same_type(at, right, other)
    mine = left.df.toDF(*[f"l{k}" for k in range(len(left.names))])
    theirs = right.df.toDF(*[f"r{k}" for k in range(len(right.names))])
    if build == "left":
        mine = mine.hint("shuffle_hash")
    kept = [k for k, name in enumerate(right.names) if name != right_attribute]
    joined = mine.join(theirs, F.col(f"l{at}") == F.col(f"r{other}"), "inner").drop(*[f"r{k}" for k in range(len(right.names)) if k not in kept])
    return Frame(joined.toDF(*[f"c{k}" for k in range(len(joined.columns))]), left.names + tuple(right.names[k] for k in kept))


def columns_equal(frame: Frame, a: str, b: str) -> DataFrame:
    """Whether two columns agree, row by row, as a column ``equal``; different types never do."""
    x, y = frame.first(a), frame.first(b)
    same = frame.column(x) == frame.column(y) if frame.tag(x) == frame.tag(y) else F.lit(False)
    return frame.df.select(same.alias("equal"))
