"""The text sink: a header of names, then one line a row, values with ``, `` between."""

from __future__ import annotations

from typing import TextIO

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.operators.frame import Frame

SEPARATOR = ", "


def header(frame: Frame) -> str:
    return SEPARATOR.join(frame.names)


def lines(frame: Frame) -> DataFrame:
    """The rows as text, in a column ``line``; nothing is quoted, a null is empty."""
    values = [F.coalesce(frame.column(k).cast("string"), F.lit("")) for k in range(len(frame.names))]
    return frame.df.select(F.concat_ws(SEPARATOR, *values).alias("line"))


def print_text(frame: Frame, stream: TextIO) -> Frame:
    """Write header and rows to a stream of the client; rows come partition by partition."""
    stream.write(header(frame) + "\n")
    for row in lines(frame).toLocalIterator(prefetchPartitions=True):
        stream.write(row.line + "\n")
    stream.flush()
    return frame


def write_text(frame: Frame, path: str) -> None:
    """Write the rows (no header) as text files, each partition its own."""
    lines(frame).write.text(path)
