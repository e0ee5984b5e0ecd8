"""Packing of identifiers into 64 bits, and fixed-width text.

Values with the top bit set show as negative BIGINTs; unsigned shifts and masks decode them.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_MASK48 = (1 << 48) - 1
_MASK16 = (1 << 16) - 1


def merge_tid(page: Column, slot: Column) -> Column:
    """48 bits of the page, then 16 of the slot."""
    return F.shiftleft(page.cast("long").bitwiseAND(F.lit(_MASK48)), 16).bitwiseOR(slot.cast("long").bitwiseAND(F.lit(_MASK16)))


def split_tid(tid: Column) -> tuple[Column, Column]:
    """Page and slot."""
    return F.shiftrightunsigned(tid, 16), tid.bitwiseAND(F.lit(_MASK16))


def merge_page_id(segment: Column, page: Column) -> Column:
    """16 bits of the segment, then 48 of the page within it."""
    return F.shiftleft(segment.cast("long").bitwiseAND(F.lit(_MASK16)), 48).bitwiseOR(page.cast("long").bitwiseAND(F.lit(_MASK48)))


def split_page_id(page_id: Column) -> tuple[Column, Column]:
    """Segment and page."""
    return F.shiftrightunsigned(page_id, 48), page_id.bitwiseAND(F.lit(_MASK48))


def pad_char(text: Column, length: int) -> Column:
    """Cut or padded with blanks to ``length`` characters (bytes, for ASCII text)."""
    return F.rpad(text, length, " ")
