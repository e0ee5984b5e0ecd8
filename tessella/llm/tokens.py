"""Words of a whole column of texts at once, as numpy arrays over the column's UTF-8 buffer."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: Bytes of text worked on together; bounds the arrays' memory (one longer text stands alone).
PIECE = 1 << 20
#: Bytes of one text that are worked on together, where it can be cut.
LONG = 4 << 20

_MASK = (1 << 64) - 1
_FACTOR = 0x9E3779B97F4A7C15


def mix(values: np.ndarray) -> np.ndarray:
    """Spread 64-bit values (the splitmix64 finaliser)."""
    values = values.astype(np.uint64)
    values = (values ^ (values >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    values = (values ^ (values >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return values ^ (values >> np.uint64(31))


_SPREAD = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_FACTOR)) | np.uint64(1)
_POWERS = np.cumprod(np.full(1 << 16, _FACTOR, np.uint64))
_WINDOW = [np.uint64(pow(0xD6E8FEB86659FD93, k + 1, 1 << 64)) for k in range(16)]

_ASCII_WORD = np.zeros(256, bool)
_ASCII_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_NO_SPACE = np.ones(256, bool)
_NO_SPACE[[32, 9, 10, 11, 12, 13]] = False

# Ranges of Unicode code points (both ends included).
#: Punctuation, symbols and spaces beyond ASCII: they part words.
_PARTING = (
    (0x80, 0xA9), (0xAB, 0xB4), (0xB6, 0xB9), (0xBB, 0xBF), (0xD7, 0xD7), (0xF7, 0xF7), (0x589, 0x58A), (0x5BE, 0x5BE), (0x60C, 0x60C), (0x61B, 0x61B),
    (0x61F, 0x61F), (0x66A, 0x66D), (0x6D4, 0x6D4), (0x964, 0x965), (0x1361, 0x1368), (0x1680, 0x1680), (0x2000, 0x206F), (0x20A0, 0x20CF),
    (0x2190, 0x2BFF), (0x2E00, 0x2E7F), (0x3000, 0x3004), (0x3008, 0x3020), (0x3030, 0x3030), (0x303D, 0x303F), (0xFE10, 0xFE1F), (0xFE30, 0xFE6F),
    (0xFF01, 0xFF0F), (0xFF1A, 0xFF20), (0xFF3B, 0xFF40), (0xFF5B, 0xFF65),
)
#: Scripts written without spaces, whose characters are words of their own.
_UNSPACED = (
    (0xE00, 0xEFF), (0xF00, 0x109F), (0x1780, 0x17FF), (0x3005, 0x3007), (0x3021, 0x302F), (0x3031, 0x303C), (0x3040, 0x312F), (0x31A0, 0x31FF),
    (0x3400, 0x4DBF), (0x4E00, 0xA4CF), (0xF900, 0xFAFF), (0xFF66, 0xFF9F),
)
_PARTS, _WORD, _ALONE = 0, 1, 2
_KIND = np.full(1 << 16, _WORD, np.uint8)
for _ranges, _kind in ((_PARTING, _PARTS), (_UNSPACED, _ALONE)):
    for _low, _high in _ranges:
        _KIND[_low : _high + 1] = _kind
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def folded(raw: np.ndarray) -> np.ndarray:
    """Bytes with ASCII and Latin-1 letters (as UTF-8) in lower case; other scripts keep theirs."""
    low = _LOWER[raw]
    second = (raw[1:] >= 0x80) & (raw[1:] <= 0x9E) & (raw[1:] != 0x97) & (raw[:-1] == 0xC3)
    low[1:][second] |= 0x20
    return low


@dataclass
class Words:
    """Words in text order: the text each is of, its bytes' place and its hash (case-folded)."""

    raw: np.ndarray
    offsets: np.ndarray
    doc: np.ndarray
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray

    @property
    def n_docs(self) -> int:
        return len(self.offsets) - 1


def text_pieces(column: pa.Array, size: int = PIECE) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row, bytes, offsets of rows in them); null rows have no bytes."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    if not len(column):
        return
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    first = 0
    while first < len(column):
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + size, side="right")) - 1)
        own = offsets[first : last + 1]
        yield first, last, data[own[0] : own[-1]], own - own[0]
        first = last


def _powers(place: np.ndarray, most: int) -> np.ndarray:
    """The factor to the power of each place in a word, whatever its length."""
    if most <= len(_POWERS):
        return _POWERS[place]
    steps = np.cumprod(np.full((most >> 16) + 1, _POWERS[-1], np.uint64)) * np.uint64(pow(int(_POWERS[-1]), -1, 1 << 64))
    return _POWERS[place & 0xFFFF] * steps[place >> 16]


def _marks(raw: np.ndarray, punctuation: bool) -> tuple[np.ndarray, np.ndarray]:
    """Which bytes are of words, and the places before and after characters that are words of their own."""
    inside = (_NO_SPACE if punctuation else _ASCII_WORD)[raw]
    lead = np.flatnonzero(raw >= 0xC2)
    if punctuation or not len(lead):
        return inside, np.zeros(0, np.int64)
    padded = np.concatenate([raw, np.zeros(3, np.uint8)])
    first = padded[lead].astype(np.int32)
    second, third = ((padded[lead + k] & 0x3F).astype(np.int32) for k in (1, 2))
    size = 2 + (first >= 0xE0) + (first >= 0xF0)
    point = np.where(size == 2, (first & 0x1F) << 6 | second, (first & 0x0F) << 12 | second << 6 | third)
    kind = np.where(size == 4, _ALONE, _KIND[point & 0xFFFF])
    for k in range(3):
        at = lead[(kind == _PARTS) & (size > k)] + k
        inside[at[at < len(raw)]] = False
    alone = kind == _ALONE
    return inside, np.concatenate([lead[alone], np.minimum(lead[alone] + size[alone], len(raw))])


def words(raw: np.ndarray, offsets: np.ndarray, punctuation: bool) -> Words:
    """Words: runs of bytes that aren't ASCII white space, or (without ``punctuation``) of letters,
    digits and marks, where each character of a script without spaces is a word. A long text is
    worked on in parts that begin with a word, so that memory grows with its words, not its bytes."""
    if len(offsets) != 2 or len(raw) <= LONG:
        return _words(raw, offsets, punctuation)
    found, first = [], 0
    while first < len(raw):
        last = _word_start(raw, min(first + LONG, len(raw)), punctuation)
        part = _words(raw[first:last], np.array([0, last - first]), punctuation)
        found.append((part.start + first, part.end + first, part.hash))
        first = last
    start, end, hashed = (np.concatenate(x) for x in zip(*found, strict=True))
    return Words(raw, offsets, np.zeros(len(start), np.int64), start, end, hashed)


def _word_start(raw: np.ndarray, at: int, punctuation: bool) -> int:
    """The first place from ``at`` on where no word goes on (or the end)."""
    while at < len(raw):
        while at < len(raw) and raw[at] & 0xC0 == 0x80:
            at += 1
        step = 4096
        part = raw[at : at + step]
        inside, alone = _marks(part, punctuation)
        whole = len(part) - 3 if at + step < len(raw) else len(part)
        free = np.concatenate([np.flatnonzero(~inside) + 1, alone[: len(alone) // 2]])
        free = free[free <= whole]
        free = free[(np.append(part, np.uint8(0))[free] & 0xC0) != 0x80]
        if len(free):
            return at + int(free.min())
        at += step
    return len(raw)


def _words(raw: np.ndarray, offsets: np.ndarray, punctuation: bool) -> Words:
    inside, alone = _marks(raw, punctuation)
    cut = np.zeros(len(raw) + 1, bool)
    cut[offsets] = True
    cut[alone] = True
    before = np.empty_like(inside)
    before[:1] = False
    before[1:] = inside[:-1]
    start = np.flatnonzero(inside & (~before | cut[:-1]))
    after = np.empty_like(inside)
    after[-1:] = False
    after[:-1] = inside[1:]
    end = np.flatnonzero(inside & (~after | cut[1:])) + 1
    doc = np.searchsorted(offsets, start, side="right") - 1
    if not len(start):
        return Words(raw, offsets, doc, start, end, np.zeros(0, np.uint64))
    at = np.flatnonzero(inside)
    length = end - start
    first = np.cumsum(length) - length
    powers = _powers(np.arange(len(at)) - np.repeat(first, length), int(length.max()))
    hashed = mix(np.add.reduceat(_SPREAD[folded(raw)[at]] * powers, first) + length.astype(np.uint64))
    return Words(raw, offsets, doc, start, end, hashed)


def text_digests(found: Words) -> np.ndarray:
    """128 bits (two int64) of BLAKE2 over each text's folded words, so that equal digests may stand
    for equal words; zeros for a text without words."""
    counts = np.bincount(found.doc, minlength=found.n_docs)
    ends = np.cumsum(counts)
    keys = np.zeros((found.n_docs, 2), np.int64)
    low = folded(found.raw)
    group = 1 << 17
    if found.n_docs == 1 and len(found.doc) > group:
        state = hashlib.blake2b(digest_size=16)
        for first in range(0, len(found.doc), group):
            state.update(_spaced(low, found.start[first : first + group], found.end[first : first + group])[0])
        keys[0] = np.frombuffer(state.digest(), np.int64)
        return keys
    joined, at = _spaced(low, found.start, found.end)
    at = np.append(at, len(joined))
    for k in np.flatnonzero(counts).tolist():
        own = joined[at[ends[k] - counts[k]] : at[ends[k]]]
        keys[k] = np.frombuffer(hashlib.blake2b(own, digest_size=16).digest(), np.int64)
    return keys


def _spaced(low: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[memoryview, np.ndarray]:
    """The words, each with a blank behind it, and where each begins."""
    length = end - start
    at = np.cumsum(length + 1) - (length + 1)
    out = np.full(int((length + 1).sum()), 32, np.uint8)
    step = np.arange(int(length.sum())) - np.repeat(np.cumsum(length) - length, length)
    out[np.repeat(at, length) + step] = low[np.repeat(start, length) + step]
    return memoryview(out), at


def windows(found: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Document and hash of each run of n words; a document of fewer words has one run of them all."""
    counts = np.bincount(found.doc, minlength=found.n_docs)
    total = np.zeros(max(0, len(found.hash) - n + 1), np.uint64)
    for k in range(n):
        total += found.hash[k : k + len(total)] * _WINDOW[k]
    whole = found.doc[: len(total)] == found.doc[n - 1 :] if len(total) else np.zeros(0, bool)
    docs, hashes = found.doc[: len(total)][whole], total[whole]
    short = np.flatnonzero((counts > 0) & (counts < n))
    if len(short):
        begins = np.cumsum(counts) - counts
        few = [sum(int(found.hash[begins[d] + k]) * int(_WINDOW[k]) for k in range(counts[d])) & _MASK for d in short.tolist()]
        docs = np.concatenate([docs, short])
        hashes = np.concatenate([hashes, np.array(few, np.uint64)])
    return docs, mix(hashes)
