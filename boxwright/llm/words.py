"""Vectorised words and word hashes of whole texts, straight from Arrow's text buffers.

A word is a longest run of bytes other than 0x20 and 0x09-0x0D. In UTF-8 those bytes never occur inside a longer
character, so this equals the pattern ``[^\\x20\\x09-\\x0D]+`` on the decoded text.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_U = np.uint64
_SEPARATES = np.zeros(256, bool)
_SEPARATES[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Random words for tabulation hashing: one table of 256 for each of 64 places in a word.
_PLACES = np.random.Generator(np.random.PCG64(20240607)).integers(0, 1 << 64, (64, 256), dtype=np.uint64).ravel()
_FAR = _U(0x9E3779B97F4A7C15)
_SLICE = 1 << 20


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on 64 bits."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


class Texts(NamedTuple):
    """Texts of one step as bytes; row i is data[bounds[i]:bounds[i + 1]], null texts are empty."""

    data: np.ndarray
    bounds: np.ndarray


class Words(NamedTuple):
    """Words of all texts of a step: row i has words firsts[i] up to firsts[i + 1]."""

    starts: np.ndarray
    ends: np.ndarray
    firsts: np.ndarray


def texts_of(column: pa.Array) -> Texts:
    if column.null_count:
        column = pc.fill_null(column, "")
    column = column.cast(pa.large_string())
    bounds = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8)
    if not len(column) or bounds[0] == bounds[-1]:
        return Texts(np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64))
    return Texts(np.frombuffer(column.buffers()[2], np.uint8)[bounds[0] : bounds[-1]], bounds - bounds[0])


def lowered(texts: Texts) -> Texts:
    """A-Z as a-z, other bytes as they are."""
    return Texts(_LOWER[texts.data], texts.bounds)


def words_of(texts: Texts) -> Words:
    data, bounds = texts
    if not len(data):
        return Words(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(bounds), np.int64))
    gap = _SEPARATES[data]
    heads = np.empty(len(data), bool)
    heads[0] = True
    heads[1:] = gap[:-1]
    edge = bounds[(bounds > 0) & (bounds < len(data))]
    heads[edge] = True
    tails = np.empty(len(data), bool)
    tails[-1] = True
    tails[:-1] = gap[1:]
    tails[edge - 1] = True
    inside = ~gap
    starts, ends = np.flatnonzero(heads & inside), np.flatnonzero(tails & inside) + 1
    return Words(starts, ends, np.searchsorted(starts, bounds))


def hashes_of(data: np.ndarray, words: Words) -> np.ndarray:
    """A 64-bit hash of each word."""
    out = np.empty(len(words.starts), _U)
    size = words.ends - words.starts
    reach = np.cumsum(size)
    at = 0
    while at < len(out):
        stop = max(at + 1, int(np.searchsorted(reach, (reach[at - 1] if at else 0) + _SLICE, "right")))
        n = size[at:stop]
        first = np.cumsum(n) - n
        place = np.arange(n.sum()) - np.repeat(first, n)
        value = _PLACES[((place & 63) << 8) | data[np.repeat(words.starts[at:stop], n) + place]]
        if (far := place >> 6).any():
            value = np.where(far > 0, mixed(value + far.astype(_U) * _FAR), value)
        out[at:stop] = np.add.reduceat(value, first)
        at = stop
    return mixed(out)


def shingles_of(hashes: np.ndarray, firsts: np.ndarray, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the distinct ``width``-word shingles of each row, ascending, and where each row's begin.

    A row with 1 up to ``width - 1`` words has one shingle, the whole sequence; a row without words has none.
    """
    counts = np.diff(firsts)
    runs = np.zeros(max(0, len(hashes) - width + 1), _U)
    for k in range(width if len(runs) else 0):
        runs = mixed(runs * _FAR + hashes[k : len(hashes) - width + 1 + k])
    parts, bounds = [], np.zeros(len(counts) + 1, np.int64)
    for row, (first, n) in enumerate(zip(firsts[:-1].tolist(), counts.tolist(), strict=True)):
        if n >= width:
            part = np.sort(runs[first : first + n - width + 1])
            if len(part) > 1:
                part = part[np.concatenate(([True], part[1:] != part[:-1]))]
        elif n:
            short = np.array([n], _U)
            for k in range(n):
                short = mixed(short * _FAR + hashes[first + k : first + k + 1])
            part = short
        else:
            part = runs[:0]
        parts.append(part)
        bounds[row + 1] = len(part)
    return (np.concatenate(parts) if parts else np.zeros(0, _U)), np.cumsum(bounds)
