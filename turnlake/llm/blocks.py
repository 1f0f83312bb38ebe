"""Whole texts as byte arrays: cutting batches into bounded blocks, splitting and hashing words.

A word is read as pieces of eight bytes, the last one filled with zeros. Each piece is mixed with
its place by a bijection, the pieces of a word are summed and mixed with its length, so words of
up to eight bytes never collide with one another and longer ones only by chance. No Python object
is made per word. Texts of any length are handled: a long one is cut at white space.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text worked on at once; a longer single text is a block of its own.
BLOCK = 1 << 18
_U = np.uint64
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_FIRST = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)  # keeps the first k bytes of a piece
_PLACE = _U(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: a bijection that spreads every bit."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def sums(values: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The sum, modulo 2**64, of each run of values; runs lie one after another and may be empty."""
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values, out=total[1:])
    upto = np.cumsum(size)
    return total[upto] - total[upto - size]


def _hashed(low: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    padded = np.concatenate([low, np.zeros(8, np.uint8)])
    piece = np.ndarray(len(low) + 1, "<u8", padded.data, strides=(1,))  # the eight bytes from each place on
    size = ends - starts
    out = mix((piece[starts] & _FIRST[np.minimum(size, 8)]) ^ _PLACE)
    long = np.flatnonzero(size > 8)
    if len(long):
        more = (size[long] - 1) >> 3
        nth = np.arange(int(more.sum())) - np.repeat(np.cumsum(more) - more, more) + 1
        word = np.repeat(long, more)
        value = piece[starts[word] + 8 * nth] & _FIRST[np.minimum(size[word] - 8 * nth, 8)]
        out[long] += sums(mix(value ^ mix(_PLACE * (nth + 1).astype(np.uint64))), more)
    return mix(out + size.astype(np.uint64))


def texts(batch: pa.RecordBatch, column: str = "text") -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a text column and where each row begins (one more than rows); null counts as empty."""
    col = batch.column(batch.schema.get_field_index(column)).fill_null("").cast(pa.large_binary())
    offsets = np.frombuffer(col.buffers()[1], np.int64, len(col) + 1, col.offset * 8)
    data = np.frombuffer(col.buffers()[2] or b"", np.uint8)
    return data, offsets


def ranges(offsets: np.ndarray, most: int = BLOCK) -> Iterator[tuple[int, int]]:
    """Row ranges of at most so many bytes, or of one row."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def _words(low: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    word = ~_SPACE[low]
    before = np.zeros(len(low), bool)
    before[1:] = word[:-1]
    edges = offsets[(offsets > 0) & (offsets < len(low))]
    before[edges] = False
    starts = np.flatnonzero(word & ~before)
    before[:-1] = word[1:]
    before[-1:] = False
    before[edges - 1] = False
    return starts, np.flatnonzero(word & ~before) + 1


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the white-space separated words (A-Z lower-cased) and the row of each.

    offsets begin at 0 and end at len(data).
    """
    hashes, rows, at = [], [], 0
    while at < len(data):
        end = min(len(data), at + 2 * BLOCK)
        if end < len(data):  # cut at white space, forwards where one word fills the slice
            gap = np.flatnonzero(_SPACE[data[at:end]])
            if len(gap):
                end = at + int(gap[-1]) + 1
            else:
                gap = np.flatnonzero(_SPACE[data[end:]])
                end = end + int(gap[0]) + 1 if len(gap) else len(data)
        low = _LOWER[data[at:end]]
        starts, ends = _words(low, offsets - at)
        hashes.append(_hashed(low, starts, ends))
        rows.append(np.searchsorted(offsets, starts + at, "right") - 1)
        at = end
    return (np.concatenate(hashes), np.concatenate(rows)) if hashes else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
