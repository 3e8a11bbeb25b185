"""Text columns as numpy arrays: code points, words, hashes and shingles of whole Arrow batches at once."""

from __future__ import annotations

import contextlib
import ctypes
import functools
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes and texts that one numpy step works on at most; a longer document makes a step of its own.
STEP, TEXTS = 300_000, 1024
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))

OTHER, LETTER, NUMBER, SPACE, MARK = range(5)


def mix(h: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64, for arrays of uint64."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def unmix(h: np.ndarray) -> np.ndarray:
    """What mix() made h of."""
    h = h ^ (h >> np.uint64(31)) ^ (h >> np.uint64(62))
    h = h * np.uint64(pow(0x94D049BB133111EB, -1, 1 << 64))
    h ^= (h >> np.uint64(27)) ^ (h >> np.uint64(54))
    h = h * np.uint64(pow(0xBF58476D1CE4E5B9, -1, 1 << 64))
    return h ^ (h >> np.uint64(30)) ^ (h >> np.uint64(60))


@functools.cache
def classes() -> np.ndarray:
    """The class of every code point, as uint8."""
    table = np.zeros(0x110000, np.uint8)
    of = {"L": LETTER, "N": NUMBER, "M": MARK}
    table[:] = [of.get(unicodedata.category(chr(c))[0], OTHER) for c in range(0x110000)]
    for c in (*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000):
        table[c] = SPACE
    return table


@functools.cache
def unassigned() -> np.ndarray:
    """Whether this Python's Unicode tables lack a code point."""
    return np.array([unicodedata.category(chr(c)) == "Cn" for c in range(0x110000)])


@functools.cache
def lowered() -> np.ndarray:
    """The lower-case form of every code point whose form is one code point, else itself."""
    table = np.arange(0x110000, dtype=np.uint32)
    for c in range(0x1E944):
        low = chr(c).lower()
        if len(low) == 1:
            table[c] = ord(low)
    return table


@functools.cache
def word_values() -> np.ndarray:
    """For every code point of a word (letter, mark, number) the random value of its lower-case form, else 0."""
    values = mix(lowered().astype(np.uint64) * np.uint64(0xD1342543DE82EF95) + np.uint64(1)) | np.uint64(1)
    values[(classes() == OTHER) | (classes() == SPACE)] = 0
    return values


@functools.cache
def char_values() -> np.ndarray:
    """A random value of every code point."""
    return mix(np.arange(0x110000, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F) + np.uint64(7)) | np.uint64(1)


_powers = (np.ones(1, np.uint64), np.ones(1, np.uint64))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers
    if len(_powers[0]) < n:
        steps = np.full(max(n, STEP * 2), _BASE)
        steps[0] = 1
        back = np.full(len(steps), _INVERSE)
        back[0] = 1
        _powers = np.multiply.accumulate(steps), np.multiply.accumulate(back)
    return _powers


def segment_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of values[start:end] of every segment, wherever it stands."""
    up, down = powers(len(values) + 1)
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up[: len(values)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def plain(column: pa.Array | pa.ChunkedArray) -> pa.Array:
    """The column as one array of strings, null as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    return column


def code_points(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts in a row, and where each text begins, with the end."""
    offsets = np.zeros(len(column) + 1, np.int64)
    if not len(column):
        return np.zeros(0, np.uint32), offsets
    wide = pa.types.is_large_string(column.type)
    at = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    raw = memoryview(data)[int(at[0]) : int(at[-1])] if data is not None else b""
    try:
        points = np.frombuffer(str(raw, "utf-8").encode("utf-32-le"), np.uint32)
        np.cumsum(pc.utf8_length(column).to_numpy(zero_copy_only=False), out=offsets[1:])
    except UnicodeError:  # bytes that are no UTF-8: U+FFFD stands for them
        texts = [str(memoryview(data)[int(a) : int(b)], "utf-8", "replace") for a, b in zip(at[:-1], at[1:], strict=True)]
        points = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
        np.cumsum([len(x) for x in texts], out=offsets[1:])
    return points, offsets


def steps(column: pa.Array | pa.ChunkedArray, step: int = STEP) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, code points, their offsets) of runs of at most TEXTS whole texts of about step bytes."""
    column = plain(column)
    sizes = np.cumsum(pc.binary_length(column).to_numpy(zero_copy_only=False).astype(np.int64)) if len(column) else []
    lo, done = 0, 0
    while lo < len(column):
        hi = max(lo + 1, min(lo + TEXTS, int(np.searchsorted(sizes, done + step, "right"))))
        yield lo, hi, *code_points(column[lo:hi])
        lo, done = hi, int(sizes[hi - 1])
    trim()


def trim() -> None:
    """Gives memory that a batch has freed back to the system; else a worker keeps the most that it ever took."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(AttributeError, OSError):  # other C libraries than glibc
        ctypes.CDLL(None).malloc_trim(0)


def words(points: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Start, end, text number and hash (of the lower-case form) of every word: a longest run of letters, marks and numbers."""
    values = word_values()[points]
    inside = values != 0
    begin = np.empty(len(points), bool)
    if len(points):
        begin[0] = inside[0]
        np.greater(inside[1:], inside[:-1], out=begin[1:])
        at = offsets[:-1][offsets[:-1] < len(points)]
        begin[at] = inside[at]
    starts = np.flatnonzero(begin)
    last = np.empty(len(points), bool)
    if len(points):
        last[-1] = inside[-1]
        np.greater(inside[:-1], inside[1:], out=last[:-1])
        at = offsets[1:][offsets[1:] > 0] - 1
        last[at] = inside[at]
    ends = np.flatnonzero(last) + 1
    own = np.repeat(np.arange(len(offsets) - 1), np.diff(np.searchsorted(starts, offsets)))
    return starts, ends, own, segment_hashes(values, starts, ends)


def shingles(hashes: np.ndarray, doc: np.ndarray, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hash and text number of every run of size words; a text of fewer words, but one at least, has one shingle of them all."""
    n = len(hashes) - size + 1
    if n > 0:
        whole = doc[:n] == doc[size - 1 :]
        h = hashes[:n].copy()
        for k in range(1, size):
            h = h * _BASE + hashes[k : n + k]
        h, own = mix(h[whole]), doc[:n][whole]
    else:
        h, own = np.zeros(0, np.uint64), np.zeros(0, doc.dtype)
    if len(doc):
        first = np.flatnonzero(np.diff(doc, prepend=-1))
        count = np.diff(np.append(first, len(doc)))
        if (few := count < size).any():
            ends = first[few] + count[few]
            h, own = np.concatenate([h, segment_hashes(hashes, first[few], ends)]), np.concatenate([own, doc[first[few]]])
            order = np.argsort(own, kind="stable")
            h, own = h[order], own[order]
    return h, own


def ragged(flat: np.ndarray, lengths: np.ndarray, kind: pa.DataType) -> pa.Array:
    """Lists of the given lengths."""
    offsets = np.zeros(len(lengths) + 1, np.int32)
    np.cumsum(lengths, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, kind))
