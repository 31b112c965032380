"""Hashes of words and shingles, many documents at a time, in numpy (used inside tasks).

Words are maximal runs of bytes other than 0x20 and 0x09-0x0D of the UTF-8 text, A-Z lower-cased. Everything works on the
bytes of an Arrow column, block by block, so memory does not follow a text's length beyond its bytes.
"""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes worked on together; longer texts are cut at white space.
BLOCK = 1 << 19
#: Bytes of text in a part of an Arrow batch, about.
PART = 1 << 20
_ODD = np.uint64(0x9E3779B97F4A7C15)
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of unsigned 64-bit numbers."""
    x = x ^ (x >> np.uint64(30))
    x *= _M1
    x ^= x >> np.uint64(27)
    x *= _M2
    x ^= x >> np.uint64(31)
    return x


_EXACT = mix(np.arange(1, 257, dtype=np.uint64) * _ODD)
_FOLDED = _EXACT[LOWER]
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = 1 << max(12, int(n).bit_length())
    if size not in _POWERS:
        base = 0x2545F4914F6CDD1D
        for b in (base, pow(base, -1, 1 << 64)):
            p = np.full(size, b, np.uint64)
            p[0] = 1
            _POWERS[size] = (*_POWERS.get(size, ()), np.multiply.accumulate(p))
    return _POWERS[size]


def as_array(column: pa.Array | pa.ChunkedArray | list) -> pa.Array:
    """A string array without nulls (they become empty)."""
    if isinstance(column, list):
        column = pa.array(column, pa.string())
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.fill_null("") if column.null_count else column


def raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string array, and where each row begins in them (one offset more than rows)."""
    kind = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    _, at, data = column.buffers()
    offsets = np.frombuffer(at, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
    return np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8), offsets


def parts(batches: Iterator[pa.RecordBatch], size: int = PART, column: str = "text") -> Iterator[pa.RecordBatch]:
    """The batches in slices of about ``size`` bytes of text (a longer text is a slice of its own), so that what a task makes of
    a slice follows neither the rows nor the bytes of a batch."""
    for batch in batches:
        at = raw(batch.column(column))[1]
        i = 0
        while i < len(batch):
            j = max(i + 1, int(np.searchsorted(at, at[i] + size, side="right")) - 1)
            yield batch.slice(i, j - i)
            i = j
    give_back()


def give_back() -> None:
    """Returns memory that a task has freed to the machine; else a worker keeps it beside the JVM until its next task."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(AttributeError):  # other C libraries have no such call
        ctypes.CDLL(None).malloc_trim(0)


_PRINTABLE = (np.arange(256) > 32) & (np.arange(256) < 127)
#: For ``blocks``: cut before a line feed.
LINES = (np.arange(256) == 10, np.ones(256, bool))


def blocks(column, size: int = BLOCK, cuts: tuple[np.ndarray, np.ndarray] = (SPACE, _PRINTABLE)) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """``(rows, bytes, at)``: texts laid end to end, and where each begins. A longer text comes in several blocks, each cut just before a byte of
    ``cuts``' first kind that follows one of its second: white space after a printable ASCII byte."""
    data, at = raw(as_array(column))
    i, n = 0, len(at) - 1
    while i < n:
        j = int(np.searchsorted(at, at[i] + size, side="right")) - 1
        if j > i:
            yield np.arange(i, j), data[at[i] : at[j]], at[i : j + 1] - at[i]
            i = j
            continue
        a, end = int(at[i]), int(at[i + 1])
        while a < end:
            cut, look = end, a + size
            while look < end:
                part = data[look : look + 4096]
                before = data[look - 1 : look - 1 + len(part)]
                found = np.flatnonzero(cuts[0][part] & cuts[1][before])
                if len(found):
                    cut = look + int(found[0])
                    break
                look += 4096
            yield np.array([i]), data[a:cut], np.array([0, cut - a])
            a = cut
        i += 1


def segment_hashes(b: np.ndarray, start: np.ndarray, end: np.ndarray, table: np.ndarray = _EXACT) -> np.ndarray:
    """A hash of the bytes of each segment."""
    up, down = _powers(len(b))
    total = np.zeros(len(b) + 1, np.uint64)
    np.cumsum(table[b] * up[: len(b)], out=total[1:])
    return mix((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64) * _ODD)


def word_spans(b: np.ndarray, at: np.ndarray, between: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray]:
    """Where words start and end; a text's end ends its last word. ``between``: of each byte, whether it separates words."""
    gap = between[b]
    before, after = np.empty(len(b), bool), np.empty(len(b), bool)
    if len(b):
        before[0], before[1:], after[-1], after[:-1] = True, gap[:-1], True, gap[1:]
        edge = at[(at > 0) & (at < len(b))]
        before[edge] = True
        after[edge - 1] = True
    return np.flatnonzero(before & ~gap), np.flatnonzero(after & ~gap) + 1


def word_hashes(column) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, and where each text's words begin (one offset more than texts). None counts as empty."""
    column = as_array(column)
    counts, parts = np.zeros(len(column), np.int64), []
    for rows, b, at in blocks(column):
        start, end = word_spans(b, at)
        parts.append(segment_hashes(b, start, end, _FOLDED))
        np.add.at(counts, rows, np.diff(np.searchsorted(start, at)))
    return (np.concatenate(parts) if parts else np.zeros(0, np.uint64)), np.concatenate(([0], np.cumsum(counts)))


def window_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of ``k`` words; runs that cross two texts are for the caller to leave out."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for j in range(k):
        out = out * np.uint64(0xD6E8FEB86659FD93) + mix(h[j : j + n] + np.uint64((j + 1) * int(_ODD) % 2**64))
    return mix(out)


def shingle_sets(column, k: int) -> list[np.ndarray]:
    """Sorted distinct hashes of each text's ``k``-word shingles; with fewer words the whole sequence is the one shingle."""
    h, at = word_hashes(column)
    w = window_hashes(h, k)
    out = []
    for a, b in zip(at[:-1], at[1:], strict=True):
        if b - a >= k:
            s = np.sort(w[a : b - k + 1])
            out.append(s[np.concatenate(([True], s[1:] != s[:-1]))])
        elif b > a:
            out.append(window_hashes(h[a:b], int(b - a)) + np.uint64(b - a))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def signed(x: np.ndarray) -> np.ndarray:
    """The same bits as Spark's signed long."""
    return x.view(np.int64)
