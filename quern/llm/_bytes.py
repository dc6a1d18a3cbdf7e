"""Whole texts as numpy arrays: words, rolling hashes, windows. Everything is a function of bytes alone."""

from __future__ import annotations

import gc
import os
import sys
from collections.abc import Callable, Iterable, Iterator
from types import ModuleType
from typing import TypeVar

import numpy as np
import pyarrow as pa

T = TypeVar("T")
U = np.uint64
BLOCK = (4 << 20) - 64
BASE, GRAM, RUN = 0x9E3779B97F4A7C15 | 1, 0xD1342543DE82EF95, 0xC6BC279692B5CC83


_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64. One table a base is kept, as long as the longest so far."""
    if base not in _POWERS or len(_POWERS[base][0]) < n:
        size = ((max(n, 1) >> 18) + 1) << 18
        _POWERS.pop(base, None)
        forward, back = np.full(size, base, U), np.full(size, pow(base, -1, 2**64), U)
        forward[0] = back[0] = 1
        _POWERS[base] = np.cumprod(forward, dtype=U, out=forward), np.cumprod(back, dtype=U, out=back)
    forward, back = _POWERS[base]
    return forward[:n], back[:n]


def mix(x: np.ndarray) -> np.ndarray:
    y = x >> U(30)
    y ^= x
    y *= U(0xBF58476D1CE4E5B9)
    y ^= y >> U(27)
    y *= U(0x94D049BB133111EB)
    y ^= y >> U(31)
    return y


def byte_values(apart: bytes = b"", lower: bool = False) -> np.ndarray:
    """A random value for each byte; 0 for those that stand apart words."""
    values = mix(np.arange(1, 257, dtype=U) * U(BASE))
    if lower:
        values[65:91] = values[97:123]
    values[list(apart)] = 0
    return values


SPACE = bytes([0x20, *range(0x09, 0x0E)])
#: All but 0-9, A-Z, a-z and the bytes of characters beyond ASCII.
SIGNS = bytes(b for b in range(128) if not chr(b).isalnum())


def texts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column (null: none) and where each row's begin, with the end."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, at, data = column.buffers()
    at = np.frombuffer(at, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64) if at else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data else np.zeros(0, np.uint8)
    return data, at - at[0]


def longs(column: pa.Array) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False)


def kept(name: str, make: Callable[[], T]) -> T:
    """What a worker makes once and keeps for its later tasks, whose functions and modules come anew with each."""
    store = vars(sys.modules.setdefault("_quern_kept", ModuleType("_quern_kept")))
    if name not in store:
        store[name] = make()
    return store[name]


def _trim() -> Callable[[int], int]:
    import ctypes

    try:
        return ctypes.CDLL("libc.so.6").malloc_trim
    except (OSError, AttributeError):  # another C library
        return lambda _: 0


LARGE = 192 << 20  #: resident bytes, libraries included, beyond which a worker looks for what it can give back


def tidy(own: str = "") -> None:
    """In a worker that has grown: give back what earlier tasks have left: what was kept, but for names that begin with ``own``,
    functions and their tables in cycles, and pages of free memory.
    """
    try:
        with open("/proc/self/statm") as f:
            if int(f.read().split()[1]) * os.sysconf("SC_PAGE_SIZE") < LARGE:
                return
    except (OSError, ValueError):  # not Linux: always
        pass
    store = vars(sys.modules.get("_quern_kept", ModuleType("_quern_kept")))
    for name in [x for x in store if not x.startswith("__") and not (own and x.startswith(own))]:
        del store[name]
    gc.collect()
    pa.default_memory_pool().release_unused()
    kept("trim", _trim)(0)


def blocks(batches: Iterable[pa.RecordBatch], text: str = "text", limit: int = BLOCK, first: bool = True) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of at most about ``limit`` bytes of text, or one row. ``first``: the task calls this once."""
    if first:
        tidy()
    for batch in batches:
        data, at = texts(batch.column(text))
        i = 0
        while i < len(batch):
            j = max(i + 1, int(np.searchsorted(at, at[i] + limit, "right")) - 1)
            yield batch.slice(i, j - i), data[at[i] : at[j]], at[i : j + 1] - at[i]
            i = j


class Words:
    """Words of consecutive texts: first and past-the-end byte, row and hash of each."""

    def __init__(self, data: np.ndarray, at: np.ndarray, apart: bytes, lower: bool = False):
        self.data = data
        values = byte_values(apart, lower)
        inside = (values != 0)[data]
        cut = np.zeros(len(data) + 1, bool)
        cut[at] = True
        before = inside.copy()
        before[1:] &= ~inside[:-1] | cut[1:-1]
        after = inside.copy()
        after[:-1] &= ~inside[1:] | cut[1:-1]
        self.start, self.end = np.flatnonzero(before), np.flatnonzero(after) + 1
        forward, back = powers(BASE, len(data) + 1)
        self.hash = mix(np.add.reduceat(values[data] * forward[:-1], self.start) * back[self.start]) if len(self.start) else np.zeros(0, U)
        self.first = np.searchsorted(self.start, at)  # of each row, with the end
        self.row = np.repeat(np.arange(len(at) - 1), np.diff(self.first))

    def joined(self) -> tuple[np.ndarray, np.ndarray]:
        """The words, each followed by a space, and where each begins, with the end."""
        size = self.end - self.start
        at = np.concatenate(([0], np.cumsum(size + 1)))
        out = np.full(at[-1], 0x20, np.uint8)
        out[spread(at[:-1], size)] = self.data[spread(self.start, size)]
        return out, at

    def grams(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of k consecutive words, and which lie in one row."""
        return grams(self.hash, k), self.row[k - 1 :] == self.row[: max(0, len(self.row) - k + 1)]


def spread(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, ... for each size."""
    total = int(size.sum())
    out = np.ones(total, np.int64)
    some = size > 0
    start, size = start[some], size[some]
    if total:
        out[0] = start[0]
        out[np.cumsum(size)[:-1]] = start[1:] - start[:-1] - size[:-1] + 1
    return np.cumsum(out)


def grams(h: np.ndarray, k: int) -> np.ndarray:
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, U)
    out = h[k - 1 :].copy()
    for j in range(k - 2, -1, -1):  # by Horner's rule, in place
        out *= U(GRAM)
        out += h[j : n + j]
    return mix(out)


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    if len(x) < w:
        return x[:0]
    have = 1
    while have * 2 <= w:
        x = np.minimum(x[:-have], x[have:])
        have *= 2
    return np.minimum(x[: len(x) - (w - have)], x[w - have :]) if have < w else x


def run_starts(x: np.ndarray) -> np.ndarray:
    """Where runs of equal neighbours begin."""
    return np.flatnonzero(np.concatenate(([True], x[1:] != x[:-1]))) if len(x) else np.zeros(0, np.int64)


def order(key: np.ndarray) -> np.ndarray:
    """What sorts the numbers ``key``, equal ones in any order. Their upper bits are sorted together with their places, which is
    faster than np.argsort; where upper bits alone don't tell two numbers apart, that is taken."""
    bits = U(max(1, int(len(key) - 1).bit_length()))
    packed = key >> bits
    packed <<= bits
    packed |= np.arange(len(key), dtype=U)
    packed.sort()
    out = (packed & ((U(1) << bits) - U(1))).view(np.int64)
    packed >>= bits
    same = packed[1:] == packed[:-1]
    if same.any():
        at = np.flatnonzero(same)
        if (key[out[at]] != key[out[at + 1]]).any():
            return np.argsort(key)
    return out


def eights(data: np.ndarray) -> np.ndarray:
    """The little-endian 8 bytes at each position, beyond the end 0."""
    padded = np.concatenate((data, np.zeros(8, np.uint8)))
    return np.ndarray((len(data) + 1,), "<u8", buffer=padded, strides=(1,))


def equal(view: np.ndarray, a: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether size bytes (8 or more) at a are those at b."""
    same = np.ones(len(a), bool)
    todo = np.arange(len(a))
    k = 0
    while len(todo):
        at = np.minimum(k, size[todo] - 8)
        ok = view[a[todo] + at] == view[b[todo] + at]
        same[todo[~ok]] = False
        k += 8
        todo = todo[ok & (size[todo] > k)]
    return same


def merged(key: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ranges of each key, those that touch or overlap made one."""
    if not len(key):
        return key, start, end
    order = np.lexsort((start, key))
    key, start, end = key[order], start[order], end[order]
    shift = np.concatenate(([0], np.cumsum(key[1:] != key[:-1]))) * (int(end.max()) + 2)
    high = np.maximum.accumulate(end + shift)
    first = np.concatenate(([True], (start + shift)[1:] > high[:-1]))
    at = np.flatnonzero(first)
    return key[at], start[at], np.maximum.reduceat(end, at)
