"""Numpy kernels over the bytes of Arrow text columns. Texts are handled in slices of a few MB, whole texts each."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

SLICE_BYTES = 2 << 20
U = np.uint64
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BLANK = np.zeros(256, dtype=bool)
_BLANK[[0x20, 9, 10, 11, 12, 13]] = True
_BASE, _BASE_INV = 0x9E3779B97F4A7C15, pow(0x9E3779B97F4A7C15, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


class _Powers:
    def __init__(self):
        self.up = self.down = np.ones(1, dtype=np.uint64)

    def get(self, n: int):
        if len(self.up) < n:
            size = max(n, SLICE_BYTES + 1024)
            grow = lambda b: np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(size - 1, b & (2**64 - 1), np.uint64)]))
            self.up, self.down = grow(_BASE), grow(_BASE_INV)
        return self.up[:n], self.down[:n]


_powers = _Powers()


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the offsets of its rows in them; null rows are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    if len(column) == 0 or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)), at


def slices(offsets: np.ndarray, size: int = SLICE_BYTES):
    """Ranges of rows with about size bytes; a longer text stands alone."""
    a, n = 0, len(offsets) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + size, "right")) - 1)
        yield a, min(b, n)
        a = b


#: Everything in ASCII but letters and digits separates words here.
NOT_ALNUM = np.array([not (48 <= c < 58 or 65 <= c < 91 or 97 <= c < 123 or c >= 128) for c in range(256)])


def word_hashes(data: np.ndarray, offsets: np.ndarray, lower: bool = True, blank: np.ndarray = _BLANK) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of rows, in order, and for each row where its words begin (one more at the end)."""
    lo = int(offsets[0])
    body = data[lo : int(offsets[-1])]
    at = offsets - lo
    n = len(body)
    word = ~blank[body]
    start = np.empty(n, dtype=bool)
    if n:
        start[0] = word[0]
        np.logical_and(word[1:], ~word[:-1], out=start[1:])
        inner = at[:-1][(at[:-1] < n) & (at[1:] > at[:-1])]
        start[inner] = word[inner]
    s = np.flatnonzero(start)
    # a word ends before the next blank, the next word's start or the row's end
    end = np.empty(n, dtype=bool)
    if n:
        end[-1] = word[-1]
        np.logical_and(word[:-1], ~word[1:] | start[1:], out=end[:-1])
    e = np.flatnonzero(end) + 1
    up, down = _powers.get(n + 1)
    total = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum((_LOWER[body] if lower else body).astype(np.uint64) * up[:n] + up[:n], out=total[1:])
    return mix((total[e] - total[s]) * down[s] + (e - s).astype(np.uint64)), np.searchsorted(s, at)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct hashes of each row's word shingles, and where each row's begin. A row of fewer words has its
    whole sequence as one shingle; a row without words has none."""
    h, at = word_hashes(data, offsets)
    return sets_of(h, at, width)


def sets_of(h: np.ndarray, at: np.ndarray, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    odd = [U(pow(_BASE, 2 * k + 3, 1 << 64) | 1) for k in range(width)]
    n, rows = len(h), len(at) - 1
    if n >= width:
        g = h[: n - width + 1] * odd[0]
        for k in range(1, width):
            g = g + h[k : n - width + 1 + k] * odd[k]
        g = mix(g)
    else:
        g = np.zeros(0, np.uint64)
    out, sizes = [], np.zeros(rows, np.int64)
    for i in range(rows):
        a, b = at[i], at[i + 1]
        if b - a >= width:
            u = np.unique(g[a : b - width + 1])
        elif b > a:
            with np.errstate(over="ignore"):
                x = U(b - a)
                for k in range(b - a):
                    x = x + h[a + k] * odd[k]
            u = mix(np.array([x ^ U(0xA5A5A5A5A5A5A5A5)]))
        else:
            continue
        out.append(u)
        sizes[i] = len(u)
    return (np.concatenate(out) if out else np.zeros(0, np.uint64)), np.concatenate([[0], np.cumsum(sizes)])
