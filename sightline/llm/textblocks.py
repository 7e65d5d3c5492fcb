"""Words of many texts at once, as numpy arrays over the UTF-8 bytes of an Arrow column."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
_GOLDEN = U64(0x9E3779B97F4A7C15)
_ODD = 0x5851F42D4C957F2D


def step(k: int) -> np.uint64:
    """k steps of the golden ratio, modulo 2^64."""
    return U64(k * int(_GOLDEN) & 0xFFFFFFFFFFFFFFFF)


_WHITE = np.zeros(256, bool)
_WHITE[[0x20, *range(0x09, 0x0E)]] = True


def mix64(x: np.ndarray) -> np.ndarray:
    """A finaliser that spreads every input bit over the output (splitmix64's)."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


#: A random 64-bit value for each byte; the second table has those of a-z at A-Z.
_BYTE = mix64(np.arange(1, 257, dtype=U64) * _GOLDEN)
_FOLDED = _BYTE.copy()
_FOLDED[65:91] = _BYTE[97:123]
_INVERSE = pow(_ODD, -1, 1 << 64)


class _Powers:
    """Powers of the odd base and of its inverse modulo 2^64, as many as were ever needed."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, U64)

    def need(self, n: int) -> None:
        if len(self.up) < n:
            n = max(n, 1 << 20)
            self.up = np.multiply.accumulate(np.concatenate([np.ones(1, U64), np.full(n, _ODD, U64)]))
            self.down = np.multiply.accumulate(np.concatenate([np.ones(1, U64), np.full(n, _INVERSE, U64)]))


_POWERS = _Powers()


def blocks(column: pa.Array, most_bytes: int = 1 << 21, most_rows: int = 1 << 12) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets of the rows in them) for runs of rows.

    A run holds at most most_rows, and most_bytes unless a single row has more; null is empty.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    if not n:
        return
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], kind)[column.offset : column.offset + n + 1].astype(np.int64)
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
    a = 0
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + most_bytes, "right")) - 1)
        b = min(b, a + most_rows, n)
        yield a, b, data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
        a = b


def word_bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and rows of all words."""
    if not len(data):
        empty = np.zeros(0, np.int64)
        return empty, empty, empty
    ink = ~_WHITE[data]
    first = ink.copy()
    first[1:] &= ~ink[:-1]
    last = ink.copy()
    last[:-1] &= ~ink[1:]
    inner = offsets[1:-1]
    inner = inner[(inner > 0) & (inner < len(data))]
    first[inner] = ink[inner]
    last[inner - 1] = ink[inner - 1]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(offsets, starts, "right") - 1


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, fold: bool) -> np.ndarray:
    """A 64-bit hash of each word's bytes, with A-Z as a-z if fold."""
    if not len(starts):
        return np.zeros(0, U64)
    _POWERS.need(len(data) + 1)
    sums = np.empty(len(data) + 1, U64)
    sums[0] = 0
    np.cumsum((_FOLDED if fold else _BYTE)[data] * _POWERS.up[: len(data)], out=sums[1:])
    raw = (sums[ends] - sums[starts]) * _POWERS.down[starts]
    return mix64(raw + (ends - starts).astype(U64) * _GOLDEN)


def shingles(hashes: np.ndarray, rows: np.ndarray, n_rows: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and row of every run of width words; a row of fewer words has its whole sequence as one."""
    n = len(hashes)
    out, at = np.zeros(0, U64), np.zeros(0, np.int64)
    if n >= width:
        out = np.zeros(n - width + 1, U64)
        for k in range(width):
            out = mix64(out * U64(3) + hashes[k : n - width + 1 + k] + step(k + 1))
        whole = rows[: n - width + 1] == rows[width - 1 :]
        out, at = out[whole], rows[: n - width + 1][whole]
    counts = np.bincount(rows, minlength=n_rows) if n else np.zeros(n_rows, np.int64)
    short = np.flatnonzero((counts > 0) & (counts < width))
    if len(short):
        first = np.cumsum(counts) - counts
        own = np.full(len(short), 7, U64) + counts[short].astype(U64)
        for k in range(width - 1):
            has = counts[short] > k
            own[has] = mix64(own[has] * U64(5) + hashes[first[short][has] + k] + step(k + 11))
        order = np.argsort(np.concatenate([at, short]), kind="stable")
        out, at = np.concatenate([out, own])[order], np.concatenate([at, short])[order]
    return out, at


def distinct_by_row(values: np.ndarray, rows: np.ndarray, n_rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Each row's distinct values, sorted; and each row's place among them (n_rows + 1 offsets). rows ascends."""
    bounds = np.searchsorted(rows, np.arange(n_rows + 1))
    kept, sizes = [], np.zeros(n_rows + 1, np.int64)
    for k in range(n_rows):
        a, b = bounds[k], bounds[k + 1]
        if b - a == 1:
            own = values[a:b]
        elif b > a:
            own = np.sort(values[a:b])
            own = own[np.concatenate([[True], own[1:] != own[:-1]])]
        else:
            continue
        kept.append(own)
        sizes[k + 1] = len(own)
    return (np.concatenate(kept) if kept else np.zeros(0, U64)), np.cumsum(sizes)


def shingle_sets(column: pa.Array, width: int, most_bytes: int = 1 << 21) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, distinct shingle hashes by row, offsets), A-Z as a-z."""
    for a, b, data, offsets in blocks(column, most_bytes):
        starts, ends, rows = word_bounds(data, offsets)
        found, at = shingles(word_hashes(data, starts, ends, fold=True), rows, b - a, width)
        yield a, b, *distinct_by_row(found, at, b - a)
