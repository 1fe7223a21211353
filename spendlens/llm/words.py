"""Words and word hashes of whole Arrow string columns, vectorised.

A batch's strings lie in one contiguous buffer, so words of all its documents
are found with a few numpy passes and no per-word Python.  Hashes are 64-bit
polynomials over a table of random byte values, finished with a mixing step; a
word of a document is identified by its bytes alone, whatever batch it is in.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_BYTE = np.random.default_rng(20).integers(1, 1 << 63, 256, dtype=np.uint64)
_powers: dict[str, np.ndarray] = {}

SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
#: Everything but ASCII letters, digits and bytes of non-ASCII characters.
NOT_ALNUM = np.ones(256, bool)
for _lo, _hi in ((0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF)):
    NOT_ALNUM[_lo:_hi + 1] = False
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every input bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """_BASE**i and _BASE**-i for i < n, modulo 2**64."""
    if len(_powers.get("up", ())) < n:
        m = max(n, 1 << 20)
        for name, base in (("up", _BASE), ("down", _INVERSE)):
            p = np.full(m, base, np.uint64)
            p[0] = 1
            _powers[name] = np.multiply.accumulate(p)
    return _powers["up"], _powers["down"]


def forget_powers() -> None:
    """Free the table of powers; the next call that needs it builds it again."""
    _powers.clear()


def buffer_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column (null: empty) and the n + 1 offsets of its rows."""
    column = column.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1]
    data = column.buffers()[2]
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[offsets[0]:offsets[-1]], offsets - offsets[0]


def slices(batch: pa.RecordBatch, column: str, size: int = 1 << 21) -> Iterator[pa.RecordBatch]:
    """Slices of about ``size`` bytes of the column, of one row at least: bounds what one pass holds."""
    ends = buffer_of(batch.column(column))[1]
    start = 0
    while start < batch.num_rows:
        stop = max(start + 1, int(np.searchsorted(ends, ends[start] + size, "right")) - 1)
        yield batch.slice(start, stop - start)
        start = stop


class Words:
    """Words of a string column: starts and ends in ``data``, and each row's first word."""

    def __init__(self, column: pa.Array, separator: np.ndarray = SPACE):
        raw, self.offsets = buffer_of(column)
        self.data = LOWER[raw]
        inside = ~separator[raw]
        first, last = inside.copy(), inside.copy()
        if len(raw):
            first[1:] &= ~inside[:-1]
            last[:-1] &= ~inside[1:]
            edge = self.offsets[(self.offsets > 0) & (self.offsets < len(raw))]
            first[edge] |= inside[edge]       # a word never runs on into the next row
            last[edge - 1] |= inside[edge - 1]
        self.starts = np.flatnonzero(first)
        self.ends = np.flatnonzero(last) + 1
        self.bounds = np.searchsorted(self.starts, self.offsets)  # words of row i: bounds[i]..bounds[i+1]
        self._sums: np.ndarray | None = None

    def hashes(self, longest: int | None = None) -> np.ndarray:
        """Hash of each word, or of its first ``longest`` bytes."""
        up, down = _power(len(self.data) + 1)
        if self._sums is None:
            self._sums = np.zeros(len(self.data) + 1, np.uint64)
            np.cumsum(_BYTE[self.data] * up[:len(self.data)], out=self._sums[1:])
        ends = self.ends if longest is None else np.minimum(self.ends, self.starts + longest)
        h = (self._sums[ends] - self._sums[self.starts]) * down[self.starts]
        return mix(h + (ends - self.starts).astype(np.uint64))

    def shingles(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all ``size``-word runs in row order, and the row each belongs to.

        A row with 1 to size - 1 words has its whole sequence as its only shingle.
        """
        h, counts = self.hashes(), np.diff(self.bounds)
        n, row = len(h), np.repeat(np.arange(len(counts)), counts)
        runs = max(n - size + 1, 0)
        total = h[:runs].copy()
        for k in range(1, size):
            total *= _BASE
            total += h[k:runs + k]
        inside = row[:runs] == row[size - 1:] if runs else np.zeros(0, bool)  # runs that end in the row they start in
        hashes, rows = total[inside], row[:runs][inside]
        short = np.flatnonzero((counts > 0) & (counts < size))
        if len(short):
            total = np.zeros(len(short), np.uint64)
            for k in range(size):
                here = np.minimum(self.bounds[short] + k, n - 1)
                total = total * _BASE + np.where(k < counts[short], h[here], np.uint64(k + 1))
            hashes, rows = np.concatenate([hashes, total]), np.concatenate([rows, short])
            order = np.argsort(rows, kind="stable")
            hashes, rows = hashes[order], rows[order]
        return mix(hashes), rows


def distinct_sets(hashes: np.ndarray, rows: np.ndarray, n_rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes of each row in ascending order, and each row's first position (n_rows + 1 bounds); rows ascend."""
    h = hashes.copy()
    bounds = np.searchsorted(rows, np.arange(n_rows + 1))
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        h[a:b].sort()
    keep = np.ones(len(h), bool)
    keep[1:] = (h[1:] != h[:-1]) | (rows[1:] != rows[:-1])
    kept_before = np.zeros(len(h) + 1, np.int64)
    np.cumsum(keep, out=kept_before[1:])
    return h[keep], kept_before[bounds]
