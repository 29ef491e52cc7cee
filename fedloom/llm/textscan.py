"""Vectorised scans of Arrow text columns.

A text column's UTF-8 bytes are looked at as one numpy array: words, their 64-bit hashes and n-gram
hashes come from whole-array operations, without a Python object for each word. Work is cut into slices
of about CHUNK bytes of text, never inside a document, so memory follows the longest document and not
the batch.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

CHUNK = 1 << 20
_BASE = np.uint64(0x9E3779B97F4A7C55)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C55, -1, 1 << 64))
_STEP = np.uint64(0xD1342543DE82EF95)

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Word bytes of the licence contract: digits, ASCII letters, and all bytes of code points from 128 on.
ALNUM = np.zeros(256, bool)
ALNUM[48:58] = ALNUM[65:91] = ALNUM[97:123] = ALNUM[128:] = True

_powers: dict[str, np.ndarray] = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def _grow(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers["up"]) < n:
        for name, base in (("up", _BASE), ("down", _INVERSE)):
            x = np.full(n, base, np.uint64)
            x[0] = 1
            _powers[name] = np.multiply.accumulate(x)
    up, down = _powers["up"][:n], _powers["down"][:n]
    if n > 8 * CHUNK:  # a very long document's tables aren't kept
        _powers.update(up=_powers["up"][: 2 * CHUNK].copy(), down=_powers["down"][: 2 * CHUNK].copy())
    return up, down


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers whose bits all depend on all bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def released(run: Callable) -> Callable:
    """run, a function over Arrow batches, after whose last one the Python worker returns free memory to the system: workers outlive tasks and stages."""

    def inner(batches):
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
            if trim:
                trim(0)

    return inner


def text_array(column) -> pa.Array:
    """Nulls as empty texts, with 32- or 64-bit offsets."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not (pa.types.is_string(column.type) or pa.types.is_large_string(column.type)):
        column = column.cast(pa.large_string())
    return column.fill_null("") if column.null_count else column


def slices(texts: pa.Array, size: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Row ranges of about size bytes of text, of one row at least."""
    offsets = byte_offsets(texts)
    i, n = 0, len(texts)
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + size, side="right")) - 1
        j = min(max(j, i + 1), n)
        yield i, j
        i = j


def byte_offsets(texts: pa.Array) -> np.ndarray:
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    raw = np.frombuffer(texts.buffers()[1], np.int64 if wide else np.int32)
    return raw[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)


class Words:
    """Words of the rows i to j of a text array.

    data: their bytes (lower-cased A-Z on request); start, end: byte ranges of words in data;
    row: each word's row counted from i; first: index of each row's first word, one more at the end.
    """

    def __init__(self, texts: pa.Array, i: int, j: int, lower: bool = False, letters: np.ndarray | None = None):
        offsets = byte_offsets(texts)[i : j + 1]
        lo, hi = int(offsets[0]), int(offsets[-1])
        values = texts.buffers()[2]
        data = np.frombuffer(values, np.uint8)[lo:hi] if values is not None and hi > lo else np.zeros(0, np.uint8)
        self.data = LOWER[data] if lower else data
        self.offsets = offsets - lo
        n = len(data)
        self.rows = j - i
        if not n:
            self.start = self.end = np.zeros(0, np.int64)
            self.first = np.zeros(self.rows + 1, np.int64)
            return
        word = letters[data] if letters is not None else ~SPACE[data]
        cut = np.zeros(n + 1, bool)
        cut[self.offsets] = True
        before = np.empty(n, bool)
        before[0] = False
        before[1:] = word[:-1]
        self.start = np.flatnonzero(word & (~before | cut[:-1]))
        after = np.empty(n, bool)
        after[-1] = False
        after[:-1] = word[1:]
        self.end = np.flatnonzero(word & (~after | cut[1:])) + 1
        self.first = np.searchsorted(self.start, self.offsets, side="left")

    @property
    def row(self) -> np.ndarray:
        return np.repeat(np.arange(self.rows), np.diff(self.first))

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word's bytes."""
        n = len(self.data)
        if not len(self.start):
            return np.zeros(0, np.uint64)
        up, down = _grow(n + 1)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum((self.data.astype(np.uint64) + np.uint64(1)) * up[:n], out=sums[1:])
        return mix((sums[self.end] - sums[self.start]) * down[self.start])

    def of(self, row: int) -> list[bytes]:
        """One row's words."""
        raw = self.data.tobytes() if not hasattr(self, "_raw") else self._raw
        self._raw = raw
        a, b = self.first[row], self.first[row + 1]
        return [raw[s:e] for s, e in zip(self.start[a:b].tolist(), self.end[a:b].tolist(), strict=True)]


def ngrams(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the k consecutive words from each position on; len(hashes) - k + 1 of them, rows' borders not looked at."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = hashes[:n].copy()
    for j in range(1, k):
        out *= _STEP
        out += hashes[j : j + n]
    return mix(out)


def sequence_mix(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the k consecutive items from each position on, built from powers of two of them."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out, done, piece, width = None, 0, h, 1
    while True:
        if k & width:
            part = piece[done : done + n]
            out = part.copy() if out is None else out * np.uint64(pow(int(_STEP), width, 1 << 64)) + part
            done += width
        if done == k:
            return mix(out)
        piece = piece[: len(piece) - width] * np.uint64(pow(int(_STEP), width, 1 << 64)) + piece[width:]
        width *= 2


def signed(x: np.ndarray) -> np.ndarray:
    """As Spark's longs."""
    return x.view(np.int64)


def batches(texts: pa.Array, size: int = CHUNK, **how) -> Iterator[tuple[int, int, Words]]:
    for i, j in slices(texts, size):
        yield i, j, Words(texts, i, j, **how)
