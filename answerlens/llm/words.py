"""Words of whole texts as numpy arrays: the shared front end of the text operators.

Texts arrive as Arrow string columns.  They are cut into slices of whole documents of half a megabyte, so memory
follows the slice (or the one longest document), never the batch.  A word is a run of bytes outside space and
0x09-0x0D; these are ASCII, so words can be cut on UTF-8 bytes.  Words and word windows are identified by 64-bit
rolling hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 19
U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """Scramble 64-bit values (the splitmix64 finalizer)."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


class Powers:
    """Powers of an odd base modulo 2^64 and of its inverse, grown on demand."""

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, U)

    def to(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > len(self.up):
            self.up, self.down = self._grow(self.base, n), self._grow(self.inverse, n)
        return self.up[:n], self.down[:n]

    @staticmethod
    def _grow(base: int, n: int) -> np.ndarray:
        out = np.ones(n, U)
        k = 1
        while k < n:
            step = min(k, n - k)
            out[k:k + step] = out[:step] * U(pow(base, k, 1 << 64))
            k += step
        return out


_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BYTE = mix(np.arange(1, 257, dtype=U))
_BYTES, _WORDS = Powers(0x9E3779B97F4A7C17), Powers(0xD1342543DE82EF97)


def prefix_hash(values: np.ndarray, powers: Powers) -> np.ndarray:
    """P with P[j] - P[i] = sum of values[i..j) times ascending powers."""
    out = np.zeros(len(values) + 1, U)
    np.cumsum(values * powers.to(len(values))[0], out=out[1:])
    return out


def span_hash(prefix: np.ndarray, powers: Powers, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of each span, the same wherever the span lies."""
    down = powers.to(len(prefix))[1]
    return mix((prefix[end] - prefix[start]) * down[start] + (end - start).astype(U))


class Slice:
    """Documents ``lo..hi`` of a batch: their bytes, words and line breaks."""

    def __init__(self, lo: int, hi: int, data: np.ndarray, bounds: np.ndarray):
        self.lo, self.hi, self.data, self.bounds = lo, hi, data, bounds
        self.docs = hi - lo
        space = _SPACE[data]
        edge = np.zeros(len(data) + 1, bool)
        edge[bounds] = True
        ink = ~space
        begins = ink.copy()
        begins[1:] &= space[:-1] | edge[1:-1]
        stops = ink.copy()
        stops[:-1] &= space[1:] | edge[1:-1]
        self.start = np.flatnonzero(begins)
        self.end = np.flatnonzero(stops) + 1
        #: first[d]..first[d + 1] are the words of document d
        self.first = np.searchsorted(self.start, bounds)
        self.n_words = np.diff(self.first)
        self.doc = np.repeat(np.arange(self.docs), self.n_words)
        self._bytes = self._hash = self._rolling = None

    @property
    def byte_prefix(self) -> np.ndarray:
        if self._bytes is None:
            self._bytes = prefix_hash(_BYTE[self.data], _BYTES)
        return self._bytes

    @property
    def word_hash(self) -> np.ndarray:
        if self._hash is None:
            self._hash = span_hash(self.byte_prefix, _BYTES, self.start, self.end)
        return self._hash

    def byte_spans(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return span_hash(self.byte_prefix, _BYTES, start, end)

    def word_spans(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hashes of the word sequences start..end (word numbers)."""
        if self._rolling is None:
            self._rolling = prefix_hash(self.word_hash, _WORDS)
        return span_hash(self._rolling, _WORDS, start, end)

    def window_starts(self, n: int) -> np.ndarray:
        """Numbers of the words that begin a window of ``n`` words inside their document."""
        if not len(self.start):
            return np.zeros(0, np.int64)
        left = self.first[self.doc + 1] - np.arange(len(self.start))
        return np.flatnonzero(left >= n)

    def covered(self, window: np.ndarray, n: int) -> np.ndarray:
        """Which words lie in one of the windows of ``n`` words that begin at ``window``."""
        step = np.zeros(len(self.start) + 1, np.int64)
        step[window] += 1
        step[window + n] -= 1
        return np.cumsum(step[:-1]) > 0

    def per_doc(self, values: np.ndarray) -> np.ndarray:
        """Sums over the words of each document."""
        total = np.concatenate(([0], np.cumsum(values, dtype=np.int64)))
        return total[self.first[1:]] - total[self.first[:-1]]

    def per_doc_bytes(self, values: np.ndarray) -> np.ndarray:
        """Sums over the bytes of each document."""
        total = np.concatenate(([0], np.cumsum(values, dtype=np.int64)))
        return total[self.bounds[1:]] - total[self.bounds[:-1]]


def slices(column: pa.Array, lower: bool = False, limit: int = SLICE_BYTES) -> Iterator[Slice]:
    """Cut a string column into slices of whole documents; nulls count as empty texts."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    texts = pc.fill_null(column.cast(pa.large_string()), "")
    n = len(texts)
    if not n:
        return
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + n + 1]
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1)
        part = data[offsets[lo]:offsets[hi]]
        yield Slice(lo, hi, _LOWER[part] if lower else part, offsets[lo:hi + 1] - offsets[lo])
        lo = hi


def crc_of_ids(ids: list) -> np.ndarray:
    """crc32 of each id as text (null: of the empty text)."""
    import zlib

    return np.fromiter((zlib.crc32(b"" if i is None else str(i).encode()) for i in ids), np.int64, len(ids))


def ids_of(column: pa.Array, missing: int = np.iinfo(np.int64).max) -> np.ndarray:
    """Integer ids with a stand-in for nulls, which sorts last."""
    return pc.fill_null(column.cast(pa.int64()), missing).to_numpy(zero_copy_only=False)


def per_group(order_keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sort order and, in that order, whether a value equals the one before it."""
    order = np.argsort(order_keys, kind="stable")
    ranked = order_keys[order]
    same = np.zeros(len(ranked), bool)
    same[1:] = ranked[1:] == ranked[:-1]
    return order, same
