"""Vectorised word hashing over Arrow string columns.

All text operators of this subpackage read words the same way: ``A``-``Z`` are lower-cased and a word is a maximal
run of bytes other than space and 0x09-0x0D.  The functions below turn a whole Arrow column into numpy arrays of
word hashes without a Python loop over words, so that a Spark task spends a few nanoseconds per byte.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: Odd multipliers of the rolling hashes (any odd 64-bit numbers do; they are fixed so that runs agree).
_BASE = np.uint64(0x9E3779B97F4A7C15)
_STEP = np.uint64(0xD6E8FEB86659FD93)
_CHUNK_BYTES = 1 << 18
SHINGLE = 5


def _inverse(x: int) -> int:
    return pow(x, -1, 1 << 64)


class _Powers:
    """Powers of the base and of its inverse modulo 2**64, grown when a longer chunk arrives."""

    def __init__(self) -> None:
        self.up = np.ones(1, np.uint64)
        self.down = np.ones(1, np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 2 * len(self.up), _CHUNK_BYTES + 64)
            with np.errstate(over="ignore"):
                self.up = np.concatenate([[np.uint64(1)], np.cumprod(np.full(size, _BASE, np.uint64))])
                self.down = np.concatenate(
                    [[np.uint64(1)], np.cumprod(np.full(size, np.uint64(_inverse(int(_BASE))), np.uint64))]
                )
        return self.up, self.down


_powers = _Powers()
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """Final mixing of 64-bit hashes."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@dataclass
class Words:
    """Words of documents ``first`` to ``first + n_docs`` of a batch, in order."""

    first: int
    n_docs: int
    bounds: np.ndarray  # words of document i are bounds[i]:bounds[i + 1]
    hashes: np.ndarray  # one 64-bit hash for each word
    starts: np.ndarray  # byte positions in ``buf``
    ends: np.ndarray
    buf: np.ndarray  # lower-cased bytes of the chunk
    raw: np.ndarray  # the same bytes as they are
    byte_bounds: np.ndarray  # bytes of document i are byte_bounds[i]:byte_bounds[i + 1]
    sums: np.ndarray  # prefix sums of the rolling hash

    def prefix_hashes(self, n_bytes: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the first ``n_bytes`` bytes of each word that has as many, and these words' positions."""
        at = np.flatnonzero(self.ends - self.starts >= n_bytes)
        s = self.starts[at]
        down = _powers.down
        with np.errstate(over="ignore"):
            h = (self.sums[s + n_bytes] - self.sums[s]) * down[s]
        return mix(h ^ np.uint64(0xA5A5 + n_bytes)), at

    def doc_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(self.n_docs), np.diff(self.bounds))


def string_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; nulls count as empty texts."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if not pa.types.is_binary(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    offsets = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)
    offsets = offsets[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)), offsets


def words(column: pa.Array, chunk_bytes: int = _CHUNK_BYTES) -> Iterator[Words]:
    """Word hashes of every text, in chunks of about ``chunk_bytes`` (a longer text is a chunk of its own)."""
    data, offsets = string_buffers(column)
    n, at = len(offsets) - 1, 0
    while at < n:
        to = int(np.searchsorted(offsets, offsets[at] + chunk_bytes, side="right")) - 1
        to = min(n, max(to, at + 1))
        yield _chunk(data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at], at)
        at = to


def _chunk(raw: np.ndarray, offsets: np.ndarray, first: int) -> Words:
    n = len(raw)
    buf = _LOWER[raw]
    solid = ~_SPACE[raw]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    begins, stops = solid.copy(), solid.copy()
    if n:
        begins[1:] &= ~solid[:-1] | edge[1:n]
        stops[:-1] &= ~solid[1:] | edge[1:n]
    starts, ends = np.flatnonzero(begins), np.flatnonzero(stops) + 1
    up, down = _powers.upto(n + 1)
    with np.errstate(over="ignore"):
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum((buf.astype(np.uint64) + np.uint64(1)) * up[:n], out=sums[1:])
        hashes = mix((sums[ends] - sums[starts]) * down[starts])
    bounds = np.searchsorted(starts, offsets)
    return Words(first, len(offsets) - 1, bounds, hashes, starts, ends, buf, raw, offsets, sums)


def hash_words(texts: list[bytes]) -> np.ndarray:
    """Hashes of single words, equal to those that ``words`` gives."""
    column = pa.array(texts, pa.binary())
    parts = [w for w in words(column)]
    assert all(np.all(np.diff(w.bounds) == 1) for w in parts), "each text must be one word"
    return np.concatenate([w.hashes for w in parts]) if parts else np.zeros(0, np.uint64)


def rolled(h: np.ndarray, size: int) -> np.ndarray:
    """Hash of each run of ``size`` words, whatever document they are in."""
    total = len(h)
    with np.errstate(over="ignore"):
        out = np.zeros(max(0, total - size + 1), np.uint64)
        factor = np.uint64(1)
        for j in range(size):
            out += h[j : total - size + 1 + j] * factor
            factor = factor * _STEP
        return mix(out)


def shingles(w: Words, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Shingle hashes in text order with bounds for each document.

    A text with fewer than ``size`` words gives its whole sequence as one shingle, one without words none.
    """
    h, counts = w.hashes, np.diff(w.bounds)
    total = len(h)
    with np.errstate(over="ignore"):
        doc = w.doc_of_word()
        inside = doc[: total - size + 1] == doc[size - 1 :] if total >= size else np.zeros(0, bool)
        out = rolled(h, size)[inside]
        n_out = np.maximum(counts - size + 1, 0)
        short = np.flatnonzero((counts > 0) & (counts < size))
        if len(short):
            whole = np.zeros(len(short), np.uint64)
            factor = np.uint64(1)
            for j in range(size - 1):
                has = counts[short] > j
                whole[has] += h[w.bounds[short[has]] + j] * factor
                factor = factor * _STEP
            whole = mix(whole ^ (np.uint64(0x5151) + counts[short].astype(np.uint64)))
            where = np.concatenate([[0], np.cumsum(n_out)])[short]
            out = np.insert(out, where, whole)
            n_out[short] = 1
    return out, np.concatenate([[0], np.cumsum(n_out)])
