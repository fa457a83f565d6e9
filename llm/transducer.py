"""A table-driven byte transducer over UTF-8 texts, and a verified hash table of the word spans that it reports.

The machine reads bytes. Its states are: between words, in a word at the end of a code point, and in a word with one, two
or three continuation bytes to come. ``NEXT`` has the state after each byte, ``EMIT`` what the step reports: a word begins,
a capital ``A`` to ``Z``, a code point, a symbol. A word ends where the machine returns to the first state. Stray
continuation bytes count as code points, so every byte string has a result.

The machine is run over a whole Arrow column in numpy: the bytes are cut into blocks, all blocks step side by side from
every state, and the blocks' ends are then chained, so a byte costs a few table look-ups and no Python.

Word spans are inserted into an open-addressing table by a 64-bit hash of document and bytes; where a slot is taken, the
bytes of both words are compared, and a different word probes on. So equal means equal in all bytes, whatever the hash.

A text is read whole. Texts of more than ``CHUNK_BYTES`` are chunks of their own; their words are inserted piece by piece
and only distinct ones are carried on, so memory follows the text's vocabulary.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

from llm.kernel import mix, string_buffers

CHUNK_BYTES, STRIP, BLOCK = 1 << 18, 1 << 20, 64
BETWEEN, WORD = 0, 1
STATES = 5
BEGINS, CAPITAL, POINT, SYMBOL = 1, 2, 4, 8
SPACES, SYMBOLS = b" \t\n\x0b\x0c\r", b"#$%&*|"


def tables() -> tuple[np.ndarray, np.ndarray]:
    """``NEXT[state, byte]`` and ``EMIT[state, byte]``."""
    after, emit = np.zeros((STATES, 256), np.uint8), np.zeros((STATES, 256), np.uint8)
    for state in range(STATES):
        for byte in range(256):
            inside = state != BETWEEN
            if byte in SPACES:
                after[state, byte], out = BETWEEN, POINT
            elif 0x80 <= byte < 0xC0 and state > WORD:
                after[state, byte], out = state - 1, 0
            else:
                more = 0 if byte < 0xC0 else 1 if byte < 0xE0 else 2 if byte < 0xF0 else 3
                after[state, byte] = WORD + more
                out = POINT | (0 if inside else BEGINS) | (CAPITAL if 65 <= byte <= 90 else 0) | (SYMBOL if byte in SYMBOLS else 0)
            emit[state, byte] = out
    return after, emit


NEXT, EMIT = tables()


def run(data: np.ndarray, firsts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """State before and after each byte, when the machine starts anew at each of ``firsts``."""
    n = len(data)
    fresh = np.zeros(n, bool)
    fresh[firsts[firsts < n]] = True
    before, state = np.empty(n, np.uint8), BETWEEN
    for at in range(0, n, STRIP):
        before[at : at + STRIP], state = _strip(data[at : at + STRIP], fresh[at : at + STRIP], state)
    return before, NEXT.ravel()[before.astype(np.int64) * 256 + data]


def _strip(data: np.ndarray, fresh: np.ndarray, at: int) -> tuple[np.ndarray, int]:
    """State before each byte when the machine comes in state ``at``, and the state after the last byte.

    Blocks of ``BLOCK`` bytes step side by side from all states. A text's first byte is read from ``BETWEEN`` whatever the
    state, so texts needn't begin with a block.
    """
    n = len(data)
    blocks = -(-n // BLOCK)
    grid, anew = np.full(blocks * BLOCK, 32, np.int64), np.zeros(blocks * BLOCK, bool)
    grid[:n], anew[:n] = data, fresh
    grid, anew = np.ascontiguousarray(grid.reshape(blocks, BLOCK).T), np.ascontiguousarray(anew.reshape(blocks, BLOCK).T)
    state = np.repeat(np.arange(STATES, dtype=np.int64)[:, None], blocks, axis=1)
    seen = np.empty((BLOCK, STATES, blocks), np.uint8)
    table = NEXT.ravel()
    for j in range(BLOCK):
        if anew[j].any():
            state[:, anew[j]] = BETWEEN
        seen[j] = state
        state = table.take((state << 8) + grid[j]).astype(np.int64)
    ends, start = state.T.tolist(), []
    tail = n - (blocks - 1) * BLOCK
    for block in ends:
        start.append(at)
        at = block[at]
    before = np.take_along_axis(seen, np.array(start, np.int64)[None, None, :], axis=1)[:, 0].T.ravel()[:n]
    if tail < BLOCK:  # white space fills the last block up
        at = int(NEXT[before[-1], data[-1]])
    return before, at


@dataclass
class Scanned:
    """What the transducer reports of the texts ``first`` to ``first + n_docs`` of a batch."""

    first: int
    n_docs: int
    raw: np.ndarray  # the bytes
    bytes: np.ndarray  # those of text i are bytes[i]:bytes[i + 1]
    bounds: np.ndarray  # words of text i are bounds[i]:bounds[i + 1]
    starts: np.ndarray  # positions of the words
    ends: np.ndarray
    emitted: np.ndarray  # what each byte's step reported

    def count(self, what: int) -> np.ndarray:
        """Steps of each text that reported ``what``."""
        sums = np.concatenate([[0], np.cumsum((self.emitted & what) != 0)])
        return sums[self.bytes[1:]] - sums[self.bytes[:-1]]

    def docs(self) -> np.ndarray:
        """The text of each word."""
        return np.repeat(np.arange(self.n_docs), np.diff(self.bounds))


def scan(column: pa.Array, chunk_bytes: int = CHUNK_BYTES) -> Iterator[Scanned]:
    """The transducer's report of every text, in chunks of about ``chunk_bytes``; nulls are empty texts."""
    data, offsets = string_buffers(column)
    n, at = len(offsets) - 1, 0
    while at < n:
        to = int(np.searchsorted(offsets, offsets[at] + chunk_bytes, side="right")) - 1
        to = min(n, max(to, at + 1))
        yield scanned(data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at], at)
        at = to


def scanned(raw: np.ndarray, offsets: np.ndarray, first: int = 0) -> Scanned:
    before, after = run(raw, offsets[:-1])
    emitted = EMIT.ravel()[before.astype(np.int64) * 256 + raw]
    starts = np.flatnonzero(emitted & BEGINS)
    # a word ends at white space that follows it or where its text does
    inside = after != BETWEEN
    stops = inside.copy()
    if len(raw):
        stops[:-1] &= ~inside[1:]
        lasts = offsets[1:][np.diff(offsets) > 0] - 1
        stops[lasts] = inside[lasts]
    ends = np.flatnonzero(stops) + 1
    return Scanned(first, len(offsets) - 1, raw, offsets, np.searchsorted(starts, offsets), starts, ends, emitted)


def _loaded(raw: np.ndarray) -> np.ndarray:
    """Eight bytes from each position on, as numbers."""
    padded = np.concatenate([raw, np.zeros(8, np.uint8)])
    return np.lib.stride_tricks.as_strided(padded.view(np.uint8)[:8].view("<u8"), (len(raw) + 1,), (1,), writeable=False)


def _eight(loaded: np.ndarray, at: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The bytes ``at`` to ``at + min(8, length)`` as numbers."""
    shift = np.uint64(8) * (np.uint64(8) - np.clip(length, 0, 8).astype(np.uint64))
    x = loaded[at]
    return np.where(length > 0, (x << np.minimum(shift, np.uint64(63))) >> np.minimum(shift, np.uint64(63)), np.uint64(0))


def hashes(loaded: np.ndarray, starts: np.ndarray, ends: np.ndarray, docs: np.ndarray) -> np.ndarray:
    """A hash of the text's number and the bytes of each word."""
    with np.errstate(over="ignore"):
        length = ends - starts
        h = mix((docs.astype(np.uint64) << np.uint64(20)) ^ length.astype(np.uint64))
        step, live = 0, np.arange(len(starts))
        while len(live):
            part = _eight(loaded, starts[live] + 8 * step, length[live] - 8 * step)
            h[live] = mix((h[live] ^ part) + np.uint64(0x9E3779B97F4A7C15))
            step += 1
            live = live[length[live] > 8 * step]
    return h


def _equal(loaded: np.ndarray, starts: np.ndarray, ends: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Whether the words ``x`` and ``y`` have equal bytes."""
    length = ends[x] - starts[x]
    same = length == ends[y] - starts[y]
    step, live = 0, np.flatnonzero(same)
    while len(live):
        a = _eight(loaded, starts[x[live]] + 8 * step, length[live] - 8 * step)
        good = a == _eight(loaded, starts[y[live]] + 8 * step, length[live] - 8 * step)
        same[live[~good]] = False
        step += 1
        live = live[good & (length[live] > 8 * step)]
    return same


def residents(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, docs: np.ndarray, of_hash=hashes) -> np.ndarray:
    """For each word the number of the word that stands in the table for it: an equal one of the same text.

    All words look at their slots side by side. An empty slot goes to the first word that wants it; then every word
    compares itself with the slot's, and those that differ probe the next slot.
    """
    n = len(starts)
    loaded = _loaded(raw)
    size = 1 << max(4, (2 * n).bit_length())
    slots = np.full(size, n, np.int64)
    place = (of_hash(loaded, starts, ends, docs) & np.uint64(size - 1)).astype(np.int64)
    out, pending = np.empty(n, np.int64), np.arange(n)
    while len(pending):
        want = place[pending]
        # of words that want one empty slot, assignment keeps the last, so they are written from the last to the first
        empty = slots[want] == n
        slots[want[empty][::-1]] = pending[empty][::-1]
        held = slots[want]
        found = (docs[held] == docs[pending]) & _equal(loaded, starts, ends, pending, held)
        out[pending[found]] = held[found]
        pending = pending[~found]
        place[pending] = (place[pending] + 1) & (size - 1)
    return out


def distinct(s: Scanned, piece_words: int = 1 << 16) -> np.ndarray:
    """Distinct words of each text. A single text of many words is inserted in pieces, and only residents go on."""
    n = len(s.starts)
    if s.n_docs > 1 or n <= piece_words:
        docs = s.docs()
        return np.bincount(docs[residents(s.raw, s.starts, s.ends, docs) == np.arange(n)], minlength=s.n_docs)
    kept, at = np.zeros(0, np.int64), 0
    while at < n:
        to = min(n, at + max(piece_words, len(kept)))
        words = np.concatenate([kept, np.arange(at, to)])
        where = residents(s.raw, s.starts[words], s.ends[words], np.zeros(len(words), np.int64))
        kept, at = words[where == np.arange(len(words))], to
    return np.array([len(kept)])
