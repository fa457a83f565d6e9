"""Periodic runs of words: where a text repeats itself without a break.

A run is a stretch of consecutive words with smallest period q that no neighbouring word extends, of at least
``LEAST_POWER`` periods and ``LEAST_WORDS`` words. Words are numbered so that equal numbers are equal bytes (``transducer``), for all texts of
a chunk at once: words of different texts have different numbers, so no run leaves its text.

*Short periods* (below ``SHORT``) are found by scans at each lag. *Longer ones* are found scale by scale, L = 8, 16, 32, ...
for periods from L to 2L - 1. Each position has the hash of the 2L - 1 words that begin there; the minima of all windows
of L positions are kept. In a run of four periods two windows one period apart lie inside it and are equal, so their
minima are too, at the distance of the period; and as 2L - 1 words hold a whole period, no equal hash lies between them.
So the run has two equal minimizers that follow each other at its period: such pairs are the seeds. A seed is extended to
both sides while words one lag apart are equal, which tests it, and the stretch is a run if no divisor of the lag is a period too.

A scale costs time in proportion to the texts that are long enough for it, a text of n words has log2(n) scales, and no
pair of positions but neighbours is ever looked at. Memory follows the longest text of a task.

Edge cases: null, empty and blank texts have no words and no runs; a text of one word repeated is one run of period 1; equal
texts have equal runs; repeated rows are rows; other columns are ignored unless kept.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator, Sequence
from functools import cache
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from llm import transducer as t
from llm.kernel import mix

LEAST_POWER, LEAST_WORDS, SHORT = 4, 6, 8
JOINED = 4096  # words that are joined at once
_BASE = np.uint64(0x9E3779B97F4A7C15)


@cache
def _prime_factors(q: int) -> tuple[int, ...]:
    out, p = [], 2
    while p * p <= q:
        if q % p == 0:
            out.append(p)
            while q % p == 0:
                q //= p
        p += 1
    return tuple(out + [q] * (q > 1))


def _least(q: int) -> int:
    return max(LEAST_WORDS, LEAST_POWER * q)


def _primitive(w: np.ndarray, start: int, end: int, q: int) -> bool:
    """Whether no proper divisor of ``q`` is a period of ``w[start:end]`` too."""
    return not any(np.array_equal(w[start + q // p : end], w[start : end - q // p]) for p in _prime_factors(q))


def short_runs(w: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """Runs ``(start, length, period)`` of periods below ``SHORT``, by direct scans."""
    for q in range(1, min(SHORT, len(w) // LEAST_POWER + 1)):
        same = np.zeros(len(w) - q + 2, np.int8)
        same[1:-1] = w[q:] == w[:-q]
        edge = np.diff(same)
        starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        long = ends - starts >= _least(q) - q
        for s, e in zip(starts[long].tolist(), ends[long].tolist(), strict=True):
            if _primitive(w, s, e + q, q):
                yield s, e + q - s, q


def _windowed(v: np.ndarray, size: int, of: Callable) -> np.ndarray:
    """``of`` (minimum or maximum) of each window of ``size`` values, a power of two."""
    step = 1
    while step < size:
        v = of(v[:-step], v[step:])
        step *= 2
    return v


def minimizers(w: np.ndarray, scale: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the window minima at a scale, and the hashes that are minimal there."""
    m = 2 * scale - 1
    with np.errstate(over="ignore"):
        # each word's hash times a power of the base, summed up; the power at a gram's begin is divided out
        n = len(w)
        up = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, _BASE)]), dtype=np.uint64)
        down = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, np.uint64(pow(int(_BASE), -1, 1 << 64)))]), dtype=np.uint64)
        sums = np.concatenate([[np.uint64(0)], np.cumsum(mix(w.astype(np.uint64) + np.uint64(1)) * up[:n], dtype=np.uint64)])
        gram = mix((sums[m:] - sums[:-m]) * down[: n - m + 1])
    if len(gram) < scale:
        return np.zeros(0, np.int64), gram[:0]
    least = np.zeros(len(gram) + scale - 1, np.uint64)  # of the windows that begin at each position; none before and behind
    least[scale - 1 : len(gram)] = _windowed(gram, scale, np.minimum)
    at = np.flatnonzero(_windowed(least, scale, np.maximum) == gram)
    return at, gram[at]


def _matching(w: np.ndarray, at: int, q: int, step: int) -> int:
    """How many words from ``at`` on (``step`` 1) or before it (-1) equal the word one lag further."""
    n, size, limit = 0, 64, len(w) - q - at if step > 0 else at
    while n < limit:
        k = min(size, limit - n)
        a = at + n if step > 0 else at - n - k
        differ = w[a : a + k] != w[a + q : a + q + k]
        if differ.any():
            return n + int(np.argmax(differ if step > 0 else differ[::-1]))
        n, size = n + k, size * 2
    return n


def long_runs(w: np.ndarray, scale: int) -> Iterator[tuple[int, int, int]]:
    """Runs of periods from ``scale`` to ``2 * scale - 1``."""
    at, value = minimizers(w, scale)
    order = np.lexsort((at, value))
    at, value = at[order], value[order]
    lag = np.diff(at)
    seeds = np.flatnonzero((value[1:] == value[:-1]) & (lag >= scale) & (lag < 2 * scale))
    seeds = seeds[np.lexsort((at[seeds], lag[seeds]))]
    lags, places = lag[seeds], at[seeds]
    cuts = np.flatnonzero(np.r_[True, lags[1:] != lags[:-1], True]) if len(lags) else []
    for first, last in pairwise(cuts):
        q, own, i = int(lags[first]), places[first:last], 0
        while i < len(own):
            p = int(own[i])
            s, e = p - _matching(w, p, q, -1), p + _matching(w, p, q, 1)
            if e + q - s >= _least(q) and _primitive(w, s, e + q, q):
                yield s, e + q - s, q
            i = max(i + 1, int(np.searchsorted(own, e)))  # past the seeds of the same stretch


def runs_of(numbers: np.ndarray, bounds: np.ndarray) -> list[tuple[int, int, int]]:
    """All runs ``(start, length, period)`` of texts whose words are ``numbers[bounds[i]:bounds[i + 1]]``, by start, then period.

    Numbers of different texts must differ.
    """
    out = list(short_runs(numbers))
    sizes = np.diff(bounds)
    scale = SHORT
    while len(sizes) and LEAST_POWER * scale <= sizes.max():
        able = np.repeat(sizes >= LEAST_POWER * scale, sizes)
        where = np.flatnonzero(able)
        out += [(int(where[s]), n, q) for s, n, q in long_runs(numbers[where], scale)]
        scale *= 2
    return sorted(out, key=lambda r: (r[0], r[2]))


def strongest(runs: Column) -> Column:
    """The run with the greatest exact length / period; ties go to the smallest start, then period. Null without runs."""

    def better(best: Column, r: Column) -> Column:  # runs come by start, then period, so the first of equals stays
        return F.when(best.isNull() | (r["length"] * best["period"] > best["length"] * r["period"]), r).otherwise(best)

    return F.aggregate(runs, F.lit(None).cast("struct<start:long,length:long,period:long>"), better)


def edited(row: dict, n: int) -> np.ndarray | None:
    """The edit that the query makes in a tenth of the documents: from a place on, the first words repeat to the end."""
    if row["doc_id"] is None or not n:
        return None
    g, chosen = divmod(zlib.crc32(str(row["doc_id"]).encode()), 10)
    if chosen:
        return None
    a = g % n
    i = np.arange(n)
    return np.where(i < a, i, a + (i - a) % (1 + (n - a) // (3 + g % 8)))


def periodic_runs(docs: DataFrame, keep: Sequence[str] = ("doc_id",), taken_from: Callable[[dict, int], np.ndarray | None] | None = None) -> DataFrame:
    """``(*keep, n_words, runs, collapsed)``: ``runs`` are ``struct<start, length, period>`` (long) by start, then period, and
    ``collapsed`` is the text's words, joined by one space, without those that a run repeats (all of a run but its first
    period, unless another run drops these too).

    ``taken_from(row of keep, n)`` may give, for a text of n words, the number of the word that stands at each place in
    place of the text's own (an edit that only moves or repeats words), or None.
    """

    def run(batches):
        for b in batches:
            rows = b.select(list(keep)).to_pylist()
            counts, runs, texts = [], [], []
            for s in t.scan(b.column("text")):
                bounds, index = s.bounds, np.arange(len(s.starts))
                same = t.residents(s.raw, s.starts, s.ends, s.docs())
                if taken_from:
                    for i in range(s.n_docs):
                        if (new := taken_from(rows[s.first + i], int(bounds[i + 1] - bounds[i]))) is not None:
                            index[bounds[i] : bounds[i + 1]] = bounds[i] + new
                found = runs_of(same[index], bounds)
                dropped = np.zeros(len(index) + 1, np.int64)
                for start, length, q in found:
                    dropped[start + q] += 1
                    dropped[start + length] -= 1
                kept = np.cumsum(dropped[:-1]) == 0
                of = np.searchsorted(bounds, [r[0] for r in found], side="right") - 1
                lists = [[] for _ in range(s.n_docs)]
                for i, (start, length, q) in zip(of.tolist(), found, strict=True):
                    lists[i].append({"start": start - int(bounds[i]), "length": length, "period": q})
                data = s.raw.tobytes()
                for i in range(s.n_docs):
                    own = index[bounds[i] : bounds[i + 1]][kept[bounds[i] : bounds[i + 1]]]
                    parts = (own[k : k + JOINED] for k in range(0, len(own), JOINED))
                    texts.append(b" ".join(b" ".join([data[x:y] for x, y in zip(s.starts[p].tolist(), s.ends[p].tolist(), strict=True)]) for p in parts))
                counts.append(np.diff(bounds))
                runs += lists
            column = pa.array(runs, pa.list_(pa.struct([(c, pa.int64()) for c in ("start", "length", "period")])))
            text = pa.array(texts, pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array(np.concatenate([*counts, np.zeros(0, np.int64)]).astype(np.int64)), column, text], [*keep, "n_words", "runs", "collapsed"])

    kinds = dict(docs.dtypes)
    more = [] if "text" in keep else [F.col("text").cast("string").alias("text")]
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in keep), "n_words long", "runs array<struct<start:long,length:long,period:long>>", "collapsed string"])
    return docs.select(*keep, *more).mapInArrow(run, schema)
