"""Benchmark decontamination by SimHash of item-sized windows and exact weighted-shingle similarity.

Words are hashed to 64 bits; the SimHash of a window is the bitwise majority of its words' hashes. Every item has windows
of two kinds (``windows_of``): the largest of ``WIDTHS`` that fits into it, at its beginning and its end, and tiles of at
most ``TILE`` words that overlap by half all over it. Documents are fingerprinted at every even word position for every
width in use; items have each window at two neighbouring offsets, so an unchanged one meets itself at distance 0
wherever it stands.

*Multi-index.* Fingerprints are cut into four 16-bit blocks. Two of them at distance at most r differ in at most r div 4 bits
in one block, and all values that near to an item's block are in that block's table, so none within r is missed: 11 for
item-sized windows (two bits), 3 for tiles (equal blocks). A document and an item of which two windows are that near
are a candidate, and there are no others: with an empty index nothing is found.

*Why tiles.* A changed word costs an item up to five shingles, an inserted or a missing one four. If every tile of twelve words
of an item were changed, it would lose more than a quarter of its shingles; so where shingles weigh alike, a copy that reaches
``SIMILARITY`` has an unchanged tile. Weights can differ, so recall is measured against brute force (tests).

*Verification.* The share of the item's 5-word shingles, weighted by their rarity among all items, that occur in a
stretch of the document as long as the item and twice ``slack_of`` its length, must reach ``SIMILARITY``; it is computed
exactly over the whole document, one candidate at a time. Candidates are gathered in slices of ``PAIRS`` pairs of windows, so
memory doesn't grow with how often a passage repeats in a text or among the items.

The items are the stated query set; they are applied in blocks of ``ITEM_BLOCK``, each a bounded broadcast, against
all rows, at most ``CHAIN`` blocks before the result is stored. Rarity and the number of items do not depend on blocks.

Edge cases: null or blank texts and items match nothing; items of fewer than 5 words are one shingle and match an equal
run of words; repeated items are one item, and an id with several texts counts once; documents are scored row by row, so
repeated rows get equal results; other columns are ignored; without items no document is contaminated.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from llm import kernel
from llm.common import stored

WIDTHS = (2, 4, 8, 12, 16, 24, 32, 48, 64, 96, 128, 192, 256, 384, 512, 1024)
#: Largest distance of fingerprints of item-sized windows and of tiles; bits of a block.
RADIUS, TILE_RADIUS, BLOCK_BITS = 11, 3, 16
SIMILARITY, SLACK, ITEM_BLOCK, CHAIN = 0.75, 2, 1000, 4
SLACK_PART, PAIRS = 4, 1 << 20
#: Widths of tiles by the least number of words of an item.
TILES = ((24, 12), (12, 8), (6, 4))
ENOUGH = SIMILARITY - 1e-9  # sums of weights are rounded


def width_of(n_words: int) -> tuple[int, int]:
    """Window width and stride for an item: even positions, or all of them for items of one or two words."""
    if n_words < 3:
        return n_words, 1
    return max(w for w in WIDTHS if w <= n_words - 1), 2


def windows_of(n_words: int) -> list[tuple[int, int, int, int]]:
    """``(width, stride, radius, offset)`` of an item's windows."""
    width, stride = width_of(n_words)
    out = {(width, stride, RADIUS, o) for at in (0, n_words - width - stride + 1) for o in range(at, at + stride)}
    tile = next((w for least, w in TILES if n_words >= least), None)
    if tile:
        last = n_words - tile - 1
        out |= {(tile, 2, TILE_RADIUS, o) for at in (*range(0, last, tile // 2), last) for o in (at, at + 1)}
    return sorted(out)


def slack_of(n_words: int) -> int:
    """Words by which a copy may begin earlier or end later: a quarter of the item, none for items of one shingle."""
    return max(SLACK, n_words // SLACK_PART) if n_words > kernel.SHINGLE else SLACK if n_words == kernel.SHINGLE else 0


def simhashes(h: np.ndarray, widths: list[tuple[int, int]]) -> dict[tuple[int, int], np.ndarray]:
    """Fingerprints of the windows of each (width, stride) at positions 0, stride, 2 * stride, ..."""
    bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1)
    out, sums = {}, {}
    for width, stride in widths:
        if stride not in sums:
            steps = len(h) // stride
            summed = bits[: steps * stride].reshape(steps, stride, 64).sum(1, dtype=np.uint16)
            c = np.zeros((steps + 1, 64), np.uint16)  # differences are right modulo 2**16
            np.cumsum(summed, axis=0, out=c[1:])
            sums[stride] = c
        c, k = sums[stride], width // stride
        most = c[k:] - c[:-k] if len(c) > k else np.zeros((0, 64), np.uint16)
        out[width, stride] = np.packbits(most > width // 2, axis=1).view(np.uint64).ravel()
    return out


@dataclass
class Items:
    """A block of items with its Hamming index."""

    ids: list = field(default_factory=list)
    lengths: list = field(default_factory=list)
    sizes: list = field(default_factory=list)  # shingle size: 5, or the length of a shorter item
    shingles: list = field(default_factory=list)
    weights: list = field(default_factory=list)
    totals: np.ndarray | None = None  # summed weights of each item
    index: dict = field(default_factory=dict)  # (width, stride, radius) -> fingerprints, their items, block tables


def rarity_of(n_items: int, counts: np.ndarray) -> np.ndarray:
    """Weights of shingles that occur in ``counts`` of ``n_items`` items."""
    return np.log1p(n_items / np.maximum(1, counts))


def _near_values(radius: int) -> np.ndarray:
    """Masks that change a block by as many bits as one of the blocks may differ at most."""
    masks = np.zeros(1, np.int64)
    for _ in range(radius // (64 // BLOCK_BITS)):
        masks = np.unique(masks[:, None] | np.concatenate([[0], 1 << np.arange(BLOCK_BITS)])[None])
    return masks


def build_items(rows: list[tuple[object, str | None]], rarity: tuple[np.ndarray, np.ndarray] | None = None) -> Items:
    """The index of a block; ``rarity`` are the weights of shingles by their sorted hashes, by default among the rows."""
    items = Items()
    found: dict[tuple[int, int, int], set[tuple[int, int]]] = {}
    for item_id, text in rows:
        for w in kernel.words(pa.array([text], pa.string())):
            h = w.hashes
            if not len(h):
                continue
            size = min(kernel.SHINGLE, len(h))
            items.ids.append(item_id)
            items.lengths.append(len(h))
            items.sizes.append(size)
            items.shingles.append(np.unique(kernel.rolled(h, size)))
            for width, stride, radius, offset in windows_of(len(h)):
                fp = int(simhashes(h[offset : offset + width].copy(), [(width, 1)])[width, 1][0])
                found.setdefault((width, stride, radius), set()).add((fp, len(items.ids) - 1))
    if rarity is None:
        values, counts = np.unique(np.concatenate(items.shingles or [np.zeros(0, np.uint64)]), return_counts=True)
        rarity = values, rarity_of(len(items.ids), counts)
    items.weights = [rarity[1][np.searchsorted(rarity[0], s)] for s in items.shingles]
    items.totals = np.array([w.sum() for w in items.weights])
    for key, entries in found.items():
        entries = sorted(entries)
        near = _near_values(key[2])
        fp = np.array([e[0] for e in entries], np.uint64)
        tables = []
        for j in range(64 // BLOCK_BITS):
            block = ((fp >> np.uint64(BLOCK_BITS * j)) & np.uint64(0xFFFF)).astype(np.int64)
            value = (block[:, None] ^ near[None]).ravel()
            owner = np.repeat(np.arange(len(fp)), len(near))
            order = np.argsort(value, kind="stable")
            starts = np.searchsorted(value[order], np.arange((1 << BLOCK_BITS) + 1))
            tables.append((starts.astype(np.int32), owner[order].astype(np.int32)))
        items.index[key] = (fp, np.array([e[1] for e in entries]), tables)
    return items


def candidates(fingerprints: np.ndarray, index: tuple, radius: int = RADIUS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Window numbers and entries of all pairs within ``radius``, in slices of about ``PAIRS`` pairs that share a block."""
    fp, _, tables = index
    for j, (starts, owners) in enumerate(tables):
        v = ((fingerprints >> np.uint64(BLOCK_BITS * j)) & np.uint64(0xFFFF)).astype(np.int64)
        lo = starts[v].astype(np.int64)
        n = starts[v + 1] - lo
        hit = np.flatnonzero(n)
        n, lo = n[hit], lo[hit]
        cuts = np.unique(np.searchsorted(np.cumsum(n), np.arange(0, int(n.sum()), PAIRS), side="right"))
        for a, b in pairwise([*cuts, len(hit)]):
            m = n[a:b]
            w = np.repeat(hit[a:b], m)
            e = owners[np.repeat(lo[a:b] - (np.cumsum(m) - m), m) + np.arange(len(w))]
            good = np.bitwise_count(fingerprints[w] ^ fp[e]) <= radius
            yield w[good], e[good]


def near_pairs(w: kernel.Words, items: Items) -> list[tuple[int, int]]:
    """Documents and items of which windows lie within their radius."""
    n = len(items.ids)
    found = np.zeros(0, np.int64)
    prints = simhashes(w.hashes, sorted({key[:2] for key in items.index}))
    for (width, stride, radius), index in items.index.items():
        fps = prints[width, stride]
        position = np.arange(len(fps)) * stride
        doc = np.searchsorted(w.bounds, position, side="right") - 1
        inside = np.flatnonzero(position + width <= w.bounds[doc + 1])
        fps, doc = fps[inside], doc[inside]
        for at, entry in candidates(fps, index, radius):
            found = np.union1d(found, doc[at] * n + index[1][entry])
    return [divmod(x, n) for x in found.tolist()]


def aligned(at: np.ndarray, number: np.ndarray, weights: np.ndarray, span: int) -> float:
    """The largest share of ``weights`` whose shingles ``number`` begin at places ``at`` (sorted) of ``span`` in a row.

    A place tells for the stretches that begin in the ``span`` places up to it, behind the place before of the same shingle.
    """
    order = np.lexsort((at, number))
    a, k = at[order], number[order]
    first = a - span + 1
    same = np.flatnonzero(k[1:] == k[:-1]) + 1
    first[same] = np.maximum(first[same], a[same - 1] + 1)
    places = np.concatenate([first, a + 1])
    change = np.concatenate([weights[k], -weights[k]])
    order = np.argsort(places, kind="stable")
    places, sums = places[order], np.cumsum(change[order])
    last = np.flatnonzero(np.r_[places[1:] != places[:-1], True])
    begin = places[last[np.argmax(sums[last])]]
    inside = np.zeros(len(weights), bool)
    inside[number[(at >= begin) & (at < begin + span)]] = True
    return float(weights[inside].sum() / weights.sum())


def matches(column: pa.Array, items: Items) -> dict[int, dict[int, float]]:
    """For each row with a match: item number to similarity."""
    out: dict[int, dict[int, float]] = {}
    if not items.ids:
        return out
    for w in kernel.words(column):
        now, runs = None, {}
        for doc, item in near_pairs(w, items):
            if doc != now:
                now, runs = doc, {}
            size, own, weights = items.sizes[item], items.shingles[item], items.weights[item]
            if size not in runs:
                h = kernel.rolled(w.hashes[w.bounds[doc] : w.bounds[doc + 1]], size)
                runs[size] = h, np.unique(h)
            h, held = runs[size]
            # what all shingles that occur anywhere weigh bounds the similarity
            there = held[np.minimum(np.searchsorted(held, own), len(held) - 1)] == own
            if weights[there].sum() < ENOUGH * items.totals[item]:
                continue
            number = np.minimum(np.searchsorted(own, h), len(own) - 1)
            at = np.flatnonzero(own[number] == h)
            n = items.lengths[item]
            similarity = aligned(at, number[at], weights, n + 2 * slack_of(n) - size + 1)
            if similarity >= ENOUGH:
                out.setdefault(w.first + doc, {})[item] = similarity
    return out


def with_rarity(benchmark: DataFrame) -> DataFrame:
    """``(item_id, text, h, c)`` for each distinct item with words: its shingles and the number of items that hold each."""
    items = benchmark.select("item_id", F.col("text").cast("string").alias("text")).where("text is not null").distinct().withColumn("row", F.xxhash64("item_id", "text"))

    def run(batches):
        for b in batches:
            for i, (row, text) in enumerate(zip(b.column("row").to_pylist(), b.column("text"), strict=True)):
                for w in kernel.words(pa.array([text.as_py()], pa.string())):
                    if len(w.hashes):
                        h = np.unique(kernel.rolled(w.hashes, min(kernel.SHINGLE, len(w.hashes)))).view(np.int64)
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(h), row)), pa.array(h)], ["row", "h"])

    held = items.select("row", "text").mapInArrow(run, "row long, h long").distinct()
    counts = held.groupBy("h").agg(F.count(F.lit(1)).alias("c"))
    lists = held.join(counts, "h").groupBy("row").agg(F.collect_list(F.struct("h", "c")).alias("held"))  # as long as the item
    return items.join(lists, "row").select("item_id", "text", F.col("held.h").alias("h"), F.col("held.c").alias("c"))


def contamination(docs: DataFrame, benchmark: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``(*keep, contaminated, n_items, item_id, similarity)`` for every row; ``item_id`` is the most similar
    item, the smallest of equally similar ones (null last)."""
    spark = docs.sparkSession
    ranked = stored(with_rarity(benchmark), "items")
    n_items = ranked.count()
    n_blocks = max(1, -(-n_items // ITEM_BLOCK))
    kinds = dict(docs.dtypes)
    name = "text" if "text" in keep else "_text"
    more = [] if name in keep else [name]
    found = {"items": "array<long>", "item_id": "long", "similarity": "double"}
    empty = [F.array().cast("array<long>"), F.lit(None).cast("long"), F.lit(0.0)]
    held = docs.select(*keep, *([F.col("text").cast("string").alias(name)] if more else []), *(c.alias(k) for k, c in zip(found, empty, strict=True)))
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in keep), *(f"{c} string" for c in more), *(f"{k} {v}" for k, v in found.items())])
    for k in range(n_blocks):
        rows = ranked.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n_blocks)) == k).collect()  # about ITEM_BLOCK items
        rows.sort(key=lambda r: (r["item_id"] is None, r["item_id"] or 0, r["text"]))
        h, at = np.unique(np.concatenate([np.zeros(0, np.int64), *(r["h"] for r in rows)]).astype(np.int64).view(np.uint64), return_index=True)
        counts = np.concatenate([np.zeros(0, np.int64), *(r["c"] for r in rows)])[at]
        block = spark.sparkContext.broadcast(build_items([(r["item_id"], r["text"]) for r in rows], (h, rarity_of(n_items, counts))))

        def run(batches, block=block, last=k == n_blocks - 1):
            items = block.value
            for b in batches:
                ids, item, like = (b.column(c).to_pylist() for c in found)
                for row, got in matches(b.column(name), items).items():
                    best = min(got, key=lambda i: (-got[i], items.ids[i] is None, items.ids[i] or 0))
                    ids[row] = [*ids[row], *dict.fromkeys(items.ids[i] for i in got)]
                    smaller = items.ids[best] is not None and (item[row] is None or items.ids[best] < item[row])
                    if got[best] > like[row] or (got[best] == like[row] and smaller):
                        like[row], item[row] = got[best], items.ids[best]
                text = [pa.nulls(b.num_rows, pa.string()) if last else b.column(c) for c in more]
                new = [pa.array(x, kind) for x, kind in zip((ids, item, like), (pa.list_(pa.int64()), pa.int64(), pa.float64()), strict=True)]
                yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), *text, *new], [*keep, *more, *found])

        held = held.mapInArrow(run, schema)
        if (k + 1) % CHAIN == 0 and k + 1 < n_blocks:
            held = stored(held, "decontaminated")
    n = F.size(F.array_distinct("items"))  # distinct ids in whatever blocks their texts were
    return held.select(*keep, (n > 0).alias("contaminated"), n.cast("long").alias("n_items"), "item_id", "similarity")
