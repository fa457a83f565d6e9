"""Exact Jaccard self-join on word shingles with signature trees.

A document is the set of its distinct 5-word shingles; documents link when 100 * |intersection| >= 75 * |union|.

1. *Sets.* Texts are hashed by ``kernel``; equal sets collapse to one set, known by a 64-bit digest and its size.
2. *Meeting places.* Shingles are put in one global order, frequent ones (estimated on a bounded sample; the order
   only affects cost) last.  Linked sets A, B share at least ``ceil(0.75 |A|)`` shingles, so among the first
   ``|A| - ceil(0.75 |A|) + 1 + s`` shingles of A at least ``1 + s`` also occur in the same part of B (with
   ``s = |A| div 8``, cut back to what the smallest partner of A guarantees).  A set of which fewer are shared cannot
   link and leaves. Of the sets that stay, all shingles are compared: one shares ``ceil(0.75 |A|)`` of them with others or
   leaves. These are put in the order of their exact number of sets, and linked sets meet at one of the rarest
   ``|A| - ceil(0.75 |A|) + 1`` of both; passages that many sets hold come last there, so they connect sets that consist
   of them only. The sets are joined to the smallest one at each such shingle, and connected components of these stars hold
   every possible link.
3. *Signature trees.* Inside a component sets are sorted by size into leaves; every node holds the OR of its sets'
   token bitmaps and its size range.  A dual traversal drops a node pair when the largest possible overlap is below
   the smallest overlap a link needs, leaf pairs are verified exactly, and pairs that are already connected are
   skipped.  A component of more than ``BLOCK`` sets or ``BLOCK_BYTES`` is cut into classes of size (links stay within
   a class or between neighbours) and these into blocks, and pairs of blocks are dealt to many tasks.

Hashes have 64 bits.  Only sets of components travel; no task or driver holds an unbounded group.

Edge cases: null or blank texts have no shingle, link with nothing and are their own component; a text of fewer than
five words is one shingle; repeated rows and equal texts share a component; a null ``doc_id`` gets a null component
unless its set also belongs to a known id; other columns of the input are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from llm import kernel
from llm.common import components, in_fraction, small_batches, stored

THRESHOLD = 75
#: Documents sampled to find frequent shingles, the count in the sample that makes one frequent, and how many are kept.
SAMPLE_DOCS, SAMPLE_MIN, SAMPLE_KEEP = 16_384, 2, 200_000
#: Keys a task gathers before it sends them on, keys of a bucket, sets and bytes of a block.
FLUSH, BUCKET_KEYS, BLOCK, BLOCK_BYTES = 500_000, 1_000_000, 2048, 12 << 20
#: Sets that share one key within a flush from which on they are joined where they are.
HOT = 256


def _needed(n: np.ndarray | int) -> np.ndarray | int:
    return -(-THRESHOLD * n // 100)


def _digest(s: np.ndarray) -> int:
    with np.errstate(over="ignore"):
        h = kernel.mix(np.add.reduce(kernel.mix(s ^ np.uint64(0x1234567)), keepdims=True) + np.uint64(len(s)))
    return int(h.view(np.int64)[0])


def _sets(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray]]:
    """Row number and sorted distinct shingles of every text of a batch."""
    for w in kernel.words(batch.column("text")):
        s, bounds = kernel.shingles(w)
        for i in range(w.n_docs):
            yield w.first + i, np.unique(s[bounds[i] : bounds[i + 1]])


def shingle_sets(docs: DataFrame) -> DataFrame:
    """``(doc_id, n_shingles, digest)``; digest is null for an empty set."""

    def run(batches):
        for b in batches:
            sizes, digests = np.zeros(b.num_rows, np.int64), np.zeros(b.num_rows, np.int64)
            for i, s in _sets(b):
                sizes[i], digests[i] = len(s), _digest(s) if len(s) else 0
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id").cast(pa.int64()), pa.array(sizes), pa.array(digests, mask=sizes == 0)],
                ["doc_id", "n_shingles", "digest"],
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, n_shingles long, digest long")


def frequent_shingles(docs: DataFrame, n_docs: int) -> np.ndarray:
    """Shingles that are frequent in a bounded sample of documents, sorted; they come last in the global order."""

    def run(batches):
        def counted(parts):
            h, c = np.unique(np.concatenate(parts), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(c.astype(np.int64))], ["h", "c"])

        parts, held = [], 0
        for b in batches:
            for _, s in _sets(b):
                parts.append(s)
                held += len(s)
                if held > FLUSH:
                    yield counted(parts)
                    parts, held = [], 0
        if parts:
            yield counted(parts)

    picked = docs.where(in_fraction(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), SAMPLE_DOCS / max(1, n_docs)))
    rows = (
        picked.select(F.col("text").cast("string").alias("text"))
        .mapInArrow(run, "h long, c long")
        .groupBy("h")
        .agg(F.sum("c").alias("c"))
        .where(F.col("c") >= SAMPLE_MIN)
        .orderBy(F.desc("c"), "h")
        .limit(SAMPLE_KEEP)
        .select("h")
        .toPandas()
    )
    return np.sort(rows["h"].to_numpy(np.int64).view(np.uint64))


def _prefix(s: np.ndarray, frequent: np.ndarray) -> np.ndarray:
    """The first part of a set in the global order, long enough for ``_guaranteed`` shared shingles."""
    if len(frequent):
        at = np.minimum(np.searchsorted(frequent, s), len(frequent) - 1)
        common = frequent[at] == s
        s = np.concatenate([s[~common], s[common]])
    n = len(s)
    return s[: n - int(_needed(n)) + 1 + n // 8]


def _guaranteed(n: Column) -> Column:
    """Shingles of the prefix of a set of ``n`` that any partner's prefix also holds.

    The partner B of A shares o >= needed(max(|A|, |B|)) shingles and o >= 3/7 (|A| + |B|).  The first |A| - o + 1 + s
    of A hold 1 + s shared ones; these are, in the common order, the first 1 + s shared ones of B too, so B's prefix
    holds min(1 + s_A, 1 + s_B) of them, and |B| >= 0.75 |A|.
    """
    return F.floor(F.ceil(n * (THRESHOLD / 100)) / 8) + 1


def _least_overlap(n: Column) -> Column:
    """Shingles that a set of ``n`` shares with any partner, as ``_needed`` has it."""
    return F.ceil(n * (THRESHOLD / 100))


def _shared_keys(docs: DataFrame, n_keys: int, heavy: Broadcast | None) -> DataFrame:
    """``(digest, key)`` for every shingle in the prefixes of two or more different sets; ``heavy`` are frequent shingles. Without
    ``heavy``: for every shingle in two or more different sets."""
    n_buckets = int(max(8, n_keys // BUCKET_KEYS + 1))
    shift = np.uint64(32)

    def send(batches):
        keys, owners, held = [], [], 0

        def flush():
            k, d = np.concatenate(keys), np.concatenate(owners)
            order = np.lexsort((d, k))
            k, d = k[order], d[order]
            keep = np.ones(len(k), bool)
            keep[1:] = (k[1:] != k[:-1]) | (d[1:] != d[:-1])
            k, d = k[keep], d[keep]
            first = np.flatnonzero(np.r_[True, k[1:] != k[:-1]])
            length = np.diff(np.r_[first, len(k)])
            hot = np.repeat(length >= HOT, length)
            out = []
            if hot.any():  # joined here; only the first set of each hot key travels on
                out.append((int(d[0] % np.uint64(n_buckets)), True, k[hot], d[hot]))
                hot[first] = False
                k, d = k[~hot], d[~hot]
            bucket = ((k >> shift) * np.uint64(n_buckets)) >> shift
            cuts = np.searchsorted(bucket, np.arange(n_buckets + 1))
            out += [(j, False, k[a:b], d[a:b]) for j, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)) if b > a]
            for j in range(0, len(out), 64):
                part = out[j : j + 64]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([x[0] for x in part], pa.int32()), pa.array([x[1] for x in part], pa.bool_()), pa.array([x[2].tobytes() for x in part], pa.binary()), pa.array([x[3].tobytes() for x in part], pa.binary())],
                    ["bucket", "joined", "keys", "owners"],
                )

        for b in batches:
            for _, s in _sets(b):
                if not len(s):
                    continue
                p = s if heavy is None else _prefix(s, heavy.value)
                keys.append(p)
                owners.append(np.full(len(p), np.array(_digest(s), np.int64).view(np.uint64), np.uint64))
                held += len(p)
                if held >= FLUSH:
                    yield from flush()
                    keys, owners, held = [], [], 0
        if held:
            yield from flush()

    def meet(t: pa.Table) -> pa.Table:
        joined = t.column("joined").to_pylist()
        ks = [np.frombuffer(x.as_buffer(), np.uint64) for x in t.column("keys")]
        ds = [np.frombuffer(x.as_buffer(), np.uint64) for x in t.column("owners")]
        k = np.concatenate([x for x, j in zip(ks, joined, strict=True) if not j] or [np.zeros(0, np.uint64)])
        d = np.concatenate([x for x, j in zip(ds, joined, strict=True) if not j] or [np.zeros(0, np.uint64)])
        order = np.lexsort((d, k))
        k, d = k[order], d[order]
        fresh = np.ones(len(k), bool)
        fresh[1:] = (k[1:] != k[:-1]) | (d[1:] != d[:-1])
        k, d = k[fresh], d[fresh]
        first = np.flatnonzero(np.r_[True, k[1:] != k[:-1]]) if len(k) else np.zeros(0, np.int64)
        length = np.diff(np.r_[first, len(k)])
        several = np.repeat(length > 1, length)
        k = np.concatenate([k[several], *[x for x, j in zip(ks, joined, strict=True) if j]])
        d = np.concatenate([d[several], *[x for x, j in zip(ds, joined, strict=True) if j]])
        return pa.table({"digest": d.view(np.int64), "key": k.view(np.int64)})

    return (
        docs.select(F.col("text").cast("string").alias("text"))
        .mapInArrow(send, "bucket int, joined boolean, keys binary, owners binary")
        .groupBy("bucket")
        .applyInArrow(meet, "digest long, key long")
    )


def tree_links(ids: list[int], sets: list[np.ndarray], side: list[int] | None = None) -> list[tuple[int, int]]:
    """Links that connect everything that links connect among ``sets``, found by a dual traversal of a signature tree.

    With ``side``, only pairs of different sides are compared (the two blocks of a block pair).
    """
    n = np.array([len(s) for s in sets])
    order = np.argsort(n, kind="stable")
    width = 1 << max(6, min(15, int(4 * np.median(n)).bit_length()))
    maps = np.zeros((len(sets), width // 64), np.uint64)
    for row, i in enumerate(order):
        at = (sets[i] >> np.uint64(40)).astype(np.int64) & (width - 1)
        np.bitwise_or.at(maps[row], at >> 6, np.uint64(1) << (at & 63).astype(np.uint64))
    size = n[order]
    extra = size - np.bitwise_count(maps).sum(1)  # shingles beyond one for each bit
    sides = np.array([side[i] for i in order]) if side else None
    # levels[0] are the sets; each node of levels[k] covers 8 nodes of levels[k - 1]
    levels = [(maps, size, size, extra)]
    while len(levels[-1][0]) > 1:
        m, low, high, ex = levels[-1]
        at = np.arange(0, len(m), 8)
        levels.append((np.bitwise_or.reduceat(m, at), np.minimum.reduceat(low, at), np.maximum.reduceat(high, at), np.maximum.reduceat(ex, at)))
    parent = np.arange(len(sets))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    found = []
    stack = [(len(levels) - 1, 0, 0)]
    while stack:
        level, x, y = stack.pop()
        m, low, high, ex = levels[level]
        if level == 0:
            if x == y or (sides is not None and sides[x] == sides[y]) or root(x) == root(y):
                continue
            a, b = sets[order[x]], sets[order[y]]
            small, large = (a, b) if len(a) <= len(b) else (b, a)
            at = np.minimum(np.searchsorted(large, small), len(large) - 1)
            both = int(np.count_nonzero(large[at] == small))
            if 100 * both >= THRESHOLD * (len(a) + len(b) - both):
                parent[root(y)] = root(x)
                found.append((ids[order[x]], ids[order[y]]))
            continue
        m, low, high, ex = levels[level - 1]
        xs = np.arange(8 * x, min(8 * x + 8, len(m)))
        ys = np.arange(8 * y, min(8 * y + 8, len(m)))
        overlap = np.bitwise_count(m[xs][:, None] & m[ys][None]).sum(2, dtype=np.int64)
        most = np.minimum(overlap + ex[xs][:, None], overlap + ex[ys][None])
        most = np.minimum(most, np.minimum(high[xs][:, None], high[ys][None]))
        least = low[xs][:, None] + low[ys][None]
        fits = (100 + THRESHOLD) * most >= THRESHOLD * least
        fits &= (100 * high[xs][:, None] >= THRESHOLD * low[ys][None]) & (100 * high[ys][None] >= THRESHOLD * low[xs][:, None])
        stack += [(level - 1, int(xs[i]), int(ys[j])) for i, j in zip(*np.nonzero(fits), strict=True) if x != y or j >= i]
    return found


def _links(docs: DataFrame, sets: DataFrame, reps: DataFrame) -> DataFrame:
    """``(a, b)`` ids of representatives that are linked, enough to connect all that links connect."""
    spark = docs.sparkSession
    totals = sets.agg(F.count(F.lit(1)), F.sum(F.col("n_shingles") * 3 / 8 + 1)).first()
    with small_batches(spark):
        frequent = frequent_shingles(docs, totals[0])
    heavy = spark.sparkContext.broadcast(frequent)  # at most SAMPLE_KEEP numbers
    shared = stored(_shared_keys(docs, int(totals[1] or 0), heavy), "shared").distinct()
    heavy.destroy()
    counts = shared.groupBy("digest").agg(F.count(F.lit(1)).alias("k"))
    viable = stored(
        counts.join(reps, "digest").where(F.col("k") >= _guaranteed(F.col("n_shingles"))).select("digest", "rep", "n_shingles"), "viable"
    )
    docs = stored(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(viable.select(F.col("rep").alias("doc_id")), "doc_id", "left_semi"), "texts")
    n_whole = viable.agg(F.sum("n_shingles")).first()[0]
    whole = stored(_shared_keys(docs, int(n_whole or 0), None).distinct(), "whole")
    near = stored(whole.groupBy("digest").agg(F.count(F.lit(1)).alias("k")).join(viable, "digest").where(F.col("k") >= _least_overlap(F.col("n_shingles"))), "near")
    often = whole.groupBy("key").agg(F.count(F.lit(1)).alias("often"))
    order = F.row_number().over(Window.partitionBy("digest").orderBy("often", "key"))
    first = whole.join(near, "digest").join(often, "key").withColumn("place", order).where(F.col("place") <= F.col("k") - _least_overlap(F.col("n_shingles")) + 1)
    cells = stored(first.select("key", "rep"), "cells")
    stars = cells.groupBy("key").agg(F.min("rep").alias("a"), F.max("rep").alias("z")).where("a < z").select("key", "a")
    groups = stored(components(cells.join(stars, "key").select("a", F.col("rep").alias("b"))), "groups")
    n_groups = max(8, int(spark.conf.get("spark.sql.shuffle.partitions")))
    member = groups.join(near, groups["node"] == near["rep"]).select(F.col("node").alias("doc_id"), "component", "n_shingles")
    # linked sets are in the same or in neighbouring classes of size
    member = member.distinct().withColumn("class", F.floor(F.log("n_shingles") / F.log(F.lit(100 / THRESHOLD))).cast("int"))
    classes = member.groupBy("component", "class").agg(F.count(F.lit(1)).alias("members"), (8 * F.sum("n_shingles")).alias("bytes"))
    whole, near = Window.partitionBy("component"), Window.partitionBy("component").orderBy("class")
    large = (F.sum("members").over(whole) > BLOCK) | (F.sum("bytes").over(whole) > BLOCK_BYTES)
    blocks = F.ceil(F.greatest(F.col("members") / BLOCK, F.col("bytes") / BLOCK_BYTES)).cast("int")
    classes = classes.select("component", "class", large.alias("large"), blocks.alias("blocks"))
    classes = stored(
        classes.withColumn("below", F.when(F.lag("class").over(near) == F.col("class") - 1, F.lag("blocks").over(near)).otherwise(0))
        .withColumn("above", F.when(F.lead("class").over(near) == F.col("class") + 1, F.lead("blocks").over(near)).otherwise(0)),
        "classes",
    )

    def slots(of_class: Column, n: Column) -> Column:
        """Slots of ``n`` blocks of a class."""
        return F.when(n > 0, F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), lambda i: of_class.cast("long") * (1 << 40) + i)).otherwise(F.array().cast("array<bigint>"))

    member = (
        member.join(classes, ["component", "class"])
        .withColumn("slot", F.col("class").cast("long") * (1 << 40) + F.when(F.col("large"), F.pmod(F.xxhash64("doc_id"), F.col("blocks"))).otherwise(0))
        .withColumn(
            "others",
            F.when(F.col("large"), F.concat(slots(F.col("class") - 1, F.col("below")), slots(F.col("class"), F.col("blocks")), slots(F.col("class") + 1, F.col("above")))).otherwise(F.array(F.lit(-1).cast("long"))),
        )
        .select("doc_id", "component", "slot", "others")
    )

    def hashed(batches):
        for b in batches:
            blobs = [s.tobytes() for _, s in _sets(b)]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("doc_id", "component", "slot", "others")), pa.array(blobs, pa.binary())], ["doc_id", "component", "slot", "others", "shingles"])

    one = docs.join(member, "doc_id").mapInArrow(hashed, "doc_id long, component long, slot long, others array<long>, shingles binary")
    dealt = (
        one.withColumn("other", F.explode("others"))
        .withColumn("x", F.least("slot", "other"))
        .withColumn("y", F.greatest("slot", "other"))
        .withColumn("x", F.when(F.col("other") >= 0, F.col("x")).otherwise(-1))
        .withColumn("y", F.when(F.col("other") >= 0, F.col("y")).otherwise(-1))
        .withColumn("part", F.when(F.col("other") < 0, F.pmod(F.xxhash64("component"), F.lit(n_groups))).otherwise(F.xxhash64("component", "x", "y")))
    )

    def join(t: pa.Table) -> pa.Table:
        out = []
        where = {}
        cols = [t.column(c).to_pylist() for c in ("component", "doc_id", "slot", "x", "y")]
        for i, (c, d, slot, x, y) in enumerate(zip(*cols, strict=True)):
            where.setdefault((c, x, y), []).append((d, slot, i))
        blobs = t.column("shingles")
        for (_, x, y), rows in where.items():
            s = [np.frombuffer(blobs[i].as_buffer(), np.uint64) for _, _, i in rows]
            out += tree_links([r[0] for r in rows], s, [r[1] for r in rows] if x != y else None)
        return pa.table({"a": pa.array([a for a, _ in out], pa.int64()), "b": pa.array([b for _, b in out], pa.int64())})

    return dealt.select("part", "component", "doc_id", "slot", "x", "y", "shingles").groupBy("part").applyInArrow(join, "a long, b long")


def jaccard_components(docs: DataFrame) -> DataFrame:
    """``(doc_id, n_shingles, component_id)`` for every row of ``docs(doc_id, text, ...)``."""
    sets = stored(shingle_sets(docs), "sets")
    reps = stored(
        sets.where("digest is not null and doc_id is not null").groupBy("digest", "n_shingles").agg(F.min("doc_id").alias("rep")), "reps"
    )
    linked = components(_links(docs, sets, reps))
    whole = reps.join(linked, reps["rep"] == linked["node"], "left").select("digest", "n_shingles", F.coalesce("component", "rep").alias("component_id"))
    of = stored(whole, "classes")
    filled = sets.where("digest is not null").join(of, ["digest", "n_shingles"], "left").select("doc_id", "n_shingles", "component_id")
    empty = sets.where("digest is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return filled.unionByName(empty)
