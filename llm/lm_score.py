"""Language-model scores of whole documents beside an exact add-0.1 unigram base.

*Counts.* The ``HEAD`` most frequent words of all training documents get exact counts from per-task
histograms over all documents. All other words travel once, as packed (word, document, count) triples, to the bucket of
their hash, which knows every count of its words and returns one partial sum for each document.
*Model.* A gated recurrent network (``gru``) over the ``SHORT`` most frequent words, one id for all other words and the
end token starts from random weights and the words' frequencies and learns from every training document once, in
``ROUNDS`` rounds over disjoint shares of the rows: each task runs truncated backpropagation over its partition from the
broadcast parameters, and the parameters are averaged, weighted by tokens. At most ``LEARNERS`` tasks learn side by side, so
what they send is bounded. Texts of any length are split into streams. So the model, and with it ``score``, depends on how the
table is cut into partitions; ``base_score`` doesn't. A word outside the short list has the probability of
that id times its smoothed share ``(c + 0.1) / Z`` among those words, ``Z = sum (c + 0.1) + 0.1``.

Edge cases: a null or blank text is just the end token; a null id counts as the id with empty text, which is held out;
repeated rows are separate documents; without training documents all counts are 0; other columns are ignored; an
empty table gives no rows.
"""

from __future__ import annotations

import copy
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from llm import kernel
from llm.common import stored
from llm.gru import Gru

FOLDS = 10
HEAD, SHORT = 131_072, 1023
#: Rounds over all training documents, tasks in one, parallel streams and tokens held in a task, partial sums of the parameters.
ROUNDS, LEARNERS, STREAMS, TASK_TOKENS, SUMS, RATE = 4, 4096, 256, 1 << 19, 32, 1.6e-2
FLUSH, BUCKET_WORDS = 1_000_000, 4_000_000
#: Tokens that a task scores side by side, about.
SCORED_TOKENS = 1 << 22
#: Head words of a slice of a task's histogram, and the least number of groups of tasks whose slices are added up first.
SLICE, LEAST_PARTS = 16_384, 512
LOG10 = np.log(10)
#: Leading bits of a hash by which head words are looked up.
SLOT_BITS = 20


class _Head:
    """Positions of head words by hash."""

    def __init__(self, hashes: np.ndarray) -> None:
        self.hashes = hashes  # sorted
        self.slots: np.ndarray | None = None

    def __getstate__(self) -> dict:
        return {"hashes": self.hashes, "slots": None}  # each process makes its own

    def find(self, h: np.ndarray) -> np.ndarray:
        """Position of each hash, or the number of head words if it isn't one.

        A slot of leading bits holds the position of its only head word; where several share one, it is searched for.
        """
        n = len(self.hashes)
        if not n:
            return np.zeros(len(h), np.int64)
        if self.slots is None:
            own = (self.hashes >> np.uint64(64 - SLOT_BITS)).astype(np.int64)
            self.slots = np.full(1 << SLOT_BITS, n)
            self.slots[own] = np.arange(n)
            self.slots[own[1:][own[1:] == own[:-1]]] = n + 1
        at = self.slots.take((h >> np.uint64(64 - SLOT_BITS)).astype(np.int64), mode="clip")
        shared = np.flatnonzero(at > n)
        at[shared] = np.searchsorted(self.hashes, h[shared])
        return np.where(self.hashes.take(at, mode="clip") == h, at, n)


def _prepared(docs: DataFrame) -> DataFrame:
    """``doc_id, text, train, row``; ``row`` names a text of an id."""
    d = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    fold = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % FOLDS
    return d.withColumn("train", fold != 0).withColumn("row", F.xxhash64("doc_id", "text"))


def head_words(d: DataFrame) -> np.ndarray:
    """Hashes of the most frequent words of all training documents, most frequent first."""

    def run(batches):
        def counted(parts):
            h, c = np.unique(np.concatenate(parts), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(c.astype(np.int64))], ["h", "c"])

        parts, held = [], 0
        for b in batches:
            for w in kernel.words(b.column("text")):
                parts.append(w.hashes)
                held += len(w.hashes)
                if held > FLUSH:
                    yield counted(parts)
                    parts, held = [], 0
        if parts:
            yield counted(parts)

    top = d.where("train").select("text").mapInArrow(run, "h long, c long").groupBy("h").agg(F.sum("c").alias("c")).orderBy(F.desc("c"), "h").limit(HEAD)
    return top.select("h").toArrow().column("h").to_numpy().view(np.uint64)


def _counts(d: DataFrame, head: _Head, n_docs: int):
    """Exact head counts, totals, and the rare words' part of every document as a stored table."""
    n_buckets = int(max(8, n_docs * 60 // BUCKET_WORDS + 1))
    shared = d.sparkSession.sparkContext.broadcast(head)  # at most HEAD numbers
    n_head = len(head.hashes)
    n_slices = -(-(n_head + 1) // SLICE)
    n_parts = max(LEAST_PARTS, isqrt(d.rdd.getNumPartitions()))  # as many tasks in a group as there are groups, at most

    def send(batches):
        head = shared.value
        counts = np.zeros(n_head + 1, np.int64)  # the last: all other words
        n_train = 0
        held: list[tuple[np.ndarray, ...]] = []
        size = 0

        def flush():
            h, row, c, train = (np.concatenate(x) for x in zip(*held, strict=True))
            bucket = ((h >> np.uint64(32)) * np.uint64(n_buckets)) >> np.uint64(32)
            order = np.argsort(bucket, kind="stable")
            cuts = np.searchsorted(bucket[order], np.arange(n_buckets + 1))
            for j in range(n_buckets):
                at = order[cuts[j] : cuts[j + 1]]
                if len(at):
                    yield j, h[at].tobytes(), row[at].tobytes(), np.where(train[at], c[at], -c[at]).astype(np.int32).tobytes()

        def batch(rows):
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), *(pa.array([r[k] for r in rows], pa.binary()) for k in (1, 2, 3))], ["bucket", "h", "row", "c"])

        for b in batches:
            rows, train = b.column("row").to_numpy(), b.column("train").to_numpy(zero_copy_only=False)
            n_train += int(train.sum())
            for w in kernel.words(b.column("text")):
                doc = w.first + w.doc_of_word()
                at = head.find(w.hashes)
                counts += np.bincount(at[train[doc]], minlength=n_head + 1)
                rare = np.flatnonzero(at == n_head)
                if not len(rare):
                    continue
                order = rare[np.lexsort((w.hashes[rare], doc[rare]))]
                h, r = w.hashes[order], doc[order]
                first = np.flatnonzero(np.r_[True, (h[1:] != h[:-1]) | (r[1:] != r[:-1])])
                held.append((h[first], rows[r[first]], np.diff(np.r_[first, len(h)]), train[r[first]]))
                size += len(first)
                if size >= FLUSH:
                    for r in flush():
                        yield batch([r])
                    held, size = [], 0
        if held:
            for r in flush():
                yield batch([r])
        part = TaskContext.get().partitionId() % n_parts
        for k, a in enumerate(range(0, n_head + 1, SLICE)):
            yield batch([(-1 - k * n_parts - part, counts[a : a + SLICE].tobytes(), b"", b"")])
        yield batch([(-1 - n_slices * n_parts - part, np.array([n_train], np.int64).tobytes(), b"", b"")])

    def meet(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
        get = lambda name, kind: [np.frombuffer(x.as_buffer(), kind) for x in t.column(name)]
        if key[0].as_py() < 0:
            total = np.sum(get("h", np.int64), axis=0)
            return pa.table({"kind": pa.array([key[0].as_py()], pa.int32()), "row": pa.array([0], pa.int64()), "log": pa.array([0.0]), "known": pa.array([0], pa.int64()), "blob": pa.array([total.tobytes()], pa.binary())})
        h, row, c = (np.concatenate(get(*x)) for x in (("h", np.uint64), ("row", np.int64), ("c", np.int32)))
        _, word = np.unique(h, return_inverse=True)
        count = np.bincount(word, np.maximum(c, 0))
        n, known = np.abs(c), count[word] > 0
        rows, inverse = np.unique(row, return_inverse=True)
        log = np.bincount(inverse, n * np.log10(count[word] + 0.1))
        got = np.bincount(inverse, n * known).astype(np.int64)
        kinds = np.zeros(len(rows) + 1, np.int32)
        kinds[-1] = 1  # the number of words that occur in training texts
        blobs = pa.nulls(len(rows) + 1, pa.binary())
        return pa.table({"kind": kinds, "row": np.append(rows, 0), "log": np.append(log, 0.0), "known": np.append(got, int((count > 0).sum())), "blob": blobs})

    out = stored(
        d.select("row", "text", "train").mapInArrow(send, "bucket int, h binary, row binary, c binary").groupBy("bucket").applyInArrow(meet, "kind int, row long, log double, known long, blob binary"),
        "counts",
    )

    def add(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
        total = np.sum([np.frombuffer(x.as_buffer(), np.int64) for x in t.column("blob")], axis=0)
        return pa.table({"slice": pa.array([key[0].as_py()], pa.int32()), "blob": pa.array([total.tobytes()], pa.binary())})

    counts = np.zeros(n_head + 1, np.int64)
    n_train = 0
    slices = out.where("kind < 0").select(F.floor((-1 - F.col("kind")) / n_parts).cast("int").alias("slice"), "blob").groupBy("slice").applyInArrow(add, "slice int, blob binary")
    for r in slices.collect():  # one row for each slice of the head
        part = np.frombuffer(r["blob"], np.int64)
        if r["slice"] == n_slices:
            n_train = int(part[0])
        else:
            counts[r["slice"] * SLICE :][: len(part)] = part
    shared.destroy()
    rare_words = out.where("kind = 1").agg(F.sum("known")).first()[0] or 0
    tail = out.where("kind = 0").groupBy("row").agg(F.sum("log").alias("log"), F.sum("known").alias("known"))
    return counts[:n_head], int(counts[n_head]), n_train, int(rare_words), tail


def _averaged(d: DataFrame, model: Gru, head: _Head, ids: np.ndarray, rate: float) -> int:
    """Parameters averaged over tasks that each learn from all texts of their partition; returns the tokens learnt from."""
    shared = d.sparkSession.sparkContext.broadcast((model, head, ids))  # bounded by HEAD
    row = lambda n, v: pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([v.tobytes()], pa.binary())], ["n", "sum"])

    def learn(batches):
        start, head, ids = shared.value
        own = copy.deepcopy(start)
        held, size, n = [], 0, 0
        for b in batches:
            for w in kernel.words(b.column("text")):
                tokens = np.insert(ids[head.find(w.hashes)], w.bounds[1:], own.size - 1).astype(np.int32)  # each text's end
                for a in range(0, len(tokens), TASK_TOKENS):
                    held.append(tokens[a : a + TASK_TOKENS])
                    size += len(held[-1])
                    if size >= TASK_TOKENS:
                        own.learn(np.concatenate(held), STREAMS, rate)
                        held, size, n = [], 0, n + size
        if held:
            own.learn(np.concatenate(held), STREAMS, rate)
        if n + size:
            yield row(n + size, own.vector() * np.float64(n + size))

    def add(batches):
        n, total = 0, 0.0
        for b in batches:
            for k, v in zip(b.column("n").to_pylist(), b.column("sum"), strict=True):
                n, total = n + k, total + np.frombuffer(v.as_buffer(), np.float64)
        if n:
            yield row(n, total)

    sums = d.select("text").coalesce(LEARNERS).mapInArrow(learn, "n long, sum binary").repartition(SUMS).mapInArrow(add, "n long, sum binary")
    n, total = 0, 0.0
    for r in sums.collect():  # at most SUMS vectors of parameters
        n, total = n + r["n"], total + np.frombuffer(r["sum"], np.float64)
    if n:
        model.load(total / n)
    shared.destroy()
    return n


def learn_all(d: DataFrame, model: Gru, head: _Head, ids: np.ndarray) -> int:
    """Lets the network learn from every training document once; returns the tokens learnt from."""
    share = F.pmod(F.xxhash64(F.lit("round"), "row"), F.lit(ROUNDS))
    return sum(_averaged(d.where(F.col("train") & (share == k)), model, head, ids, RATE * (1 - k / ROUNDS)) for k in range(ROUNDS))


def scores(docs: DataFrame) -> DataFrame:
    """The columns of ``op9`` in ``queries`` for every row of ``docs``."""
    d = _prepared(docs)
    n_docs = docs.count()
    by_rank = head_words(d)
    order = np.argsort(by_rank)
    head = _Head(by_rank[order])
    counts, rare_tokens, n_train, rare_words, tail = _counts(d, head, n_docs)
    n_short = min(SHORT, len(by_rank))
    rank = np.empty(len(order), np.int64)
    rank[np.arange(len(order))] = order  # position in the sorted head -> rank
    unknown, end = n_short, n_short + 1
    ids = np.append(np.minimum(rank, unknown), unknown)
    listed = ids[:-1] < unknown
    total = int(counts.sum()) + rare_tokens + n_train
    distinct = int((counts > 0).sum()) + rare_words + int(n_train > 0)
    rest_mass = float(counts[~listed].sum() + rare_tokens + 0.1 * (int((counts[~listed] > 0).sum()) + rare_words) + 0.1)
    freq = np.bincount(ids[:-1], counts, end + 1)
    freq[unknown] += rare_tokens
    freq[end] = n_train
    model = Gru(freq)
    learn_all(d, model, head, ids)
    logs = np.append(np.log10(counts + 0.1), 0.0)
    known = np.append(counts > 0, False)
    norm = float(np.log10(total + 0.1 * (distinct + 1)))
    end_log = float(np.log10(n_train + 0.1))
    log_rest = float(np.log10(rest_mass))
    shared = d.sparkSession.sparkContext.broadcast((model, head, ids, logs, known, np.append(listed, False)))  # bounded by HEAD

    def run(batches):
        model, head, ids, logs, known, listed = shared.value

        def scored(held):
            """All texts held are scored side by side, so that few long ones among them cost few steps of their own."""
            sizes = [np.diff(h["bounds"]) for h in held]
            lm = model.score(np.concatenate([h["tokens"] for h in held]), np.concatenate([[0], np.cumsum(np.concatenate(sizes))])) / LOG10
            first = 0
            for h, n in zip(held, sizes, strict=True):
                part = lm[first : first + len(n)]
                first += len(n)
                yield pa.RecordBatch.from_arrays(
                    [*h["names"], pa.array(n), pa.array(h["base"]), pa.array(h["got"]), pa.array(part + h["rest"]), pa.array(h["unlisted"])],
                    ["doc_id", "train", "row", "n_tokens", "base", "known", "lm", "unlisted"],
                )

        held, size = [], 0
        for b in batches:
            n = b.num_rows
            base, got, rest, unlisted = np.zeros(n), np.zeros(n, np.int64), np.zeros(n), np.zeros(n, np.int64)
            parts, bounds = [np.zeros(0, np.int32)], [0]
            for w in kernel.words(b.column("text")):
                at = head.find(w.hashes)
                doc = w.doc_of_word()
                s = slice(w.first, w.first + w.n_docs)
                base[s] = np.bincount(doc, logs[at], w.n_docs)
                got[s] = np.bincount(doc, known[at], w.n_docs)
                rest[s] = np.bincount(doc, np.where(listed[at], 0.0, logs[at]), w.n_docs)
                unlisted[s] = np.bincount(doc, ~listed[at], w.n_docs)
                parts.append(np.insert(ids[at], w.bounds[1:], model.size - 1).astype(np.int32))  # each text's end
                bounds += (bounds[-1] + np.cumsum(np.diff(w.bounds) + 1)).tolist()
            held.append({"names": [b.column(c) for c in ("doc_id", "train", "row")], "tokens": np.concatenate(parts), "bounds": np.array(bounds), "base": base, "got": got, "rest": rest, "unlisted": unlisted})
            size += bounds[-1]
            if size >= SCORED_TOKENS:
                yield from scored(held)
                held, size = [], 0
        if held:
            yield from scored(held)

    kind = dict(d.dtypes)["doc_id"]
    parts = d.select("doc_id", "train", "row", "text").mapInArrow(run, f"doc_id {kind}, train boolean, row long, n_tokens long, base double, known long, lm double, unlisted long")
    parts = stored(parts, "parts")
    copies = parts.groupBy("row").agg(F.count(F.lit(1)).alias("copies")).where("copies > 1")  # equal rows shared one sum
    j = parts.join(tail.withColumnRenamed("known", "rare_known"), "row", "left").join(copies, "row", "left")
    share = F.coalesce("copies", F.lit(1))
    rare_log = F.coalesce(F.col("log") / share, F.lit(0.0))
    rare_known = F.coalesce((F.col("rare_known") / share).cast("long"), F.lit(0))
    return j.select(
        "doc_id",
        (~F.col("train")).alias("held_out"),
        "n_tokens",
        (F.col("known") + rare_known + F.lit(int(n_train > 0))).cast("long").alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        (F.col("base") + rare_log + F.lit(end_log) - F.col("n_tokens") * F.lit(norm)).alias("base_score"),
        (F.col("lm") + rare_log - F.col("unlisted") * F.lit(log_rest)).alias("score"),
    )
