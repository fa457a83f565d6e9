"""Toxicity by weak supervision: lexicon and pattern voters, a generative label model, a linear classifier.

1. *Voters.* From a bounded sample of labelled training rows (``LABELLED``), words and word beginnings that are far more
   frequent in toxic texts are mined (by likelihood ratio against chance) and dealt into lexicon voters; pattern voters
   look at capitals, exclamation marks, symbols, repeated words and digits. A voter fires or doesn't.
2. *Label model.* All training rows vote; rows are counted by the pattern of their votes, of which there are at most
   2 ** voters however many rows there are. For a latent label, expectation-maximisation over these counts estimates
   each voter's firing rates (its accuracy) and the covariances of all voters given the label; both make up the log
   odds of the posterior, so voters that repeat each other share one vote. True labels enter by the mined lexicons and
   as the share of toxic rows (the prior), not row by row.
3. *Classifier.* A logistic regression on the mined features is trained on the posterior labels of the sample, and
   scores every whole text.

Edge cases: a null or blank text has no features and gets the intercept's score; if nothing can be mined (no labelled
row, or labels of one kind) every text scores the prior, at most 0.49 unless all labels are toxic; repeated labels of
an id: toxic if any is; equal rows of an id are one row of the sample and repeated rows get equal scores; a null id
counts as the empty text, which is held out; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from llm import kernel
from llm.common import in_fraction, small_batches, stored
from llm.linear import fit_sparse, sigmoid

FOLDS = 5
LABELLED = 20_000
#: Word beginnings in bytes, features kept, least toxic documents of one, least log-likelihood ratio, least share.
BEGINNINGS, KEEP, LEAST, RATIO, SHARE = (3, 4, 5, 6, 7, 8, 9, 10), 2048, 5, 14.0, 0.9
LEXICONS, ROUNDS, RIDGE = 6, 25, 1e-3
#: Features that a task gathers before it counts them.
FLUSH = 1_000_000


def _features(w: kernel.Words) -> list[tuple[np.ndarray, np.ndarray]]:
    """Hashes and word positions of the words and of their beginnings."""
    return [(w.hashes, np.arange(len(w.hashes))), *(w.prefix_hashes(n) for n in BEGINNINGS)]


def _patterns(w: kernel.Words) -> np.ndarray:
    """Shares of capitals, exclamation marks, symbols, digits and repeated words."""
    sums = lambda mask: np.diff(np.concatenate([[0], np.cumsum(mask)])[w.byte_bounds])
    size = np.maximum(1, np.diff(w.byte_bounds))
    n = np.diff(w.bounds)
    again = np.zeros(len(w.hashes) + 1, np.int64)
    if len(w.hashes):
        again[2:] = np.cumsum(w.hashes[1:] == w.hashes[:-1])
    raw = w.raw
    return np.stack(
        [
            sums((raw >= 65) & (raw <= 90)) / size,
            sums(raw == 33) / size,
            sums(np.isin(raw, np.frombuffer(b"#$%&*@|", np.uint8))) / size,
            sums((raw >= 48) & (raw <= 57)) / size,
            np.maximum(0, again[w.bounds[1:]] - again[np.minimum(w.bounds[:-1] + 1, w.bounds[1:])]) / np.maximum(1, n),
        ],
        1,
    )


@dataclass
class Lexicon:
    """Mined feature hashes, sorted, with the lexicon voter of each."""

    hashes: np.ndarray
    voter: np.ndarray

    def hits(self, w: kernel.Words) -> tuple[np.ndarray, np.ndarray]:
        """``(document of the chunk, feature)`` of every hit."""
        docs, feats = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        if len(self.hashes):
            for h, at in _features(w):
                f = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
                ok = self.hashes[f] == h
                feats.append(f[ok])
                docs.append(np.searchsorted(w.bounds, at[ok], side="right") - 1)
        return np.concatenate(docs), np.concatenate(feats)


def mine(labelled: DataFrame) -> Lexicon:
    """Features of toxic texts from ``labelled(text, toxic)``, a bounded sample."""

    def run(batches):
        def counted(found):
            h, y = np.concatenate([x for x, _ in found]), np.concatenate([x for _, x in found])
            u, at = np.unique(h, return_inverse=True)
            return pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(np.bincount(at, y, len(u)).astype(np.int64)), pa.array(np.bincount(at, 1 - y, len(u)).astype(np.int64))], ["h", "a", "b"])

        for b in batches:
            toxic = b.column("toxic").to_numpy(zero_copy_only=False)
            found, held = [], 0
            for w in kernel.words(b.column("text")):
                doc = w.doc_of_word()
                for h, at in _features(w):
                    d, order = doc[at], np.lexsort((h, doc[at]))
                    h, d = h[order], d[order]
                    first = np.r_[True, (h[1:] != h[:-1]) | (d[1:] != d[:-1])] if len(h) else np.zeros(0, bool)
                    found.append((h[first], toxic[w.first + d[first]]))
                    held += int(first.sum())
                if held > FLUSH:
                    yield counted(found)
                    found, held = [], 0
            if found:
                yield counted(found)

    total = labelled.agg(F.sum("toxic").alias("t"), F.count(F.lit(1)).alias("n")).first()
    share = (total["t"] or 0) / max(1, total["n"])
    if not 0 < share < 1:
        return Lexicon(np.zeros(0, np.uint64), np.zeros(0, np.int64))
    counts = labelled.select("text", "toxic").mapInArrow(run, "h long, a long, b long").groupBy("h").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    n = F.col("a") + F.col("b")
    other = F.when(F.col("b") > 0, F.col("b") * F.log(F.col("b") / (n * (1 - share)))).otherwise(0.0)
    counts = counts.where(F.col("a") >= LEAST).withColumn("ratio", F.col("a") * F.log(F.col("a") / (n * share)) + other)
    best = counts.where((F.col("ratio") >= RATIO) & (F.col("a") >= SHARE * n)).orderBy(F.desc("ratio"), "h").limit(KEEP).select("h").toArrow()
    h = np.sort(best.column("h").to_numpy().view(np.uint64))
    return Lexicon(h, (kernel.mix(h) % np.uint64(LEXICONS)).astype(np.int64))


#: Pattern thresholds of the pattern voters, in the order of ``_patterns`` (shares of bytes or words).
PATTERN_LIMITS = (0.2, 0.02, 0.03, 0.05, 0.1)


#: Lexicon voters, the same at more hits, pattern voters.
N_VOTERS = 2 * LEXICONS + len(PATTERN_LIMITS)


def votes(lexicon: Lexicon, w: kernel.Words) -> np.ndarray:
    """Firing voters of each document: lexicons at one hit, the same lexicons at three, patterns at their limits."""
    doc, feat = lexicon.hits(w)
    count = np.bincount(doc * LEXICONS + lexicon.voter[feat], minlength=w.n_docs * LEXICONS).reshape(w.n_docs, LEXICONS)
    return np.concatenate([count >= 1, count >= 3, _patterns(w) > np.array(PATTERN_LIMITS)], 1)


def label_model(v: np.ndarray, prior: float, rounds: int = ROUNDS, count: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Posterior labels, firing rates (2 x voters) and weights of the voters from votes (rows x voters, ``count`` times).

    A voter's weight is its coefficient in the log odds against the one it would have if it were correlated with none.
    """
    v = v.astype(float)
    n = np.ones(len(v)) if count is None else count.astype(float)
    p = np.where(v[:, : 2 * LEXICONS].sum(1) > 0, 0.9, 0.02) if len(v) else np.zeros(0)
    weight, rates = np.ones(v.shape[1]), np.full((2, v.shape[1]), 0.5)
    for _ in range(rounds):
        no, yes = n * (1 - p), n * p
        rates = np.stack([(no @ v + 0.5) / (no.sum() + 1), (yes @ v + 0.5) / (yes.sum() + 1)])
        # covariance of what the label leaves unexplained, shared by both labels
        left = [v - r for r in rates]
        within = sum((x * w[:, None]).T @ x for x, w in zip(left, (no, yes), strict=True)) / max(1.0, n.sum())
        within[np.diag_indices_from(within)] += RIDGE
        apart = rates[1] - rates[0]
        slope = np.linalg.solve(within, apart)
        slope[: 2 * LEXICONS] = np.maximum(0, slope[: 2 * LEXICONS])  # a lexicon's hit never speaks against the label
        weight = slope / np.where(apart == 0, 1, apart / np.diag(within))
        p = sigmoid(np.log(prior / (1 - prior)) + (v - rates.mean(0)) @ slope)
    return p, rates, weight


@dataclass
class Model:
    lexicon: Lexicon
    weights: np.ndarray
    intercept: float

    def score(self, w: kernel.Words) -> np.ndarray:
        doc, feat = self.lexicon.hits(w)
        hit = np.unique(doc * max(1, len(self.lexicon.hashes)) + feat)
        doc, feat = np.divmod(hit, max(1, len(self.lexicon.hashes)))
        z = np.bincount(doc, self.weights[feat], w.n_docs) if len(hit) else np.zeros(w.n_docs)
        return sigmoid(z + self.intercept)


def patterns(docs: DataFrame, lexicon: Lexicon) -> tuple[np.ndarray, np.ndarray]:
    """Votes (patterns x voters) of all rows of ``docs(text)`` and the rows that vote so, counted in the tasks."""
    shared = docs.sparkSession.sparkContext.broadcast(lexicon)  # at most KEEP features
    bits = 1 << np.arange(N_VOTERS)

    def run(batches):
        counts = np.zeros(1 << N_VOTERS, np.int64)
        for b in batches:
            for w in kernel.words(b.column("text")):
                np.add.at(counts, votes(shared.value, w) @ bits, 1)
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(counts[at])], ["pattern", "n"])

    found = docs.select("text").mapInArrow(run, "pattern long, n long").groupBy("pattern").agg(F.sum("n").alias("n")).toArrow()  # at most 2 ** N_VOTERS
    shared.destroy()
    at, n = (found.column(c).to_numpy() for c in ("pattern", "n"))
    order = np.argsort(at)
    return (at[order, None] >> np.arange(N_VOTERS)) & 1, n[order]


def train(docs: DataFrame, labels: DataFrame) -> Model:
    """Model from ``docs(doc_id, text)`` and ``labels(doc_id, toxic)``, which holds training rows only."""
    with small_batches(docs.sparkSession):
        return _train(docs, labels)


def _train(docs: DataFrame, labels: DataFrame) -> Model:
    docs = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    truth = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    drawn = in_fraction(F.col("doc_id"), 1.25 * LABELLED / max(1, truth.count()))
    # equal rows of an id are one; a bound in rows however often an id is repeated
    known = docs.where(drawn).join(truth.where(drawn), "doc_id").withColumn("row", F.xxhash64("doc_id", "text")).dropDuplicates(["row"])
    labelled = stored(known.orderBy("row").limit(LABELLED), "labelled")
    lexicon = mine(labelled)
    total = labelled.agg(F.sum("toxic"), F.count(F.lit(1))).first()
    bad, n = total[0] or 0, total[1]
    share = float((bad + 0.5) / (n + 1)) if n else 0.1
    n_lex = len(lexicon.hashes)
    if not n_lex:
        b = np.log(share / (1 - share)) if 0 < bad == n else min(np.log(share / (1 - share)), -0.04)
        return Model(lexicon, np.zeros(0), float(b))
    seen, count = patterns(docs, lexicon)
    p, _, _ = label_model(seen, share, count=count)
    posterior = np.full(1 << N_VOTERS, share)
    posterior[seen @ (1 << np.arange(N_VOTERS))] = p

    def run(batches):
        for b in batches:
            for w in kernel.words(b.column("text")):
                doc, feat = lexicon.hits(w)
                hit = np.unique(doc * n_lex + feat)
                doc, feat = np.divmod(hit, n_lex)
                lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(doc, np.arange(w.n_docs + 1)), pa.int32()), pa.array(feat, pa.int64()))
                soft = pa.array(posterior[votes(lexicon, w) @ (1 << np.arange(N_VOTERS))])
                yield pa.RecordBatch.from_arrays([b.column("row").slice(w.first, w.n_docs), soft, lists], ["row", "soft", "feats"])

    t = labelled.select("row", "text").mapInArrow(run, "row long, soft double, feats array<long>").orderBy("row").toArrow()  # at most LABELLED
    feats = t.column("feats").combine_chunks()
    rows = np.repeat(np.arange(len(t)), feats.value_lengths().to_numpy())
    w, b = fit_sparse(rows, feats.flatten().to_numpy(), np.ones(len(rows)), t.column("soft").to_numpy(), np.ones(len(t)), n_lex, l2=1e-4, rounds=200)
    return Model(lexicon, w, b)


def score(docs: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``(*keep, score)`` for every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # at most KEEP features
    kinds = dict(docs.dtypes)

    def run(batches):
        model = shared.value
        for b in batches:
            parts = [model.score(w) for w in kernel.words(b.column(name))]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array(np.concatenate(parts or [np.zeros(0)]))], [*keep, "score"])

    name = "text" if "text" in keep else "_text"
    d = docs.select(*keep, *([] if name in keep else [F.col("text").alias(name)]))
    return d.mapInArrow(run, ", ".join([*(f"`{c}` {kinds[c]}" for c in keep), "score double"]))


def fold() -> Column:
    """True for held-out ids."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % FOLDS == 0
