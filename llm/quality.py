"""Quality classifier by co-training a text view and a metadata view.

The text view sees shares of character and word kinds, the metadata view hashed source and language and the recorded
length. Both are logistic regressions. In every round each view labels the pool rows that it is most sure of for the
other view. Then each view is calibrated on labelled rows kept aside, and a regression on the two calibrated log odds
scores all documents. Only the labelled rows are a bounded sample (``LABELLED``); the pool is every other document:
tasks score it and keep their surest rows, of which the surest of all tasks are taken.

Edge cases: a null text counts as empty; null source, language or length are values of their own; repeated labels of an
id: good only if all are; any labels of two kinds train the model (where those kept aside are of one kind, all labelled
rows calibrate it); without labels, or with labels of one kind, all documents score 0.5 or that label's side (0.88,
0.12); equal rows are one row of sample and pool, and repeated rows get equal scores; other columns are kept as they
are; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from llm import kernel
from llm.common import in_fraction, small_batches, stored
from llm.linear import fit_dense, sigmoid

LABELLED, ROUNDS, SURE, GAIN = 6000, 5, 0.95, 300
#: Tasks that bring together the surest rows of all tasks.
MERGES = 32
BUCKETS = 32
TEXT_FEATURES = 16


def text_features(w: kernel.Words) -> np.ndarray:
    sums = lambda mask: np.diff(np.concatenate([[0], np.cumsum(mask)])[w.byte_bounds])
    raw, h = w.raw, w.hashes
    size = np.diff(w.byte_bounds)
    n = np.diff(w.bounds)
    at_least = np.maximum(1, size)
    words = np.maximum(1, n)

    def near(k: int) -> np.ndarray:
        """Share of words equal to the word ``k`` before, in the same text."""
        same = np.zeros(len(h) + 1, np.int64)
        if len(h) > k:
            same[k + 1 :] = np.cumsum(h[k:] == h[:-k])
        return (same[w.bounds[1:]] - same[np.minimum(w.bounds[:-1] + k, w.bounds[1:])]) / words

    last = raw[w.ends - 1] if len(h) else raw[:0]
    before = raw[np.maximum(w.ends - 2, 0)] if len(h) else raw[:0]
    word_sums = lambda mask: np.diff(np.concatenate([[0], np.cumsum(mask)])[w.bounds]) / words
    symbol = np.isin(raw, np.frombuffer(b"#$%&*@|<>^~=+_\\{}[]", np.uint8))
    upper = (raw >= 65) & (raw <= 90)
    first_upper = upper[w.starts] if len(h) else np.zeros(0, bool)
    return np.stack(
        [
            sums(upper) / at_least,
            sums((raw >= 48) & (raw <= 57)) / at_least,
            sums(raw == 33) / at_least,
            sums(symbol) / at_least,
            sums(raw == 124) / at_least,
            sums((raw == 46) | (raw == 44)) / at_least,
            sums(raw == 10) / at_least,
            near(1),
            near(2),
            near(3),
            word_sums((last == before) & ((last < 97) | (last > 122)) & (last < 128)),
            word_sums(np.isin(last, np.frombuffer(b"#$%&*@|!", np.uint8))),
            word_sums(first_upper),
            np.minimum(1, (w.byte_bounds[1:] - w.byte_bounds[:-1]) / words / 20),
            np.log1p(n) / 10,
            (n < 20).astype(float),
        ],
        1,
    )


def _metadata(docs: DataFrame) -> list[Column]:
    slot = lambda c, salt: F.pmod(F.xxhash64(F.coalesce(F.col(c).cast("string"), F.lit("")), F.col(c).isNull(), F.lit(salt)), F.lit(BUCKETS)).cast("int")
    return [slot("source", 1).alias("m_source"), slot("lang", 2).alias("m_lang"), F.coalesce(F.log1p(F.greatest(F.col("n_chars").cast("double"), F.lit(0.0))), F.lit(-1.0)).alias("m_length")]


def _meta_matrix(source: np.ndarray, lang: np.ndarray, length: np.ndarray) -> np.ndarray:
    m = np.zeros((len(source), 2 * BUCKETS + 2))
    at = np.arange(len(source))
    m[at, source] = 1
    m[at, BUCKETS + lang] = 1
    m[:, -2], m[:, -1] = length / 10, length < 0
    return m


@dataclass
class View:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    intercept: float
    slope: float = 1.0
    shift: float = 0.0

    def logit(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -8, 8) @ self.weights + self.intercept
        return self.slope * z + self.shift


def _fit(x: np.ndarray, y: np.ndarray) -> View:
    mean, scale = x.mean(0), x.std(0) + 1e-3
    w, b = fit_dense(np.clip((x - mean) / scale, -8, 8), y, np.ones(len(y)))
    return View(mean, scale, w, b)


@dataclass
class Model:
    text: View | None
    meta: View | None
    mix: np.ndarray
    intercept: float

    def parts(self, xt: np.ndarray, xm: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Calibrated probabilities of the text view, the metadata view and both."""
        if self.text is None:
            p = np.full(len(xt), sigmoid(np.array(self.intercept)))
            return p, p, p
        a, b = self.text.logit(xt), self.meta.logit(xm)
        return sigmoid(a), sigmoid(b), sigmoid(self.mix[0] * a + self.mix[1] * b + self.intercept)


#: Rows picked for a view: their names, features of both views, and labels.
Picks = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]


def surest(views: tuple[View, View], names: np.ndarray, xt: np.ndarray, xm: np.ndarray, share: float, taken: tuple[set, set]) -> list[tuple[int, int, np.ndarray, np.ndarray]]:
    """``(teacher, label, positions, certainty)`` of the rows that each view is surest of, rows of the same name once.

    The text view (0) teaches the metadata view and the other way round; ``taken`` are the names that each has taught.
    """
    out = []
    _, first = np.unique(names, return_index=True)
    for teacher, view in enumerate(views):
        p = sigmoid(view.logit((xt, xm)[teacher]))
        fresh = first[~np.isin(names[first], np.fromiter(taken[teacher], np.int64, len(taken[teacher])))]
        for label, sure, n in ((1, p, int(GAIN * share)), (0, 1 - p, int(GAIN * (1 - share)))):
            able = fresh[sure[fresh] >= SURE]
            able = able[np.lexsort((names[able], -sure[able]))][:n]
            out.append((teacher, label, able, sure[able]))
    return out


def co_train(xt: np.ndarray, xm: np.ndarray, y: np.ndarray, ut: np.ndarray, um: np.ndarray, rounds: int = ROUNDS) -> Model:
    """Views from labelled rows (``xt``, ``xm``, ``y``) and an unlabelled pool in memory."""
    names = np.arange(len(ut))

    def pick(views, share, taken):
        found = surest(views, names, ut, um, share, taken)
        return [tuple(np.concatenate(x) for x in zip(*((names[at], ut[at], um[at], np.full(len(at), float(label))) for t, label, at, _ in found if t == teacher), strict=True)) for teacher in (0, 1)]

    return _co_train(xt, xm, y, pick, rounds)


def _co_train(xt: np.ndarray, xm: np.ndarray, y: np.ndarray, pick: Callable[..., list[Picks]], rounds: int = ROUNDS) -> Model:
    """Views from labelled rows and rows that ``pick(views, share of good rows, names taken)`` finds for each round."""
    if not len(y) or y.min() == y.max():
        return Model(None, None, np.zeros(2), 0.0 if not len(y) else float(2 * np.sign(y.mean() - 0.5)))
    aside = np.arange(len(y)) % 4 == 0
    if any(len(np.unique(y[x])) < 2 for x in (aside, ~aside)):
        aside = np.ones(len(y), bool)
        lt, lm, ly = xt, xm, y
    else:
        lt, lm, ly = xt[~aside], xm[~aside], y[~aside]
    none = (np.zeros(0, np.int64), xt[:0], xm[:0], np.zeros(0))
    added: list[Picks] = [none, none]  # by teacher
    for r in range(rounds + 1):
        text = _fit(np.concatenate([lt, added[1][1]]), np.concatenate([ly, added[1][3]]))
        meta = _fit(np.concatenate([lm, added[0][2]]), np.concatenate([ly, added[0][3]]))
        if r == rounds:
            break
        got = pick((text, meta), float(ly.mean()), tuple(set(x[0].tolist()) for x in added))
        if not sum(len(x[0]) for x in got):
            break
        added = [tuple(np.concatenate(x) for x in zip(old, new, strict=True)) for old, new in zip(added, got, strict=True)]
    at, am, ay = xt[aside], xm[aside], y[aside]
    for view, x in ((text, at), (meta, am)):  # calibration on rows that no view has seen
        w, b = fit_dense(view.logit(x)[:, None], ay, np.ones(len(ay)), l2=1e-4)
        view.slope, view.shift = max(0.0, float(w[0])), b
    w, b = fit_dense(np.stack([text.logit(at), meta.logit(am)], 1), ay, np.ones(len(ay)), l2=1e-3)
    return Model(text, meta, w, b)


def _featured(docs: DataFrame, more: tuple[str, ...]) -> DataFrame:
    """Features of the text view as arrays beside the metadata and the columns ``more``."""
    kinds = dict(docs.dtypes)
    d = docs.select(*more, *_metadata(docs), F.col("text").cast("string").alias("_text"))

    def run(batches):
        for b in batches:
            parts = [text_features(w) for w in kernel.words(b.column("_text"))]
            x = np.concatenate(parts or [np.zeros((0, TEXT_FEATURES))])
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in (*more, "m_source", "m_lang", "m_length")), pa.array(x.tolist(), pa.list_(pa.float64()))], [*more, "m_source", "m_lang", "m_length", "x"])

    return d.mapInArrow(run, ", ".join([*(f"`{c}` {kinds[c]}" for c in more), "m_source int, m_lang int, m_length double, x array<double>"]))


_META = ("m_source", "m_lang", "m_length")


def _matrices(t: pa.Table | pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Features of the text view and of the metadata view."""
    x = t.column("x")
    x = (x.combine_chunks() if isinstance(x, pa.ChunkedArray) else x).flatten().to_numpy()
    return x.reshape(-1, TEXT_FEATURES), _meta_matrix(*(t.column(c).to_numpy() if isinstance(t, pa.Table) else t.column(c).to_numpy(zero_copy_only=False) for c in _META))


def _picker(pool: DataFrame) -> Callable[..., list[Picks]]:
    """Finds the surest rows of ``pool(row, m_source, m_lang, m_length, x)``: first in every task, then of ``MERGES`` tasks, at
    last among their at most ``MERGES`` times ``4 * GAIN`` rows."""
    kind = "teacher int, label int, sure double, row long, m_source int, m_lang int, m_length double, x array<double>"
    columns = [f.split()[0] for f in kind.split(", ")]

    def pick(views, share, taken):
        shared = pool.sparkSession.sparkContext.broadcast((views, taken))  # a few hundred numbers and at most ROUNDS * 2 * GAIN names

        def best(batches):
            views, taken = shared.value
            held = None
            for b in batches:
                found = surest(views, b.column("row").to_numpy(), *_matrices(b), share, taken)
                new = pa.concat_tables(pa.table({"teacher": pa.array(np.full(len(at), t, np.int32)), "label": pa.array(np.full(len(at), label, np.int32)), "sure": sure, **{c: b.column(c).take(pa.array(at)) for c in columns[3:]}}) for t, label, at, sure in found)
                held = least(new if held is None else pa.concat_tables([held, new]), share)
            if held is not None:
                yield from held.combine_chunks().to_batches()

        def merge(batches):
            held = None
            for b in batches:  # a task holds a batch and the rows that are the surest so far, however many tasks have sent some
                if b.num_rows:
                    new = pa.Table.from_batches([b])
                    held = least(new if held is None else pa.concat_tables([held, new]), share)
            if held is not None:
                yield from held.combine_chunks().to_batches()

        rows = pool.mapInArrow(best, kind).repartition(MERGES).mapInArrow(merge, kind).toArrow()
        shared.destroy()
        rows = least(rows, share)
        xt, xm = _matrices(rows)
        by = rows.column("teacher").to_numpy()
        return [(rows.column("row").to_numpy()[by == t], xt[by == t], xm[by == t], rows.column("label").to_numpy()[by == t].astype(float)) for t in (0, 1)]

    return pick


def least(t: pa.Table, share: float) -> pa.Table:
    """Of rows found by ``surest``, the surest for each teacher and label, each name once."""
    t = t.sort_by([("teacher", "ascending"), ("label", "ascending"), ("sure", "descending"), ("row", "ascending")])
    teacher, label, row = (t.column(c).to_numpy() for c in ("teacher", "label", "row"))
    keep = []
    for k in (0, 1):
        for y, n in ((1, int(GAIN * share)), (0, int(GAIN * (1 - share)))):
            at = np.flatnonzero((teacher == k) & (label == y))
            _, first = np.unique(row[at], return_index=True)
            keep.append(at[np.sort(first)][:n])
    return t.take(pa.array(np.concatenate(keep)))


def train(docs: DataFrame, labels: DataFrame) -> Model:
    """Model from ``docs(doc_id, text, source, lang, n_chars)`` and ``labels(doc_id, quality)``."""
    with small_batches(docs.sparkSession):
        return _train(docs, labels)


def _train(docs: DataFrame, labels: DataFrame) -> Model:
    row = F.xxhash64("doc_id", "text", "source", "lang", "n_chars").alias("row")
    docs = docs.select("doc_id", row, "text", "source", "lang", "n_chars")
    truth = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").cast("double").alias("y"))
    drawn = in_fraction(F.col("doc_id"), 1.25 * LABELLED / max(1, truth.count()))
    # some 150 bytes a document, read in every round
    features = stored(_featured(docs, ("doc_id", "row")).join(truth, "doc_id", "left"), "features")
    k = features.where(F.col("y").isNotNull() & drawn).dropDuplicates(["row"]).orderBy("row").limit(LABELLED).select("y", *_META, "x").toArrow()
    return _co_train(*_matrices(k), k.column("y").to_numpy(), _picker(features.where("y is null").drop("doc_id", "y")))


def score(docs: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``(*keep, score, text_score, meta_score)`` for every row; score is the probability of good quality."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a few hundred numbers
    kinds = dict(docs.dtypes)
    name = "text" if "text" in keep else "_text"
    d = docs.select(*keep, *_metadata(docs), *([] if name in keep else [F.col("text").alias(name)]))

    def run(batches):
        model = shared.value
        for b in batches:
            parts = [text_features(w) for w in kernel.words(b.column(name))]
            x = np.concatenate(parts or [np.zeros((0, TEXT_FEATURES))])
            m = _meta_matrix(*(b.column(c).to_numpy(zero_copy_only=False) for c in ("m_source", "m_lang", "m_length")))
            t, meta, both = model.parts(x, m)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array(both), pa.array(t), pa.array(meta)], [*keep, "score", "text_score", "meta_score"])

    return d.mapInArrow(run, ", ".join([*(f"`{c}` {kinds[c]}" for c in keep), "score double, text_score double, meta_score double"]))
