"""Ranked retrieval: BM25, dense top-k, rank fusion, re-ranking."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from aktenwerk.functions.shared import stored

#: Okapi constants, the share of the mean that replaces a negative idf, and the fusion constant.
K1, B, FLOOR, FUSION = 1.5, 0.75, 0.25, 60
#: Rows of queries and of vectors that a matrix product takes at once.
QUERY_BLOCK, VECTOR_BLOCK = 2048, 2048
#: Bytes of query vectors with their best items, and terms of queries, that one scan takes; scores that a task holds at once.
QUERY_BYTES, QUERY_ENTRIES, CELLS = 128 << 20, 2_000_000, 1 << 22


def ranked(scores: DataFrame, k: int | None = None) -> DataFrame:
    """Adds ``rank`` by falling score, ties by item, and keeps the first ``k``."""
    r = scores.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "item_id")))
    return r if k is None else r.where(F.col("rank") <= k)


def bm25(corpus: DataFrame, queries: DataFrame, n: int) -> DataFrame:
    """RNK-1: top ``n`` of ``corpus(item_id, text)`` for each of ``queries(query_id, text)``: ``(query_id, item_id, score, rank)``.

    Words are split at white space and lower-cased. A term counts as often as the query has it. The negative-idf
    floor needs the mean over all words, so every word is counted once a document, summed in the tasks of the scan before
    anything is shuffled. Scores are rounded, so that sums in any order rank alike.

    The queries are a stated set; their weighted terms go to the tasks, up to ``QUERY_ENTRIES`` at a time. A task makes postings
    of these terms block by block of its documents; what a term's largest impact in the block adds at most bounds each
    query's scores there, and queries whose bound is below their ``n``-th best so far skip the block. Only the ``n`` best of
    each query leave a task, so no pair of query and document is ever shuffled.
    """
    spark = corpus.sparkSession
    words = lambda c: F.filter(F.split(F.lower(c), r"(?U)\s+"), lambda w: w != "")
    q = queries.select("query_id", F.explode(words("text")).alias("term")).groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("times"))
    d = corpus.select("item_id", words("text").alias("w")).withColumn("size", F.size("w"))
    stats = d.agg(F.count(F.lit(1)).alias("docs"), F.avg("size").alias("mean_size"))
    df = d.select(F.explode(F.array_distinct("w")).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df")).crossJoin(F.broadcast(stats))  # one row
    idf = df.withColumn("idf", F.log(F.col("docs") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5))
    floor = idf.agg((FLOOR * F.avg("idf")).alias("floor"))
    idf = idf.join(q.select("term").distinct(), "term", "left_semi").crossJoin(F.broadcast(floor))
    idf = idf.select("term", "mean_size", F.when(F.col("idf") < 0, F.col("floor")).otherwise(F.col("idf")).alias("idf"))
    weights = stored(q.join(idf, "term").select("query_id", "term", "mean_size", (F.col("times") * F.col("idf")).alias("weight")), "weights")
    docs = d.select("item_id", F.coalesce("w", F.array().cast("array<string>")).alias("w"))
    kinds = dict(queries.dtypes)["query_id"], dict(corpus.dtypes)["item_id"]
    n_parts = max(1, -(-weights.count() // QUERY_ENTRIES))
    out = None
    for number in range(n_parts):
        rows = weights.where(F.pmod(F.xxhash64("query_id"), F.lit(n_parts)) == number).toArrow()
        part = docs.mapInArrow(_scorer(spark.sparkContext.broadcast(_entries(rows)), n), f"query_id {kinds[0]}, item_id {kinds[1]}, score double")
        out = part if out is None else out.unionByName(part)
    return ranked(out, n)


def _entries(rows: pa.Table) -> tuple:
    """Query ids, terms, and by term: the queries that have it and their weights; the mean size of documents."""
    ids, terms = (rows.column(c).combine_chunks().dictionary_encode() for c in ("query_id", "term"))
    of, term = ids.indices.to_numpy(zero_copy_only=False).astype(np.int64), terms.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    order = np.argsort(term, kind="stable")
    mean = rows.column("mean_size")[0].as_py() if rows.num_rows else 1.0
    return ids.dictionary, terms.dictionary, of[order], term[order], rows.column("weight").to_numpy()[order], mean


def _scorer(shared: Broadcast, n: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, terms, of, term, weight, mean = shared.value
        best, kind = _none(len(ids)), None
        for b in batches:
            lists, kind = b.column("w"), b.schema.field("item_id").type
            sizes = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            found = pc.fill_null(pc.index_in(lists.flatten(), value_set=terms), -1).to_numpy(zero_copy_only=False).astype(np.int64)
            code = (np.repeat(np.arange(len(sizes)), sizes) * max(1, len(terms)) + found)[found >= 0]
            code, tf = np.unique(code, return_counts=True)
            doc, t = np.divmod(code, max(1, len(terms)))
            impact = tf * (K1 + 1) / (tf + K1 * (1 - B + B * sizes[doc] / mean))
            items = np.asarray(b.column("item_id").to_pylist())
            step = max(1, CELLS // max(1, len(ids)))
            for first in range(0, len(items), step):
                at = slice(*np.searchsorted(doc, [first, first + step]))
                best = _in_block(best, items[first : first + step], doc[at] - first, t[at], impact[at], (of, term, weight, len(terms)), n)
        if len(best[0]):
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(best[0])), pa.array(best[2].tolist(), kind), pa.array(best[1])], ["query_id", "item_id", "score"])

    return run


def _in_block(best: tuple, items: np.ndarray, doc: np.ndarray, t: np.ndarray, impact: np.ndarray, entries: tuple, n: int) -> tuple:
    """The best of each query when the postings ``(doc, t, impact)`` of a block of documents have been seen too."""
    of, term, weight, n_terms = entries
    n_queries, least = len(best[3]), best[3]
    top = np.zeros(n_terms)
    np.maximum.at(top, t, impact)
    bound = np.bincount(of, np.maximum(weight, 0) * top[term], n_queries)
    live = (bound >= least - 1e-8)[of]
    if not live.any():
        return best
    of, term, weight = of[live], term[live], weight[live]
    starts = np.searchsorted(term, np.arange(n_terms + 1))
    m = starts[t + 1] - starts[t]
    e = np.repeat(starts[t] - (np.cumsum(m) - m), m) + np.arange(int(m.sum()))
    cell = of[e] * len(items) + np.repeat(doc, m)
    scores = np.bincount(cell, weight[e] * np.repeat(impact, m), n_queries * len(items))
    scores = np.where(np.bincount(cell, minlength=len(scores)) > 0, np.round(scores, 9), -np.inf)
    return _merged(best, scores.reshape(n_queries, len(items)), items, n)


def _none(n_queries: int) -> tuple:
    """No results yet: queries, scores and items of the best so far, and the k-th score of each query."""
    return np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64), np.full(n_queries, -np.inf)


def _merged(best: tuple, s: np.ndarray, items: np.ndarray, k: int) -> tuple:
    """The ``k`` best of each query of what was best so far and the scores ``s`` (queries by items)."""
    of, score, item, least = best
    # few blocks of items hold more than a few that reach the k-th; all that tie with it stay until ties are broken by id
    few = np.count_nonzero(s >= least[:, None]) <= k * len(least) and not np.isneginf(least).any()
    bar = least if few else np.maximum(least, np.partition(s, len(items) - k, axis=1)[:, -k]) if len(items) > k else least
    q, j = np.nonzero((s >= bar[:, None]) & np.isfinite(s))
    of, score = np.concatenate([of, q]), np.concatenate([score, s[q, j]])
    item = np.concatenate([item, items[j]]) if len(item) else items[j]
    order = np.lexsort((item, -score, of))
    of, score, item = of[order], score[order], item[order]
    place = np.arange(len(of)) - np.searchsorted(of, of)
    last = place == k - 1
    least[of[last]] = score[last]
    return of[place < k], score[place < k], item[place < k], least


def normalised(vector: str) -> Column:
    """L2-normalised vector in double."""
    v = F.transform(vector, lambda x: x.cast("double"))
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x))
    return F.when(norm > 0, F.transform(v, lambda x: x / norm)).otherwise(v)


def dense_scores(vectors: DataFrame, queries: DataFrame, k: int, same_label: bool = False) -> DataFrame:
    """TOP-1: the ``k`` best items of each partition for every query, then the ``k`` best overall.

    ``vectors(item_id, embedding[, label])``, ``queries(query_id, embedding[, label])``, both normalised in the job. The
    queries are a stated set; one scan takes all blocks of ``QUERY_BLOCK`` queries that fit into ``QUERY_BYTES`` with their ``k`` best items,
    more queries take more scans, so a task's memory doesn't grow with them. Each task multiplies blocks of matrices and
    keeps ``k`` rows a query, so no pair of rows is ever emitted.
    """
    spark = vectors.sparkSession
    names = ["query_id", "label"] if same_label else ["query_id"]
    q = queries.select(*names, normalised("embedding").alias("v"))
    v = vectors.select("item_id", *(["label"] if same_label else []), normalised("embedding").alias("v"))
    known = queries.agg(F.count(F.lit(1)), F.max(F.size("embedding"))).first()
    n_blocks = max(1, -(-known[0] // QUERY_BLOCK))
    # a query is its vector and its best: query, score and item
    at_once = max(1, QUERY_BYTES // (8 * QUERY_BLOCK * (max(1, known[1] or 1) + 3 * k)))
    schema = f"query_id {dict(q.dtypes)['query_id']}, item_id {dict(v.dtypes)['item_id']}, score double"

    def block(number: int):
        rows = q.where(F.pmod(F.xxhash64("query_id"), F.lit(n_blocks)) == number).toPandas()
        return spark.sparkContext.broadcast((rows["query_id"].to_numpy(), rows["label"].to_numpy() if same_label else None, np.array(rows["v"].tolist(), float).reshape(len(rows), -1)))

    out = None
    for first in range(0, n_blocks, at_once):
        shared = [block(k) for k in range(first, min(n_blocks, first + at_once))]

        def run(frames, shared=shared):
            import pandas as pd

            best = [_none(len(x.value[0])) for x in shared]
            for f in frames:
                for a in range(0, len(f), VECTOR_BLOCK):
                    part = f.iloc[a : a + VECTOR_BLOCK]
                    items, w = part["item_id"].to_numpy(), np.array(part["v"].tolist(), float)
                    for i, x in enumerate(shared):
                        if len(x.value[0]):
                            scores = x.value[2] @ w.T
                            if same_label:
                                scores[x.value[1][:, None] != part["label"].to_numpy()[None]] = -np.inf
                            best[i] = _merged(best[i], scores, items, k)
            for (of, score, item, _), x in zip(best, shared, strict=True):
                yield pd.DataFrame({"query_id": x.value[0][of], "item_id": item, "score": score})

        part = v.mapInPandas(run, schema)
        out = part if out is None else out.unionByName(part)
    return ranked(out, k)


def top_in_label(vectors: DataFrame, queries: DataFrame, k: int, pool: bool = False) -> DataFrame:
    """TOP-2: top ``k`` items that carry the query's label: exact, or from a pool of the ``20 k`` best of all labels."""
    if not pool:
        return dense_scores(vectors, queries, k, same_label=True)
    p = dense_scores(vectors, queries, 20 * k)
    j = p.join(vectors.select("item_id", "label"), "item_id").join(queries.select("query_id", F.col("label").alias("_l")), "query_id")
    return ranked(j.where("label = _l").select("query_id", "item_id", "score"), k)


def rank_gap(scores: DataFrame) -> DataFrame:
    """WIN-5: best item of each query and its lead over the second (null if there is none)."""
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "item_id")
    r = scores.withColumn("rank", F.row_number().over(w)).withColumn("gap", F.col("score") - F.lead("score").over(w))
    return r.where("rank = 1").select("query_id", "item_id", "score", "gap")


def rrf(rankings: list[DataFrame], n: int | None = None, k: int = FUSION) -> DataFrame:
    """RNK-2: sum of ``1 / (k + rank)`` over rankings ``(query_id, item_id, rank)``."""
    out = rankings[0].select("query_id", "item_id", "rank")
    for r in rankings[1:]:
        out = out.unionByName(r.select("query_id", "item_id", "rank"))
    out = out.repartition("query_id", "item_id")  # shuffled here, so that the parts of the union needn't be laid out alike
    return ranked(out.groupBy("query_id", "item_id").agg(F.sum(1 / (F.lit(k) + F.col("rank"))).alias("score")), n)


def hybrid(sparse: DataFrame, dense: DataFrame, n: int, pool: int = 50) -> DataFrame:
    """RNK-3: fusion of the first ``pool`` of two rankings."""
    return rrf([r.where(F.col("rank") <= pool) for r in (sparse, dense)], n)


def rerank(candidates: DataFrame, scores: DataFrame, targets: DataFrame, n: int = 5) -> DataFrame:
    """RNK-4: candidates ordered by given scores (unscored ones last), with a marker for targets."""
    j = candidates.select("query_id", "item_id").join(scores, ["query_id", "item_id"], "left")
    w = Window.partitionBy("query_id").orderBy(F.desc_nulls_last("score"), "item_id")
    top = j.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)
    t = targets.select("query_id", "item_id").distinct().withColumn("_t", F.lit(True))
    return top.join(t, ["query_id", "item_id"], "left").select("query_id", "item_id", "score", "rank", F.coalesce("_t", F.lit(False)).alias("is_target"))
