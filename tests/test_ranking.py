import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from aktenwerk.operators import ranking
from aktenwerk.operators.evaluation import upper_median


def brute_bm25(docs, queries, n):
    w = {i: (t or "").lower().split() for i, t in docs}
    df = Counter(x for v in w.values() for x in set(v))
    sizes = [len(v) for i, v in w.items() if dict(docs)[i] is not None]
    mean = sum(sizes) / len(sizes)
    idf = {x: math.log(len(docs) - c + 0.5) - math.log(c + 0.5) for x, c in df.items()}
    floor = 0.25 * sum(idf.values()) / len(idf)
    out = []
    for q, text in queries:
        scores = []
        for i, v in w.items():
            tf = Counter(v)
            own = [x for x in (text or "").lower().split() if x in tf]
            if own:
                s = sum((idf[x] if idf[x] >= 0 else floor) * tf[x] * 2.5 / (tf[x] + 1.5 * (0.25 + 0.75 * len(v) / mean)) for x in own)
                scores.append((-round(s, 9), i))
        out += [(q, i, pytest.approx(-s, abs=2e-9), k) for k, (s, i) in enumerate(sorted(scores)[:n], 1)]
    return out


@pytest.mark.parametrize(("cells", "entries"), [(1 << 22, 2_000_000), (40, 25), (1, 2_000_000)])
def test_bm25_is_brute_force(spark, monkeypatch, cells, entries):
    """Nulls, empty and repeated texts, ties, terms in most documents (negative idf), blocks of a few scores and passes of a few terms."""
    monkeypatch.setattr(ranking, "CELLS", cells)
    monkeypatch.setattr(ranking, "QUERY_ENTRIES", entries)
    r = random.Random(3)
    v = [f"w{i}" for i in range(40)]
    text = lambda n: " ".join(r.choice(v[: r.choice((3, 40))]) for _ in range(n))
    docs = [(f"d{i:03d}", text(r.randrange(60)) + " Überall") for i in range(80)] + [("x1", None), ("x2", ""), ("x3", " \n "), ("y1", "w7 w8"), ("y2", "w7 w8"), ("y3", "W7 w8")]
    queries = [(i, text(r.randrange(1, 12))) for i in range(12)] + [(50, None), (51, ""), (52, "unknown words"), (53, "überall w1"), (54, "w7 W7 w8")]
    d = spark.createDataFrame(docs, "item_id string, text string").withColumn("score", F.lit("clash")).repartition(3)
    got = ranking.bm25(d, spark.createDataFrame(queries, "query_id long, text string"), 4).collect()
    assert sorted(((x["query_id"], x["item_id"], x["score"], x["rank"]) for x in got), key=lambda x: (x[0], x[3])) == brute_bm25([(i, t and t.replace(" ", " ")) for i, t in docs], queries, 4)


def test_bm25_shuffles_no_pairs(spark):
    d = spark.range(50).select(F.col("id").alias("item_id"), F.lit("a b c").alias("text"))
    top = ranking.bm25(d, spark.range(3).select(F.col("id").alias("query_id"), F.lit("a b").alias("text")), 2)
    plan = top._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "Join" not in plan
    assert ranking.bm25(d.limit(0), spark.createDataFrame([(1, "a")], "query_id long, text string"), 2).count() == 0


def test_dense_takes_all_blocks_of_queries_in_one_scan(spark, monkeypatch):
    r = random.Random(1)
    rows = [(i, [r.choice((-1.0, 0.0, 1.0)) for _ in range(4)], f"l{i % 3}") for i in range(60)]
    v = spark.createDataFrame(rows, "item_id long, embedding array<float>, label string").repartition(3)
    q = v.withColumnRenamed("item_id", "query_id")
    whole = [sorted(map(tuple, ranking.top_in_label(v, q, 3).collect())), sorted(map(tuple, ranking.dense_scores(v, q, 5).collect()))]
    monkeypatch.setattr(ranking, "QUERY_BLOCK", 7)
    for size, scans in ((256 << 20, 1), (8 * 7 * 4 * 3, 3)):
        monkeypatch.setattr(ranking, "QUERY_BYTES", size)
        top = ranking.dense_scores(v, q, 5)
        assert top._jdf.queryExecution().executedPlan().toString().count("MapInPandas") == scans
        assert [sorted(map(tuple, ranking.top_in_label(v, q, 3).collect())), sorted(map(tuple, top.collect()))] == whole


def test_upper_median(spark):
    r = random.Random(5)
    of = {"a": [r.random() for _ in range(20_001)], "b": [1.0, 2.0], "c": [3.0], "d": [r.randrange(4) / 2 for _ in range(5000)], "e": [float(i % 7 == 0) for i in range(1000)]}
    rows = [(k, x) for k, xs in of.items() for x in xs] + [("a", None), ("f", None)]
    v = spark.createDataFrame(rows, "extractor string, ms double")
    got = upper_median(v, "extractor", "ms")
    assert {x["extractor"]: x["median"] for x in got.collect()} == {k: sorted(xs)[len(xs) // 2] for k, xs in of.items()}
    assert "collect_list" not in got._jdf.queryExecution().executedPlan().toString()


def test_scans_grow_with_queries_not_a_task(spark, monkeypatch):
    """Queries that don't fit one scan take more scans, with the same result; what a scan takes counts the best items too."""
    import numpy as np

    rng = np.random.default_rng(5)
    v = spark.createDataFrame([(i, rng.normal(size=4).tolist()) for i in range(300)], "item_id long, embedding array<double>").repartition(3)
    q = v.withColumnRenamed("item_id", "query_id")
    rows = lambda: sorted(map(tuple, ranking.dense_scores(v, q, 7).collect()))
    whole = rows()
    monkeypatch.setattr(ranking, "QUERY_BLOCK", 64)
    monkeypatch.setattr(ranking, "VECTOR_BLOCK", 32)
    monkeypatch.setattr(ranking, "QUERY_BYTES", 8 * 64 * (4 + 3 * 7))
    scans = []
    made = type(v).mapInPandas
    monkeypatch.setattr(type(v), "mapInPandas", lambda self, *a, **b: scans.append(1) or made(self, *a, **b))
    assert rows() == whole
    assert len(scans) == -(-300 // 64)
