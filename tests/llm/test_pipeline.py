"""The corpus pipeline against brute-force versions of its stages, and the queries against their SQL."""

import os

import pytest

from tests.llm.test_operators import brute_components, brute_targets, words

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def test_pipeline(spark):
    import corpus_pipeline as p
    from llm import quality, toxicity
    from llm.common import stored, table

    docs = table(spark, SF, "documents").select(*p.COLUMNS)
    kept = {r["doc_id"]: r for r in docs.collect()}
    frames = [docs]
    for _, stage in p.STAGES:
        frames.append(stored(stage(spark, frames[-1], SF), "stage"))
    rows = [{r["doc_id"]: r for r in f.collect()} for f in frames]
    labels = table(spark, SF, "labels")
    # 1 and 2: exactly the documents that the stage's classifier rejects go
    model = toxicity.train(docs.where(~toxicity.fold()), labels.where(~toxicity.fold()))
    assert set(rows[1]) == {r["doc_id"] for r in toxicity.score(docs, model).collect() if r["score"] < 0.5}
    model = quality.train(frames[1], labels)
    assert set(rows[2]) == {r["doc_id"] for r in quality.score(frames[1], model).collect() if r["score"] >= 0.5}
    # 3: the smallest of each component
    c = brute_components([(i, r["text"]) for i, r in rows[2].items()])
    assert set(rows[3]) == {i for i, (_, k) in c.items() if i == k}
    # 4: no document with three quarters of an item's shingles is left, all without any shingle are
    items = [words(r["text"]) for r in table(spark, SF, "benchmark").collect()]
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in items]
    share = {}
    for i, r in rows[3].items():
        w = words(r["text"])
        s = {tuple(w[k : k + 5]) for k in range(len(w) - 4)}
        share[i] = max((len(s & x) / len(x) for x in sets if x), default=0)
    assert not any(share[i] >= 0.75 for i in rows[4]) and all(i in rows[4] for i in share if share[i] == 0)
    # 5: targets and words taken
    sizes = {}
    for r in rows[4].values():
        sizes[r["source"]] = sizes.get(r["source"], 0) + len(words(r["text"]))
    want = brute_targets(sizes)
    taken = dict.fromkeys(sizes, 0)
    for i, r in rows[5].items():
        assert r["text"] == kept[i]["text"] and 0 < r["taken"] <= 3 * r["size"] and r["size"] == len(words(r["text"]))
        taken[r["source"]] += r["taken"]
    assert all(abs(taken[s] - want[s]) <= 1 for s in sizes)
    assert all(f.columns == list(p.COLUMNS) for f in frames[1:-1])


def test_pipeline_edge_cases(spark, tmp_path):
    """Nulls in every column, empty and repeated texts and rows, repeated ids, clashing columns; then empty tables."""
    import random

    import corpus_pipeline as p
    from llm.common import stored
    from pyspark.sql import functions as F

    r = random.Random(2)
    v = ["".join(r.choice("abcdefgh") for _ in range(5)) for _ in range(400)]
    text = lambda n: " ".join(r.choice(v) for _ in range(n))
    item, long = text(20), text(60)
    rows = [(i, text(30), r.choice(("en", None)), r.choice(("a", "b", None)), r.choice((3, None))) for i in range(30)]
    rows += [(40, long, "en", "a", 1), (41, long, "en", "a", 1), (42, long + " more", "en", "b", 2), (43, text(9) + " " + item + " " + text(9), "en", "a", 1)]
    rows += [rows[3], rows[3], (50, None, None, None, None), (51, "", "en", "a", 0), (None, text(12), "en", "a", 1), (None, long, "en", "a", 1), (60, text(10), "en", "a", 1), (60, text(10), "en", "b", 2)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    d = d.withColumn("score", F.lit("x")).withColumn("taken", F.lit(1)).withColumn("component_id", F.lit(None).cast("long")).withColumn("_text", F.lit("y"))

    def run(docs, labels, items):
        path = f"{tmp_path}/{r.random()}"
        docs.write.parquet(f"{path}/documents.parquet")
        spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
        spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
        frames = [docs.select(*p.COLUMNS)]
        for _, stage in p.STAGES:
            frames.append(stored(stage(spark, frames[-1], path), "stage"))
        assert sorted(map(repr, p.run(spark, path).collect())) == sorted(map(repr, frames[-1].collect()))
        return [f.collect() for f in frames]

    for labels in ([], [(1, None, None), (None, 1, 1), (3, 1, 0), (777, 0, 1)]):
        out = run(d, labels, [(1, item), (2, None), (3, "")])
        assert [len(x) for x in out[:3]] == [len(rows)] * 3
        ids = sorted((x["doc_id"] for x in out[3] if x["doc_id"] is not None))
        assert ids == [*range(30), 40, 43, 50, 51, 60] and sum(x["doc_id"] is None for x in out[3]) == 2
        assert sorted(x["doc_id"] for x in out[4] if x["doc_id"] is not None) == [i for i in ids if i != 43]
        assert out[5] and all(x["taken"] > 0 and x["taken"] <= 3 * x["size"] for x in out[5]) and {x["doc_id"] for x in out[5]} <= {x["doc_id"] for x in out[4]}
    assert [len(x) for x in run(d.limit(0), [], [])] == [0] * 6


@pytest.mark.parametrize("name", ["op3_warc_index", "op5_merkle_fingerprints", "op7_ngram_jaccard_join", "op8_mix_sources", "op11_interleaved_shards", "op12_filter_audit"])
def test_sql(spark, name):
    import duckdb

    from llm.queries import QUERIES, SQL

    c = duckdb.connect()
    for t in ("documents", "pages", "labels"):
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    want = c.execute(SQL[name]).to_arrow_table()
    got = QUERIES[name](spark, SF).toArrow()
    columns = sorted(want.column_names)
    assert sorted(got.column_names) == columns
    flat = lambda t: sorted(repr([round(v, 9) if isinstance(v, float) else v for v in r.values()]) for r in t.select(columns).to_pylist())
    assert flat(got) == flat(want)
