import hashlib
import json

import pytest
from pyspark.sql import functions as F

from aktenwerk.operators import custody, evaluation, logs, ranking
from aktenwerk.sources import letters, statutes

NORM = "<norm><metadaten>{law}<enbez>{enbez}</enbez>{title}</metadaten><textdaten><text><Content>{body}</Content></text></textdaten></norm>"


def law_xml(*norms):
    return "<dokumente><norm><metadaten><jurabk>WHG</jurabk></metadaten></norm>" + "\n".join(norms) + "</dokumente>"


def test_statutes(spark, tmp_path):
    amt = "<jurabk>WHG 2009</jurabk><amtabk>WHG</amtabk>"
    norms = [
        NORM.format(law=amt, enbez="Inhaltsübersicht", title="", body="<P>x</P>"),
        NORM.format(law=amt, enbez="§   9", title="<titel>Be<I>nut</I>zung</titel>", body="<P>(1) Eins <I>zwei</I> drei.</P><P>(2) Vier.</P>"),
        NORM.format(law="<jurabk>WHG</jurabk>", enbez="§ 9a", title="", body="<P>Nur jurabk &amp; so.</P>"),
        NORM.format(law=amt, enbez="§ 10", title="", body="<P>(weggefallen)</P>"),
        NORM.format(law=amt, enbez="§ 11", title="", body=""),
        NORM.format(law=amt, enbez="Anlage 1", title="", body="<P>x</P>"),
        NORM.format(law=amt, enbez="§ 9", title="", body="<P>Doppelt.</P>"),
    ]
    (tmp_path / "whg.xml").write_text(law_xml(*norms), encoding="utf-8")
    s = statutes.read_statutes(spark, f"file://{tmp_path}")
    got = [(r["canonical_key"], r["text"]) for r in s.orderBy("position").collect()]
    assert got == [("§ 9 WHG", "(1) Eins zwei drei. (2) Vier."), ("§ 9a WHG", "Nur jurabk & so."), ("§ 9 WHG", "Doppelt.")]
    unique, twice = statutes.latest(s)
    assert {r["canonical_key"]: r["text"] for r in unique.collect()}["§ 9 WHG"] == "Doppelt." and twice.first()["n"] == 2
    chunks = [(r["chunk_id"], r["text"]) for r in statutes.read_statute_chunks(spark, f"file://{tmp_path}").collect()]
    assert ("whg_§9_abs1", "§ 9 WHG – (1) Eins zwei drei.") in chunks and ("whg_§9a", "§ 9a WHG – Nur jurabk & so.") in chunks


def test_corpus_id(spark):
    rows = [("§ 1 WHG", "a"), ("§ 2 WHG", "b"), ("§ 3 WHG", "c")]
    of = lambda r: statutes.corpus_id(spark.createDataFrame(r, "canonical_key string, text string")).first()[0]
    assert of(rows) == of(rows[::-1])
    assert len({of(rows), of(rows[:2]), of([("§ 1 WHG", "x"), *rows[1:]]), of([("§ 1 WHGa", ""), *rows[1:]])}) == 4
    # a tree of three levels: by plain hashing, and the same for any order
    many = [(f"§ {i} WHG", f"text {i % 7}") for i in range(60)]
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    leaves = {}
    for k, t in many:
        h = sha(f"{k}\0{t}\0")
        leaves.setdefault(tuple(int(h[4 * j : 4 * j + 4], 16) % 4 for j in range(3)), []).append(h)
    nodes = {b: sha("".join(sorted(x))) for b, x in leaves.items()}
    for _ in range(3):
        above = {}
        for b, h in nodes.items():
            above.setdefault(b[:-1], []).append((b[-1], h))
        nodes = {b: sha("".join(f"{k}:{h}" for k, h in sorted(x))) for b, x in above.items()}
    deep = lambda r: statutes.corpus_id(spark.createDataFrame(r, "canonical_key string, text string"), 4, 1).first()[0]
    assert deep(many) == nodes[()] == deep(many[::-1]) != deep(many[:-1])


def test_briefings_are_compressed(spark, tmp_path):
    """Every row of briefings repeats names and quoted statutes, which fill the disk where they aren't compressed."""
    text = "Die Gewässer sind nachhaltig zu bewirtschaften. " * 20
    b = spark.range(300).selectExpr("id AS document_id", "CAST(NULL AS STRING) AS typ", f"array(named_struct('pos', 1, 'source_text', '{text}')) AS entries")
    letters.write_briefings(b, f"file://{tmp_path}/out")
    files = list((tmp_path / "out").glob("part-*"))
    assert files and all(f.name.endswith(".json.gz") for f in files) and sum(f.stat().st_size for f in files) < 300 * len(text) / 10
    assert sorted(spark.read.schema(b.schema).json(f"file://{tmp_path}/out").collect()) == sorted(b.collect())
    assert '"typ":null' in spark.read.text(f"file://{tmp_path}/out").first()[0]


def test_documents_are_written_without_hadoop(spark, tmp_path, monkeypatch):
    texts = ["a\r\n§ é\n", "", None, "b\x00", "twice", "twice"]
    docs = spark.createDataFrame([(None if t == "" else min(i, 4), t) for i, t in enumerate(texts)], "doc_id long, text string")
    kind = lambda i: f"doc_id={'__HIVE_DEFAULT_PARTITION__' if i is None else i}"
    want = sorted((kind(r["doc_id"]), (r["text"] or "") + "\n") for r in docs.collect())
    for name in ("mounted", "elsewhere"):
        if name == "elsewhere":
            monkeypatch.setattr(letters, "_local", lambda *_: None)
        letters.write_documents(docs, f"file://{tmp_path}/{name}", "doc_id")
        assert sorted(tuple(r) for r in letters.read_documents(spark, f"file://{tmp_path}/{name}").select("doc_type", "text").collect()) == want
        # Hadoop's local file system leaves a hidden sum of each file that it writes
        sums = [f for f in (tmp_path / name).rglob(".*.crc") if "part-" in f.name]
        assert bool(sums) == (name == "elsewhere")
        sizes = [r["length"] for half in letters.size_guard(spark, f"file://{tmp_path}/{name}", 3) for r in half.where("path like '%.txt'").collect()]
        assert sorted(sizes) == sorted(len(x.encode()) for _, x in want)
    assert all("bucket=" in str(f) for f in (tmp_path / "mounted").rglob("*.txt"))
    letters.write_documents(docs.limit(0), f"file://{tmp_path}/none", "doc_id")
    assert letters.read_documents(spark, f"file://{tmp_path}/none").count() == 0


def test_letters_in_and_out(spark, tmp_path):
    (tmp_path / "in/typ1").mkdir(parents=True)
    (tmp_path / "in/typ1/eins.txt").write_text("Zeile 1\nZeile ü", encoding="utf-8")
    (tmp_path / "in/typ1/gross.txt").write_text("x" * 50, encoding="utf-8")
    docs = letters.read_documents(spark, f"file://{tmp_path}/in")
    assert {(r["document_id"], r["doc_type"], r["text"]) for r in docs.collect()} >= {("eins", "typ1", "Zeile 1\nZeile ü")}
    small, large = letters.size_guard(spark, f"file://{tmp_path}/in", 20)
    assert small.count() == 1 and large.first()["length"] == 50


def test_raw_store_leaves_a_trail(spark, tmp_path):
    ids = [f"00000000-0000-0000-0000-00000000000{i}" for i in range(3)]
    letters.write_raw(spark.createDataFrame([(i, f"text {i}") for i in ids], "document_id string, text string"), f"file://{tmp_path}/raw")
    asked = spark.createDataFrame([(ids[0],), (ids[1],), ("../etc",), (ids[0].replace("0000000000", "9999999999"),)], "document_id string")
    for k in range(2):
        docs, rejected = letters.read_raw(spark, asked, f"file://{tmp_path}/raw", f"file://{tmp_path}/log", F.lit(f"2024-01-0{k + 1}").cast("timestamp"))
        assert {r["document_id"] for r in docs.collect()} == set(ids[:2])
        assert sorted(r["reason"] for r in rejected.collect()) == ["not_a_uuid", "unknown"]
    log = spark.read.parquet(f"file://{tmp_path}/log")
    assert log.count() == 4 and custody.chain_breaks(log).count() == 0


def test_audit_log(spark, tmp_path):
    line = {"event_id": "1", "event_type": "triage", "document_id": "d", "ts": "2024-01-01T00:00:00Z", "payload": {"argument_count": 1}, "serialization_version": 1, "sequence_number": 0, "event_hash": "x", "chain_id": "d", "idx": 0}
    (tmp_path / "log.jsonl").write_text(json.dumps(line) + '\n{"event_id": \nkein json\n')
    good, bad = letters.read_audit(spark, f"file://{tmp_path}/log.jsonl")
    assert json.loads(good.first()["payload"]) == {"argument_count": 1} and bad.count() == 2


def test_ground_truth(spark, tmp_path):
    (tmp_path / "r.json").write_text(json.dumps({"doc_id": "d", "expected_arguments": [{"argument_id": "a", "expected_norms": {"must_retrieve": [{"paragraph_id": "p", "citation": "§ 1 WHG", "rank_target": "top_1"}], "should_retrieve": [], "not_retrievable_via_xml": [{"citation": "TA Lärm"}]}}]}))
    (tmp_path / "c.json").write_text(json.dumps({"expected_catalog_assignment": [{"dokument": "d", "doc_type": "typ1", "expected_einwendungs_typ": "TYP_1", "expected_catalog_ids": ["whg"], "expected_argument_count_range": [1, 3]}]}))
    (tmp_path / "e.json").write_text(json.dumps([{"dokument": "d", "explizit_zitierte_normen": [{"norm": "§ 1 WHG", "type": "paragraph_norm"}]}, {"dokument": "leer", "explizit_zitierte_normen": []}]))
    (tmp_path / "p.json").write_text(json.dumps({"documents": [{"file": "f", "names_must_mask": ["Eva"], "must_survive": ["Stein"]}]}))
    at = lambda n: f"file://{tmp_path}/{n}.json"
    assert [(r["need"], r["citation"], r["rank_target"]) for r in letters.read_gt_retrieval(spark, at("r")).collect()] == [("must_retrieve", "§ 1 WHG", "top_1"), ("not_retrievable", "TA Lärm", None)]
    r = letters.read_gt_catalog(spark, at("c")).first()
    assert (r["document_id"], r["low"], r["high"]) == ("d", 1, 3)
    assert [(x["document_id"], x["norm"]) for x in letters.read_gt_citations(spark, at("e")).collect()] == [("d", "§ 1 WHG"), ("leer", None)]
    assert letters.read_gt_pii(spark, at("p")).first()["names_must_mask"] == ["Eva"]


def test_results_carry_the_chain_head(spark, tmp_path):
    head = spark.createDataFrame([("x", 3), ("y", 4)], "event_hash string, sequence_number long")
    letters.write_results(spark.createDataFrame([(1, None)], "a int, b string"), head, f"file://{tmp_path}/out")
    # a partition without rows may leave an empty file
    lines = [x for f in (tmp_path / "out").glob("*.json") for x in f.read_text().splitlines()]
    assert [json.loads(x) for x in lines] == [{"a": 1, "b": None, "chain_head_hash": "y", "chain_head_sequence": 4}]


def test_scores_of_undefined_sets(spark):
    counts = spark.createDataFrame([(0, 0, 2), (0, 3, 0), (0, 0, 0), (2, 1, 1)], "tp int, fp int, fn int")
    got = [(r["precision"], r["recall"], r["f1"]) for r in evaluation.scored(counts).collect()]
    assert got[0] == (None, 0.0, 0.0) and got[1] == (0.0, None, None) and got[2] == (None, None, None)
    assert got[3] == pytest.approx((2 / 3, 2 / 3, 2 / 3))
    assert evaluation.scored(counts, vacuous=1.0).collect()[2]["precision"] == 1.0


def test_logs(spark):
    schema = "run_id string, origin string, event string, level string, ts timestamp, attrs map<string,string>, exc_text string"
    trace = 'Traceback (most recent call last):\n  File "/a/b.py", line 7, in f\n    x()\nmod.MyError: geheim: x'
    d = spark.createDataFrame([("r", "own", "e\x07", "i", None, {"a": "x\ty", "b": "1", "correlation_id": "forged"}, trace), ("s", "foreign", "f" * 201, "i", None, {"a": "1"}, None)], schema)
    kept, bad = logs.log_allowlist(d, ("a",))
    assert [r["attrs"] for r in kept.collect()] == [{"a": "x\ty"}, {"a": "1"}] and bad.count() == 2
    s = logs.sanitize_logs(d).collect()
    assert s[0]["event"] == "e" and s[0]["attrs"]["a"] == "xy" and s[1]["event"] == "f" * 200 + "[truncated]"
    e = logs.reduce_exceptions(d).collect()
    assert (e[0]["exc_type"], e[0]["exc_location"]) == ("mod.MyError", "b.py:7") and e[1]["exc_type"] is None and "exc_text" not in e[0]
    runs = spark.createDataFrame([("r", "c1")], "run_id string, correlation_id string")
    assert {r["run_id"]: r["attrs"].get("correlation_id") for r in logs.stamp_correlation(d, runs).collect()} == {"r": "c1", "s": None}


def test_dense_ties_and_zero_vectors(spark):
    v = spark.createDataFrame([(i, [1.0, 0.0] if i < 6 else [0.0, 0.0], i % 2) for i in range(9)], "item_id long, embedding array<float>, label int")
    q = v.where("item_id = 0").withColumnRenamed("item_id", "query_id")
    assert [r["item_id"] for r in ranking.dense_scores(v, q, 3).orderBy("rank").collect()] == [0, 1, 2]
    assert [r["item_id"] for r in ranking.top_in_label(v, q, 3).orderBy("rank").collect()] == [0, 2, 4]
    fused = ranking.rrf([ranking.dense_scores(v, q, 3), ranking.top_in_label(v, q, 3)]).orderBy("rank").collect()
    assert fused[0]["item_id"] == 0 and fused[0]["score"] == pytest.approx(2 / 61)


def test_raw_query_asks_for_every_document(spark, tmp_path, monkeypatch):
    from aktenwerk.plans import tables

    spark.range(40).selectExpr("id as doc_id", "concat('text ', id) as text").write.parquet(f"file://{tmp_path}/documents.parquet")
    calls, real = [], tables.letter_source.read_raw

    def read_raw(s, ids, store, log, at):
        found = real(s, ids, store, log, at)
        calls.append((ids.count(), s.read.parquet(log).count(), found[0].count(), found[1].count()))
        return found

    monkeypatch.setattr(tables.letter_source, "read_raw", read_raw)
    assert tables.src6_read_raw(spark, f"file://{tmp_path}").count() == 80
    assert calls == [(80, 40, 40, 40)]
