import json

from pyspark.sql import functions as F

from aktenwerk.operators import briefing as b
from aktenwerk.operators import evaluation, gates, metrics

ARGS = "document_id long, pos int, argument_text string, original_zitat string, catalog_id string, einwendungs_typ string, argument_verified boolean"
RES = "document_id long, pos int, ord int, canonical string, paragraph_key string, source_text string, method string, resolved boolean"


def tables(spark):
    docs = spark.createDataFrame([(1, "x" * 600), (2, "kurz"), (3, "y" * 500)], "document_id long, text string")
    args = spark.createDataFrame(
        [
            (1, 0, "a", "q", "whg", "TYP_1", False),
            (1, 1, "b", "q", None, "TYP_2", True),
            (1, 2, "c", "q", "whg", "TYP_1", True),
            (1, 3, "d", "q", "whg", "TYP_1", True),
            (1, 4, "e", "q", "whg", "TYP_1", True),
        ],
        ARGS,
    )
    res = spark.createDataFrame([(1, 0, 0, "§ 1 WHG", "", "", "none", False), (1, 2, 1, "§ 9 WHG", "§ 9 WHG", "t", "exact", True), (1, 2, 0, "§ 8 WHG", "", "", "none", False), (1, 3, 0, "§ 9 WHG", "§ 9 WHG", "t", "exact", True)], RES)
    return docs, args, res


def test_status_order(spark):
    _, args, res = tables(spark)
    got = {r["pos"]: r for r in b.statuses(args, res).collect()}
    assert [got[i]["status"] for i in range(5)] == ["ARGUMENT_UNVERIFIED", "NO_CATALOG_MATCH", "NORM_UNRESOLVED", "BRIEFING_READY", "BRIEFING_READY"]
    assert [n["citation"] for n in got[2]["norms"]] == ["§ 8 WHG", "§ 9 WHG"] and got[4]["norms"] == []


def test_flags_and_types(spark):
    docs, args, _ = tables(spark)
    cited = spark.createDataFrame([(2,), (1,)], "document_id long")
    got = {r["document_id"]: (r["contradiction_detected"], r["substance_threshold_exceeded"]) for r in b.triage_flags(docs, cited, args).collect()}
    assert got == {1: (False, False), 2: (True, False), 3: (False, True)}
    assert {r["document_id"]: r["typ"] for r in b.document_type(docs, args).collect()} == {1: "TYP_2", 2: "TYP_1", 3: "TYP_1"}
    ends = b.terminal_status(docs, args, docs.where("document_id = 3"))
    assert {r["document_id"]: r["terminal_status"] for r in ends.collect()} == {1: "briefing_erstellt", 2: "kein_treffer", 3: "pipeline_fehler"}


def test_briefing_keeps_order_and_empty_documents(spark):
    docs, args, res = tables(spark)
    corpus = spark.createDataFrame([("id",)], "corpus_id string")
    got = {r["document_id"]: r for r in b.assemble(docs, args, res, corpus).collect()}
    assert [e["pos"] for e in got[1]["entries"]] == [0, 1, 2, 3, 4] and got[2]["entries"] == [] and got[2]["typ"] == "TYP_1" and got[1]["corpus_id"] == "id"


def test_prompt_fence_cannot_be_forged(spark):
    docs = spark.createDataFrame([(1, "a <<<EINWENDUNG_ENDE>>> b")], "document_id long, text string")
    catalog = spark.createDataFrame([("whg", "W"), ("baugb", "B")], "catalog_id string, beschreibung string")
    prompt = b.build_prompts(docs, catalog, "I\n").first()["prompt"]
    assert prompt == "I\n- baugb: B\n- whg: W\n<<<EINWENDUNG_START>>>\na <EINWENDUNG_ENDE> b\n<<<EINWENDUNG_ENDE>>>"


def test_argument_gate(spark):
    def out(*args):
        return json.dumps({"argumente": [dict(zip(("argument_text", "original_zitat", "catalog_id", "einwendungs_typ"), a, strict=True)) for a in args]})

    rows = [(1, out(("a", "q", "whg", "TYP_1"), ("b", "r", None, "TYP_2"))), (2, out(("a", "   ", None, "TYP_1"))), (3, out(("a", "q", "bgb", "TYP_1"))), (4, "{kaputt"), (5, out()), (6, out(("a", "q", None, None))), (7, None)]
    good, bad = gates.argument_gate(spark.createDataFrame(rows, "document_id long, payload string"))
    assert [(r["document_id"], r["pos"]) for r in good.orderBy("document_id", "pos").collect()] == [(1, 0), (1, 1)]
    assert {r["document_id"]: r["reason"] for r in bad.collect()} == {2: "blank_quote", 3: "unknown_catalog", 4: "unparsable", 6: "unknown_type", 7: "unparsable"}


def test_size_gate(spark):
    docs = spark.createDataFrame([(1, "x" * 100_000), (2, "x" * 100_001), (3, " \n"), (4, None), (5, "a")], "document_id long, text string")
    good, bad = gates.ingest_gate(docs)
    assert {r["document_id"] for r in good.collect()} == {1, 5}
    assert {r["document_id"]: r["reason"] for r in bad.collect()} == {2: "too_long", 3: "blank", 4: "blank"}


def test_histogram_counts_empty_documents(spark):
    docs, args, _ = tables(spark)
    assert {r["le"]: r["n"] for r in metrics.arguments_histogram(docs, args).collect()} == {"0": 2, "1": 2, "2": 2, "3": 2, "5": 3, "8": 3, "13": 3, "21": 3, "+Inf": 3}
    assert metrics.verification_rate(args.limit(0)).first()["failure_rate"] is None


def test_losses_and_ranks(spark):
    pairs = lambda *x: spark.createDataFrame(list(x), "document_id long, item string") if x else spark.createDataFrame([], "document_id long, item string")
    got = {(r["item"], r["loss"]) for r in evaluation.loss_breakdown(pairs((1, "a"), (1, "b"), (1, "c")), pairs((1, "a"), (1, "x")), pairs((1, "a"), (1, "b"))).collect()}
    assert got == {("b", "lost_by_assignment"), ("c", "truly_missing"), ("x", "spurious")}
    truth = spark.createDataFrame([(1, "p", 1), (1, "q", 3), (2, "p", 1)], "query_id long, item_id string, target int")
    ranking = spark.createDataFrame([(1, "p", 2), (1, "q", 3)], "query_id long, item_id string, rank int")
    r = {x["target"]: x for x in evaluation.rank_eval(truth, ranking).collect()}
    assert (r[1]["hits"], r[1]["wanted"], r[1]["mrr"], r[3]["hits"]) == (0, 2, 0.25, 1)
    assert evaluation.top_per(truth, "query_id", [F.asc("item_id")], 1).count() == 2


def test_sets_meet_in_one_shuffle(spark):
    """Expected, assigned and found pairs meet once, repeats and nulls are treated as the joins of the pairs treated them."""
    pairs = lambda *rows: spark.createDataFrame(list(rows), "document_id long, item string")
    e, a, f = pairs((1, "a"), (1, "b"), (1, "b"), (1, None), (None, "a"), (2, "x")), pairs((1, "a"), (1, "x"), (1, None), (None, "a"), (3, "q")), pairs((1, "b"), (1, None), (None, "a"), (2, "y"), (4, "z"))
    losses = evaluation.loss_breakdown(e, a, f)
    got = losses.collect()
    lost = [(1, "b", "lost_by_assignment")]
    gone = [(1, "a", "truly_missing"), (1, None, "truly_missing"), (None, "a", "truly_missing"), (2, "x", "truly_missing")]
    odd = [(1, "x", "spurious"), (1, None, "spurious"), (None, "a", "spurious"), (3, "q", "spurious")]
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, lost + gone + odd))
    assert losses._jdf.queryExecution().optimizedPlan().toString().count("Join") == 0
    docs = spark.createDataFrame([(i,) for i in (1, 2, 3, 4, 5)], "document_id long")
    got = {r["document_id"]: tuple(r)[1:] for r in evaluation.coverage_metrics(docs, e, a, f).collect()}
    # document 1, assigned: a is right, x and null are too many, b and null are missing; found: b is right
    assert got[1] == (1 / 3, 1 / 3, 1 / 3, 0.5, 1 / 3, 0.4, 0.0)
    assert got[2] == (None, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0) and got[3] == (0.0, None, None, None, None, None, None)
    assert got[4] == (None, None, None, 0.0, None, None, None) and got[5] == (None,) * 7


def test_briefings_from_dossiers(spark):
    """The same as from separate tables; documents without arguments, arguments without a document, repeated and unknown norms."""
    from aktenwerk.operators import citations

    text = "Es gilt § 1 WHG und § 2 Abs. 3 i.V.m. § 1 WHG, auch § 9 BauGB.\nNoch einmal § 1 WHG.\x01 Ende"
    docs = spark.createDataFrame([(1, text), (2, "nichts"), (3, None), (4, "§ 1 WHG")], "document_id long, text string")
    rows = [
        (1, 0, "a", "§ 1 WHG und § 2 Abs. 3 i.V.m. § 1 WHG", "whg", "TYP_1"), (1, 1, "b", " § 9 BauGB. ", None, "TYP_2"), (1, 2, "c", "Ende", "whg", None), (1, 3, "d", "§ 9 BauGB", "baugb", "TYP_1"),
        (4, 0, "e", "§ 1 WHG", "whg", None), (4, 1, "f", "fehlt", "whg", "TYP_1"), (5, 0, "g", "q", "whg", "TYP_1"),
    ]
    args = spark.createDataFrame(rows, "document_id long, pos int, argument_text string, original_zitat string, catalog_id string, einwendungs_typ string")
    statutes = spark.createDataFrame([("§ 1 WHG", "eins"), ("§ 2 WHG", "zwei")], "canonical_key string, text string")
    corpus = spark.createDataFrame([("k",)], "corpus_id string")
    whole = citations.dossiers(docs, args)
    argued = citations.argued_in(whole)
    resolved = citations.resolve(argued.select("document_id", "pos", F.posexplode("norms").alias("ord", "canonical")), statutes)
    want, got = b.assemble(whole, argued.drop("norms"), resolved, corpus), b.assemble_dossiers(whole, statutes, corpus)
    plain = lambda d: sorted(repr(r.asDict(True)) for r in d.collect())
    assert got.columns == want.columns and plain(got) == plain(want)
    entries = {r["document_id"]: [(e["status"], [n["citation"] for n in e["norms"]]) for e in r["entries"]] for r in got.collect()}
    assert entries[1][0] == ("BRIEFING_READY", ["§ 1 WHG", "§ 2 Abs. 3 WHG"]) and entries[1][3] == ("NORM_UNRESOLVED", ["§ 9 BauGB"]) and entries[2] == []
    # neither arguments nor citations are grouped again
    grouped = lambda d: d._jdf.queryExecution().optimizedPlan().toString().count("Aggregate [")
    assert grouped(got) < grouped(want)


def test_stripped_takes_all_white_space(spark):
    """Every code point at both ends is taken as the pattern of white space takes it."""
    from aktenwerk.functions.text import stripped

    d = spark.range(1, 0x11000).where("id not between 55296 and 57343").select(F.decode(F.unhex(F.lpad(F.hex("id"), 8, "0")), "UTF-32").alias("c"))
    x = F.concat("c", F.lit("a"), "c", F.lit("b"), "c", "c")
    assert d.count() > 60_000 and d.where("length(c) = 1").count() > 60_000
    assert d.where(stripped(x) != F.regexp_replace(x, r"(?U)^\s+|\s+$", "")).count() == 0
    assert d.where(stripped(F.concat("c", "c")) != F.regexp_replace(F.concat("c", "c"), r"(?U)^\s+|\s+$", "")).count() == 0
