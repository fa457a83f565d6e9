from datetime import datetime, timedelta

from pyspark.sql import functions as F

from aktenwerk.operators import custody
from aktenwerk.streaming import jobs

EVENTS = "event_id string, event_type string, document_id string, chain_id string, ts timestamp, payload string, serialization_version int"
T = datetime(2024, 1, 1)


def batch(spark, path, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)


END = ("end", "triage", "end", "end", T + timedelta(days=400), "{}", 1)  # lets all that waits leave


def test_chain_goes_on_over_triggers(spark, tmp_path):
    src, out, state = (f"file://{tmp_path}/{n}" for n in ("src", "out", "state"))
    rows = [(f"{c}{i:03d}", "triage", c, c, T + timedelta(seconds=i), '{"argument_count": %d}' % i, 1) for i in range(6) for c in "ab"]
    late = rows[2:4]  # these come a trigger late, within the delay
    for part in (rows[:2] + rows[4:8], [*late, *rows[8:], END]):
        batch(spark, src, part, EVENTS)
        stream = spark.readStream.schema(spark.read.parquet(src).schema).parquet(src)
        jobs.run_available(jobs.chain(stream), out, state)
    got = {(r["chain_id"], r["event_id"]): (r["sequence_number"], r["event_hash"]) for r in spark.read.parquet(out).collect()}
    want = custody.append_chain(spark.createDataFrame(rows, EVENTS)).collect()
    assert got == {(r["chain_id"], r["event_id"]): (r["sequence_number"], r["event_hash"]) for r in want}


def test_ids_and_payloads_may_hold_the_mark_of_the_number(spark, tmp_path):
    src, out, state = (f"file://{tmp_path}/{n}" for n in ("src", "out", "state"))
    rows = [(f"#sequence#{i}", "triage", "#sequence#", "a", T + timedelta(seconds=i), '{"x": "#sequence#", "y": "\\"sequence_number\\":#sequence#,"}', 1) for i in range(4)]
    batch(spark, src, [*rows, END], EVENTS)
    jobs.run_available(jobs.chain(spark.readStream.schema(spark.read.parquet(src).schema).parquet(src)), out, state)
    got = {r["event_id"]: (r["sequence_number"], r["event_hash"]) for r in spark.read.parquet(out).collect()}
    want = custody.append_chain(spark.createDataFrame(rows, EVENTS)).collect()
    assert got == {r["event_id"]: (r["sequence_number"], r["event_hash"]) for r in want}


def test_long_chain_leaves_in_steps(spark, tmp_path):
    """A trigger's events of one chain leave in steps, in order, and the state goes on after them."""
    src, out, state = (f"file://{tmp_path}/{n}" for n in ("src", "out", "state"))
    rows = [(f"a{i:03d}", "triage", "a", "a", T + timedelta(seconds=i * 37 % 50), "{}", 1) for i in range(50)]
    for part in ([r for r in rows if r[4] < T + timedelta(seconds=30)], [*(r for r in rows if r[4] >= T + timedelta(seconds=30)), END]):
        batch(spark, src, part, EVENTS)
        jobs.run_available(jobs.chain(spark.readStream.schema(spark.read.parquet(src).schema).parquet(src), step=7), out, state)
    got = {r["event_id"]: (r["sequence_number"], r["event_hash"]) for r in spark.read.parquet(out).collect()}
    want = custody.append_chain(spark.createDataFrame(rows, EVENTS)).collect()
    assert got == {r["event_id"]: (r["sequence_number"], r["event_hash"]) for r in want}


def test_events_behind_the_watermark_are_appended(spark, tmp_path):
    src, out, state = (f"file://{tmp_path}/{n}" for n in ("src", "out", "state"))
    event = lambda i, hours: (f"e{i}", "triage", "a", "a", T + timedelta(hours=hours), "{}", 1)
    none = [("x", "triage", "a", None, T, "{}", 1), ("y", "triage", "a", "a", None, "{}", 1)]
    for part in ([event(0, 0), event(1, 5)], [event(2, 10), *none], [event(3, 1), END]):
        batch(spark, src, part, EVENTS)
        jobs.run_available(jobs.chain(spark.readStream.schema(spark.read.parquet(src).schema).parquet(src)), out, state)
    rows = sorted(spark.read.parquet(out).collect(), key=lambda r: r["sequence_number"])
    # e0 and e1 had left when e3 came, e2 hadn't
    assert [r["event_id"] for r in rows] == ["e0", "e1", "e3", "e2"] and [r["sequence_number"] for r in rows] == [0, 1, 2, 3]


def test_alerts_drop_late_rows(spark, tmp_path):
    src, out, state = (f"file://{tmp_path}/{n}" for n in ("src", "out", "state"))
    schema = "ts timestamp, unresolved long, citations long, failures long, arguments long, failed_writes long"
    batches = [[(T, 3, 10, 0, 0, 0), (T + timedelta(hours=5), 0, 1, 1, 5, 1)], [(T + timedelta(minutes=1), 9, 9, 0, 0, 0), (T + timedelta(hours=9), 0, 1, 0, 0, 0)]]
    for part in batches:
        batch(spark, src, part, schema)
        jobs.run_available(jobs.alerts(spark.readStream.schema(spark.read.parquet(src).schema).parquet(src)), out, state)
    got = {r["window_start"]: r for r in spark.read.parquet(out).collect()}
    first = got[T]
    assert (first["unresolved_ratio"], first["unresolved_alert"], first["failure_rate"], first["verification_alert"], first["audit_alert"]) == (0.3, True, None, False, False)
    second = got[T + timedelta(hours=5)]
    assert second["verification_alert"] and second["audit_alert"] and not second["unresolved_alert"]


def test_ingestion_refuses_masks_and_extracts(spark, tmp_path):
    src, out, state = (f"file://{tmp_path}/{n}" for n in ("src", "out", "state"))
    letter = "Einreicher: Dr. Erika Muster, Kiel\nTelefon: 0431 1234567\n\nIch berufe mich auf § 1 WHG und a.b@example.org.\n\nMit freundlichen Grüßen\nErika Muster"
    rows = [(1, letter), (2, " "), (3, "x" * 100_001), (4, None), (5, "§ 2 WHG"), (5, "§ 2 WHG")]
    for part in (rows[:2], rows[2:]):  # two triggers; repeated rows are rows
        batch(spark, src, part, "document_id long, text string")
        jobs.run_available(jobs.ingest(spark.readStream.schema("document_id long, text string").parquet(src)), out, state)
    got = sorted(spark.read.parquet(out).collect(), key=lambda r: r["document_id"])
    assert [(r["document_id"], r["n_chars"], [c["canonical"] for c in r["citations"]], r["entity_counts"]) for r in got] == [
        (1, len(letter), ["§ 1 WHG"], {"NAME": 2, "TELEFON": 1, "EMAIL": 1}), (5, 7, ["§ 2 WHG"], {}), (5, 7, ["§ 2 WHG"], {}),
    ]
    clean = got[0]["clean_text"]
    assert clean == letter.replace("Erika Muster", "[NAME]").replace("0431 1234567", "[TELEFON]").replace("a.b@example.org", "[EMAIL]")
    start = got[0]["citations"][0]["start"]
    assert clean[start:].startswith("§ 1 WHG")  # positions are those of the masked text


def test_masking_in_rows_is_masking_by_joins(spark):
    from aktenwerk.operators import masking

    rows = [(i, t) for i, t in enumerate([None, "", "Einreicher: Hans Kurz, X\n\nHans Kurz ruft 0171 555666 an.\n\nMit freundlichen Grüßen\nHans Kurz\n", "Kurz: a@b.de a@c.de  DE89370400440532013000", "vertreten durch: Dr. Ute Lang, Amt\nUte Lang Lang\n\n" * 3])]
    docs = spark.createDataFrame(rows, "document_id long, text string")
    z = masking.extract_zones(docs)
    joined = masking.mask(masking.merge_regions(z, masking.all_spans(masking.detect_pii(docs), masking.anchor_spans(z))))
    columns = ("document_id", "regions", "clean_text", "entity_counts")
    assert sorted(map(repr, masking.masked_documents(docs).select(*columns).collect())) == sorted(map(repr, joined.select(*columns).collect()))
    assert "Exchange" not in masking.masked_documents(docs)._jdf.queryExecution().executedPlan().toString()


def test_repeated_events(spark, tmp_path):
    src, out, state = (f"file://{tmp_path}/{n}" for n in ("src", "out", "state"))
    batch(spark, src, [("a", T), ("a", T + timedelta(minutes=5)), ("b", T)], "event_id string, ts timestamp")
    jobs.run_available(jobs.distinct_events(spark.readStream.schema("event_id string, ts timestamp").parquet(src)), out, state)
    assert sorted(r["event_id"] for r in spark.read.parquet(out).collect()) == ["a", "b"]
