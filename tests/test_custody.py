import hashlib
import json
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from aktenwerk.operators import custody as c
from aktenwerk.operators import gates
from aktenwerk.sources import custody_store as store_of

SCHEMA = "event_id string, event_type string, document_id string, chain_id string, ts timestamp, payload string, serialization_version int"


def events(spark, n, chain="a", payload='{"b": {"z": 1, "a": "ü"}, "a": true, "c": null}'):
    t = datetime(2024, 1, 1)
    return spark.createDataFrame([(f"{chain}{i:04d}", "triage", chain, chain, t + timedelta(seconds=i), payload, 1) for i in range(n)], SCHEMA)


def expected_hashes(rows):
    prev, out = "0" * 64, []
    for i, r in enumerate(rows):
        body = {"event_id": r["event_id"], "event_type": r["event_type"], "document_id": r["document_id"], "payload": json.loads(r["payload"]), "sequence_number": i, "serialization_version": 1, "timestamp": r["ts"].strftime("%Y-%m-%dT%H:%M:%S.%fZ")}
        prev = hashlib.sha256((json.dumps(body, sort_keys=True, separators=(",", ":"), ensure_ascii=False) + prev).encode()).hexdigest()
        out.append(prev)
    return out


def stored(df):
    return df.withColumn("idx", F.col("sequence_number"))


@pytest.mark.parametrize("n", [1, 2, 300])
def test_append_and_verify(spark, n):
    e = events(spark, n)
    chained = c.append_chain(e).orderBy("sequence_number").collect()
    assert [r["event_hash"] for r in chained] == expected_hashes(e.orderBy("ts").collect())
    ok = c.verify_chain(stored(c.append_chain(e))).first()
    assert ok["ok"] and ok["idx"] is None


def test_continue_from_head(spark):
    e = events(spark, 9)
    first = c.append_chain(e.where("event_id < 'a0004'"))
    rest = c.append_chain(e.where("event_id >= 'a0004'"), c.chain_head(first))
    whole = {r["event_id"]: r["event_hash"] for r in c.append_chain(e).collect()}
    assert {r["event_id"]: r["event_hash"] for r in first.unionByName(rest).collect()} == whole


def test_append_collects_no_chain(spark):
    """One long chain beside short ones: rows go one by one, no group of a chain is collected in a row."""
    e = events(spark, 12_000).unionByName(events(spark, 3, "b"))
    chained = c.append_chain(e)
    plan = chained._jdf.queryExecution().executedPlan().toString()
    assert "collect_list" not in plan and "Generate" not in plan
    for chain in "ab":
        own = e.where(F.col("chain_id") == chain)
        got = [r["event_hash"] for r in chained.where(F.col("chain_id") == chain).orderBy("sequence_number").collect()]
        assert got == expected_hashes(own.orderBy("ts").collect())


def first_break(df):
    r = c.verify_chain(df).first()
    return r["idx"], r["reason"]


def test_tampering(spark):
    good = stored(c.append_chain(events(spark, 6))).cache()
    at = lambda k: F.col("idx") == k
    put = lambda col, k, v: good.withColumn(col, F.when(at(k), v).otherwise(F.col(col)))
    assert first_break(put("payload", 3, F.lit("{}"))) == (3, "event hash does not match the recomputed hash")
    assert first_break(put("event_hash", 2, F.lit(None))) == (2, "event carries no chain hash")
    assert first_break(put("payload", 0, F.lit("{}")))[1] == "genesis event does not chain from the all-zero sentinel"
    assert first_break(put("sequence_number", 4, F.lit(9))) == (4, "sequence number is not monotonic")
    assert first_break(put("serialization_version", 1, F.lit(7))) == (1, "unknown serialization version")
    swapped = good.withColumn("idx", F.when(at(2), 3).when(at(3), 2).otherwise(F.col("idx")))
    assert first_break(swapped) == (2, "sequence number is not monotonic")
    assert first_break(good.where("idx <> 2").withColumn("idx", F.when(F.col("idx") > 2, F.col("idx") - 1).otherwise(F.col("idx"))))[0] == 2


def test_tail_right_after_genesis(spark):
    """A tail that starts at number 1 is no break."""
    good = stored(c.append_chain(events(spark, 257)))
    assert c.verify_tail(good, 256).count() == 0
    bad = good.withColumn("payload", F.when(F.col("idx") == 200, "{}").otherwise(F.col("payload")))
    assert [r["idx"] for r in c.verify_tail(bad, 256).collect()] == [200]
    assert c.verify_tail(bad, 10).count() == 0
    c.assert_appendable(good)
    with pytest.raises(ValueError, match="breaks at 200"):
        c.assert_appendable(bad)
    with pytest.raises(ValueError, match="parse"):
        c.assert_appendable(good, spark.createDataFrame([("x",)], "line string"))


def test_delivery_is_fail_closed_and_can_be_repeated(spark, tmp_path):
    e = events(spark, 3).withColumn("event_type", F.lit("briefing_erstellt")).withColumn("document_id", F.col("event_id"))
    b = spark.createDataFrame([("a0000",), ("a0001",), ("a9999",)], "document_id string")
    store, out = f"file://{tmp_path}/store", f"file://{tmp_path}/out"
    for _ in range(2):
        got = store_of.deliver(b, e, store, out)
        assert sorted(r["document_id"] for r in got.collect()) == ["a0000", "a0001"]
    assert spark.read.parquet(store).count() == 3
    spark.read.parquet(store).withColumn("payload", F.lit("{}")).drop("v").write.parquet(f"file://{tmp_path}/bad/v=0")
    with pytest.raises(ValueError, match="verify"):
        store_of.deliver(b, events(spark, 4), f"file://{tmp_path}/bad", f"file://{tmp_path}/none")
    assert not (tmp_path / "none").exists()


def test_payload_gate(spark):
    rows = [
        ("1", "triage", '{"argument_count": 1, "contradiction_detected": true}', None),
        ("2", "triage", '{"argument_count": true}', "wrong_type"),
        ("3", "triage", '{"extra": 1}', "undeclared_key"),
        ("4", "eingang", '{"masked_entity_counts": {"NAME": 1, "X": 2}}', None),
        ("5", "eingang", '{"masked_entity_counts": {"NAME": {"x": 1}}}', "wrong_type"),
        ("6", "eingang", '{"masked_entity_counts": {}}', None),
        ("7", "unbekannt", "{}", "unknown_event_type"),
        ("8", "triage", "kaputt", "not_an_object"),
        (" ", "triage", "{}", "blank_id"),
        ("9", "triage", '{"argument_count": 1.5}', "wrong_type"),
        ("10", "freigabe", '{"a": 1}', "undeclared_key"),
        ("11", "pipeline_fehler", '{"reason": null}', "wrong_type"),
    ]
    e = spark.createDataFrame([(i, t, "d", p) for i, t, p, _ in rows], "event_id string, event_type string, document_id string, payload string")
    good, bad = gates.payload_gate(e)
    assert {r["event_id"] for r in good.collect()} == {i for i, _, _, w in rows if w is None}
    assert {r["event_id"]: r["reason"] for r in bad.collect()} == {i: w for i, _, _, w in rows if w}


def test_delivery_refuses_a_tampered_store_before_it_appends(spark, tmp_path):
    store, out = f"file://{tmp_path}/store", f"file://{tmp_path}/out"
    bad = stored(c.append_chain(events(spark, 5))).withColumn("payload", F.when(F.col("idx") == 4, "{}").otherwise(F.col("payload")))
    bad.write.parquet(f"{store}/v=0")
    more = events(spark, 7).withColumn("event_id", F.concat(F.lit("new"), "event_id"))
    with pytest.raises(ValueError, match="nothing was appended"):
        store_of.deliver(spark.createDataFrame([("a0000",)], "document_id string"), more, store, out)
    assert spark.read.parquet(store).count() == 5 and not (tmp_path / "out").exists()


def test_appends_read_heads_and_tails_only(spark, tmp_path):
    store = f"file://{tmp_path}/store"
    e = events(spark, 40).unionByName(events(spark, 40, "b")).cache()
    for i in range(8):  # chain b gets no events after the second append
        store_of.append(e.where(f"substr(event_id, 2) between {i * 5} and {i * 5 + 4} and (chain_id = 'a' or {i} < 2)"), store, 6)
    assert store_of.versions(spark, store) == list(range(8))
    h = {r["chain_id"]: r for r in store_of.heads(spark, store, 6).collect()}
    assert (h["a"]["sequence_number"], h["b"]["sequence_number"]) == (39, 9)
    assert [x["v"] for x in h["a"]["recent"]] == [6, 7] and [x["v"] for x in h["b"]["recent"]] == [0, 1]
    want = {r["event_id"]: r["event_hash"] for r in c.append_chain(e.where("chain_id = 'a' or event_id < 'b0010'")).collect()}
    assert {r["event_id"]: r["event_hash"] for r in spark.read.parquet(store).collect()} == want
    assert {f.split("/v=")[1][0] for f in store_of.read(spark, store, [6, 7]).inputFiles()} == {"6", "7"}
    assert c.verify_chain(spark.read.parquet(store)).where("not ok").count() == 0


def test_heads_are_computed_where_a_writer_ended_early(spark, tmp_path):
    store = f"file://{tmp_path}/store"
    e = events(spark, 9)
    store_of.append(e.where("event_id < 'a0003'"), store)
    staged = store_of.stage(e.where("event_id < 'a0006'"), store)
    assert store_of._rename(spark, staged.path, f"{store}/v=1")  # and no heads
    assert store_of.heads(spark, store).first()["sequence_number"] == 5
    store_of.append(e, store)
    assert spark.read.parquet(store).count() == 9 and c.verify_chain(spark.read.parquet(store)).first()["ok"]
    assert store_of.append(e, store).count() == 9 and store_of.versions(spark, store) == [0, 1, 2]


def test_head_and_store_must_agree(spark, tmp_path):
    store = f"file://{tmp_path}/store"
    e = events(spark, 6)
    store_of.append(e.where("event_id < 'a0003'"), store)
    store_of.append(e.where("event_id < 'a0005'"), store)
    import shutil

    shutil.rmtree(tmp_path / "store" / "v=1")  # the last segment is lost, its heads aren't
    with pytest.raises(ValueError, match="nothing was appended"):
        store_of.append(e, store)
    assert spark.read.parquet(store).count() == 3


def test_concurrent_append_is_repeated_behind_the_other(spark, tmp_path, monkeypatch):
    store = f"file://{tmp_path}/store"
    e = events(spark, 6)
    store_of.append(e.where("event_id < 'a0002'"), store)
    real, calls = store_of.stage, []

    def stage(events, where, k=256):
        staged = real(events, where, k)
        if not calls:  # another writer comes in between
            calls.append(1)
            store_of.publish(spark, real(e.where("event_id = 'a0002'"), where, k))
        return staged

    monkeypatch.setattr(store_of, "stage", stage)
    got = store_of.append(e, store)
    assert got.count() == 6 and c.verify_chain(got).first()["ok"] and store_of.versions(spark, store) == [0, 1, 2]
    assert not [p for p in (tmp_path / "store" / "_staged").iterdir() if not p.name.startswith(".")]
    late = store_of.Staged(store, 1, real(events(spark, 9), store).path, None, 256)
    with pytest.raises(store_of.ConcurrentAppend):
        store_of.publish(spark, late)
    assert not store_of._rename(spark, f"{store}/v=1", f"{store}/v=2") and spark.read.parquet(store).count() == 6


def test_tail_of_neighbouring_faults(spark, tmp_path):
    """WIN-4's query and its SQL where faulty events follow each other: any two of altered, missing, misnumbered and sound."""
    import datetime as dt

    import duckdb

    from aktenwerk.plans.queries import QUERIES, SQL

    kinds, rows, at = (5, 6, 7, 8), [], dt.datetime(2024, 1, 1)
    for user, (a, b) in enumerate((a, b) for a in kinds for b in kinds):
        ids = [100 + user, 997 * (2 * user + 1) + a, 997 * (2 * user + 2) + b, 200 + user]
        rows += [(i, at + dt.timedelta(seconds=k), user, "click", 1.0, '{"k": 1}') for k, i in enumerate(ids)]
        rows += [(i, at + dt.timedelta(seconds=k), 100 + user, "click", 1.0, '{"k": 1}') for k, i in enumerate([i + 997 * 1000 for i in ids[1:3]])]
    path = f"{tmp_path}/events.parquet"
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").coalesce(1).write.parquet(path)
    c = duckdb.connect()
    c.execute(f"create view events as select * from '{path}/*.parquet'")
    for name in ("win4_verify_tail", "chn4_refused_chains"):
        assert sorted(map(tuple, QUERIES[name](spark, str(tmp_path)).collect())) == sorted(c.execute(SQL[name]).fetchall())
