"""Queries over events, documents, embeddings and statutes: custody chains, logs, metrics, ranking, sources, streams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from aktenwerk.operators.ranking import FUSION
from aktenwerk.functions.shared import new_path, stored
from aktenwerk.operators import briefing, citations, custody, gates, logs, masking, metrics, ranking
from aktenwerk.plans import corpus
from aktenwerk.plans.corpus import SQL_LETTERS, SQL_LINES, SQL_STATUTES, table
from aktenwerk.plans.letters import _cited, _dossiers, _resolutions, _rounded
from aktenwerk.sources import custody_store
from aktenwerk.sources import letters as letter_source
from aktenwerk.sources import statutes as statute_source
from aktenwerk.streaming import jobs

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# --- custody chains: one chain a user ---------------------------------------------------------------------------

SQL_CHAIN = """
numbered AS (
  SELECT event_id, event_type, user_id, ts, props, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id::VARCHAR) - 1 AS seq FROM events
), canon AS (
  SELECT *, '{"document_id":"' || user_id || '","event_id":"' || event_id || '","event_type":"' || event_type || '","payload":{"k":' || (props::JSON ->> 'k') || '},"sequence_number":' || seq ||
    ',"serialization_version":1,"timestamp":"' || strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') || 'Z"}' AS c FROM numbered
), chain AS (
  SELECT user_id, seq, event_id, sha256(c || repeat('0', 64)) AS h FROM canon WHERE seq = 0
  UNION ALL SELECT canon.user_id, canon.seq, canon.event_id, sha256(canon.c || chain.h) FROM canon JOIN chain ON canon.user_id = chain.user_id AND canon.seq = chain.seq + 1
)"""


@query("SELECT event_id::VARCHAR AS event_id, user_id::VARCHAR AS chain_id, (row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id::VARCHAR) - 1)::BIGINT AS sequence_number FROM events")
def win2_number_events(s: SparkSession, d: str) -> DataFrame:
    return custody.number_events(corpus.custody(s, d)).select("event_id", "chain_id", "sequence_number")


@query(f"WITH RECURSIVE {SQL_CHAIN} SELECT event_id::VARCHAR AS event_id, sha256(c) AS canonical FROM canon")
def chn3_canonical_bytes(s: SparkSession, d: str) -> DataFrame:
    e = custody.number_events(corpus.custody(s, d))
    return e.select("event_id", F.sha2(custody.canonical_text(e), 256).alias("canonical"))


@query(f"WITH RECURSIVE {SQL_CHAIN} SELECT user_id::VARCHAR AS chain_id, event_id::VARCHAR AS event_id, seq AS sequence_number, h AS event_hash FROM chain")
def chn1_append_chain(s: SparkSession, d: str) -> DataFrame:
    return custody.append_chain(corpus.custody(s, d)).select("chain_id", "event_id", "sequence_number", "event_hash")


@query(f"WITH RECURSIVE {SQL_CHAIN} SELECT user_id::VARCHAR AS chain_id, event_id::VARCHAR AS event_id, seq AS sequence_number, h AS event_hash FROM chain")
def chn1_append_continued(s: SparkSession, d: str) -> DataFrame:
    """The same chains appended in two batches: the first half of January, then the rest from the stored heads."""
    e = corpus.custody(s, d)
    first = custody.append_chain(e.where("ts < timestamp'2024-01-16'"))
    rest = custody.append_chain(e.where("ts >= timestamp'2024-01-16'"), custody.chain_head(first))
    return first.unionByName(rest).select("chain_id", "event_id", "sequence_number", "event_hash")


def _tampered(s: SparkSession, d: str) -> DataFrame:
    c = custody.append_chain(corpus.custody(s, d)).withColumn("idx", F.col("sequence_number"))
    n = F.col("event_id").cast("long") % 997
    c = c.withColumn("event_hash", F.when(n == 5, F.sha2(F.col("event_hash"), 256)).when(n == 6, None).otherwise(F.col("event_hash")))
    return c.withColumn("sequence_number", F.when(n == 7, F.col("sequence_number") + 1).otherwise(F.col("sequence_number")))


SQL_BREAKS = """numbered AS (SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id::VARCHAR) - 1 AS idx, event_id % 997 AS n FROM events
), w AS (SELECT *, lag(n) OVER (PARTITION BY user_id ORDER BY idx) AS before FROM numbered
), broken AS (
  SELECT user_id, idx, CASE WHEN n = 7 THEN 'sequence number is not monotonic' WHEN n = 6 THEN 'event carries no chain hash' WHEN n = 5 AND idx = 0 THEN 'genesis event does not chain from the all-zero sentinel'
    ELSE 'event hash does not match the recomputed hash' END AS reason FROM w WHERE n IN (5, 6, 7) OR before IN (5, 6))"""


@query(f"WITH {SQL_BREAKS} SELECT user_id::VARCHAR AS chain_id, idx, reason FROM broken")
def chn2_chain_breaks(s: SparkSession, d: str) -> DataFrame:
    return custody.chain_breaks(_tampered(s, d)).select("chain_id", "idx", "reason")


@query(f"WITH {SQL_BREAKS}, f AS (SELECT user_id, min(idx) AS idx, arg_min(reason, idx) AS reason FROM broken GROUP BY 1) SELECT u.user_id::VARCHAR AS chain_id, f.idx IS NULL AS ok, coalesce(f.idx, -1) AS idx, f.reason FROM (SELECT DISTINCT user_id FROM events) u LEFT JOIN f USING (user_id)")
def chn2_verify_chain(s: SparkSession, d: str) -> DataFrame:
    return custody.verify_chain(_tampered(s, d)).fillna(-1, ["idx"]).select("chain_id", "ok", "idx", "reason")


@query(f"WITH {SQL_BREAKS} SELECT user_id::VARCHAR AS chain_id, min(idx) AS idx, arg_min(reason, idx) AS reason FROM broken GROUP BY 1")
def win3_first_breaks(s: SparkSession, d: str) -> DataFrame:
    return custody.first_breaks(custody.chain_breaks(_tampered(s, d))).select("chain_id", "idx", "reason")


@query(f"""WITH {SQL_BREAKS}, last AS (SELECT user_id, max(idx) AS top FROM numbered GROUP BY 1
), s AS (SELECT *, idx + (n = 7)::BIGINT AS stored, coalesce(lag(idx + (n = 7)::BIGINT) OVER (PARTITION BY user_id ORDER BY idx), -1) + 1 AS expected FROM w
), r AS (SELECT user_id, idx, CASE WHEN stored <> expected THEN 'sequence number is not monotonic' WHEN n = 6 THEN 'event carries no chain hash' WHEN n IN (5, 7) OR before IN (5, 6) THEN 'event hash does not match the recomputed hash' END AS reason FROM s)
SELECT user_id::VARCHAR AS chain_id, idx, reason FROM r JOIN last USING (user_id) WHERE reason IS NOT NULL AND idx > top - 40""")
def win4_verify_tail(s: SparkSession, d: str) -> DataFrame:
    """The last 40 events of each chain; the event after a wrong number is out of step with it too, whatever else is wrong with it,
    and of two wrong numbers in a row the second is in step, but its hash isn't that of its text."""
    return custody.verify_tail(_tampered(s, d), 40).select("chain_id", "idx", "reason")


@query("WITH n AS (SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id::VARCHAR) - 1 AS idx FROM events) SELECT user_id::VARCHAR AS chain_id, idx, idx - 1 AS prev_sequence FROM n WHERE idx > 0 UNION ALL SELECT user_id::VARCHAR, idx, -1 FROM n WHERE idx = 0")
def jon6_with_predecessor(s: SparkSession, d: str) -> DataFrame:
    c = custody.append_chain(corpus.custody(s, d)).withColumn("idx", F.col("sequence_number"))
    return custody.with_predecessor(c).fillna(-1, ["prev_sequence"]).select("chain_id", "idx", "prev_sequence")


@query(f"WITH RECURSIVE {SQL_CHAIN} SELECT user_id::VARCHAR AS chain_id, arg_max(h, seq) AS event_hash, max(seq) AS sequence_number FROM chain GROUP BY 1")
def agg26_chain_head(s: SparkSession, d: str) -> DataFrame:
    return custody.chain_head(custody.append_chain(corpus.custody(s, d)))


@query("SELECT event_id::VARCHAR AS event_id, ts FROM events WHERE user_id = 8 AND event_type = 'error' AND ts >= TIMESTAMP '2024-01-05' AND ts <= TIMESTAMP '2024-01-25'")
def flt5_audit_query(s: SparkSession, d: str) -> DataFrame:
    e = table(s, d, "events").withColumn("document_id", F.col("user_id"))
    at = lambda x: F.lit(x).cast("timestamp_ntz")
    return gates.audit_query(e, document_id=8, event_type="error", after=at("2024-01-05"), before=at("2024-01-25")).select(F.col("event_id").cast("string").alias("event_id"), "ts")


@query("""SELECT event_id::VARCHAR AS event_id, CASE event_id % 6 WHEN 1 THEN 'argument_count' WHEN 2 THEN 'extra' WHEN 4 THEN 'masked_entity_counts' END AS key,
  CASE event_id % 6 WHEN 1 THEN 'wrong_type' WHEN 2 THEN 'undeclared_key' WHEN 4 THEN 'wrong_type' WHEN 5 THEN 'unknown_event_type' END AS reason FROM events WHERE event_id % 6 IN (1, 2, 4, 5)""")
def flt4_payload_gate(s: SparkSession, d: str) -> DataFrame:
    k = F.col("event_id") % 6
    payload = F.when(k == 0, '{"argument_count": 3, "contradiction_detected": false}').when(k == 1, '{"argument_count": true}').when(k == 2, '{"argument_count": 1, "extra": "x"}')
    payload = payload.when(k == 3, '{"document_id": "a", "masked_entity_counts": {"NAME": 2}}').when(k == 4, '{"masked_entity_counts": {"NAME": "two"}}').otherwise("{}")
    kind = F.when(k < 3, "triage").when(k < 5, "eingang").otherwise("click")
    e = table(s, d, "events").select(F.col("event_id").cast("string").alias("event_id"), kind.alias("event_type"), F.col("user_id").cast("string").alias("document_id"), payload.alias("payload"))
    return gates.payload_gate(e)[1]


def _stages(s: SparkSession, d: str) -> DataFrame:
    o = table(s, d, "orders").select(F.col("o_orderkey").cast("string").alias("document_id"), (F.col("o_orderkey") % 10).alias("k"), F.col("o_orderdate").cast("timestamp").alias("t"))
    end = F.when(F.col("k") == 1, "kein_treffer").when(F.col("k") == 2, "pipeline_fehler").otherwise("briefing_erstellt")
    rows = F.array(*(F.struct(F.lit(n).alias("n"), x.alias("event_type")) for n, x in ((0, F.lit("eingang")), (1, F.lit("triage")), (2, F.lit("retrieval")), (3, end))))
    x = o.select("document_id", "k", "t", F.explode(rows).alias("r")).select("document_id", "k", "t", "r.*")
    x = x.where(~((F.col("k") == 3) & (F.col("n") == 1)) & ~((F.col("k") == 4) & (F.col("n") == 3)))
    n = F.when((F.col("k") == 5) & (F.col("n") == 2), 4).otherwise(F.col("n"))
    return x.select("document_id", "event_type", F.concat_ws("-", "document_id", "n").alias("event_id"), F.timestamp_seconds(F.unix_timestamp("t") + n).alias("ts"))


@query("""SELECT o_orderkey::VARCHAR AS document_id, CASE o_orderkey % 10 WHEN 3 THEN 'stages_out_of_order' WHEN 4 THEN 'no_terminal_event' WHEN 5 THEN 'no_terminal_event' END AS gap FROM orders WHERE o_orderkey % 10 IN (3, 4, 5)
UNION ALL SELECT o_orderkey::VARCHAR, 'briefing_without_event' FROM orders WHERE o_orderkey % 10 IN (2, 4)""")
def win6_custody_gaps(s: SparkSession, d: str) -> DataFrame:
    return custody.custody_gaps(_stages(s, d), table(s, d, "orders").select(F.col("o_orderkey").cast("string").alias("document_id")))


@query(f"""WITH {SQL_LETTERS}, {SQL_STATUTES}, n AS (SELECT document_id, count(*) AS n FROM lines GROUP BY 1
), r AS (SELECT document_id, count(*) AS r FROM (SELECT document_id, ord, '§ ' || sec || ' ' || law AS k FROM lines WHERE quoted UNION ALL SELECT document_id, ord, '§ ' || sec2 || ' ' || law FROM lines WHERE quoted AND sec2 IS NOT NULL AND linked <> prim) JOIN statutes ON canonical_key = k GROUP BY 1)
SELECT document_id::VARCHAR AS document_id, unnest(['eingang', 'triage', 'retrieval', CASE WHEN n > 0 THEN 'briefing_erstellt' ELSE 'kein_treffer' END]) AS event_type,
  unnest(['{{"document_id":"' || document_id || '","masked_entity_counts":{{"EMAIL":1,"NAME":2,"TELEFON":1}}}}', '{{"argument_count":' || coalesce(n, 0) || ',"contradiction_detected":false,"substance_threshold_exceeded":false}}',
    '{{"resolved_norm_count":' || coalesce(r, 0) || '}}', '{{"entry_count":' || coalesce(n, 0) || '}}']) AS payload FROM letters LEFT JOIN n USING (document_id) LEFT JOIN r USING (document_id)""")
def chn5_pipeline_events(s: SparkSession, d: str) -> DataFrame:
    docs, a = stored(corpus.letters(s, d), "letters"), corpus.arguments(s, d)
    whole = stored(citations.dossiers(docs, a).drop("text"), "dossiers")
    flags = briefing.triage_flags(docs, citations.cited_in(whole), a)
    masked = masking.masked_documents(docs).select("document_id", "entity_counts")
    e = custody.pipeline_events(masked, flags, a, _resolutions(s, d, citations.argued_in(whole)), briefing.terminal_status(docs, a), F.lit("2024-01-01").cast("timestamp"))
    return e.select("document_id", "event_type", "payload")


@query(f"""WITH {SQL_LINES}, k AS (SELECT document_id, count(*) AS n FROM lines GROUP BY 1) SELECT o_orderkey AS document_id, coalesce(n, 0) AS entries FROM orders LEFT JOIN k ON document_id = o_orderkey WHERE o_orderkey % 10 NOT IN (2, 4)""")
def chn6_deliver(s: SparkSession, d: str) -> DataFrame:
    """Only documents with a stored completion event are delivered."""
    n = corpus.arguments(s, d).groupBy("document_id").agg(F.count(F.lit(1)).alias("entries"))
    b = table(s, d, "orders").select(F.col("o_orderkey").alias("document_id")).join(n, "document_id", "left").fillna(0, ["entries"])
    e = _stages(s, d).select("*", F.col("document_id").alias("chain_id"), F.lit("{}").alias("payload"), F.lit(1).alias("serialization_version"))
    return custody_store.deliver(b, e, new_path(s, "custody"), new_path(s, "briefings"))


# --- logs and metrics ---------------------------------------------------------------------------------------------


def _logs(s: SparkSession, d: str) -> DataFrame:
    e = table(s, d, "events")
    attrs = F.create_map(F.lit("k"), F.get_json_object("props", "$.k"), F.lit("secret"), F.concat(F.lit("x\n"), F.col("user_id")), F.lit("correlation_id"), F.lit("forged"))
    trace = F.concat(F.lit('Traceback (most recent call last):\n  File "/app/a.py", line 3, in f\n  File "/app/sub/b.py", line '), F.col("user_id"), F.lit(", in g\nValueError: secret "), F.col("event_id"))
    return e.select(
        F.col("user_id").cast("string").alias("run_id"), F.when(F.col("event_id") % 3 == 0, "foreign").otherwise("own").alias("origin"), F.when(F.col("event_id") % 3 == 0, F.repeat("event_type", F.lit(60))).otherwise(F.col("event_type")).alias("event"),
        F.lit("info").alias("level"), "ts", attrs.alias("attrs"), F.when(F.col("event_type") == "error", trace).alias("exc_text"), "event_id",
    )


@query("SELECT user_id::VARCHAR AS run_id, 'secret' AS key, count(*) AS n FROM events GROUP BY 1")
def flt6_log_allowlist(s: SparkSession, d: str) -> DataFrame:
    _, bad = logs.log_allowlist(_logs(s, d), ("k", "correlation_id"))
    return bad.groupBy("run_id", "key").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT event_id, CASE WHEN event_id % 3 = 0 THEN repeat(event_type, 60) WHEN event_type IN ('click', 'view', 'error') THEN event_type ELSE 'unregistered_event' END AS event, CASE WHEN event_id % 3 = 0 OR event_type IN ('click', 'view', 'error') THEN 3 ELSE 1 END AS n FROM events")
def flt7_enforce_vocabulary(s: SparkSession, d: str) -> DataFrame:
    known = table(s, d, "events").where("event_type in ('click', 'view', 'error')").select(F.col("event_type").alias("event"))
    return logs.enforce_vocabulary(_logs(s, d), known).select("event_id", "event", F.size("attrs").alias("n"))


@query("SELECT event_id, CASE WHEN event_id % 3 <> 0 THEN event_type WHEN length(repeat(event_type, 60)) > 200 THEN left(repeat(event_type, 60), 200) || '[truncated]' ELSE repeat(event_type, 60) END AS event, 'x' || user_id AS secret FROM events")
def flt8_sanitize_logs(s: SparkSession, d: str) -> DataFrame:
    return logs.sanitize_logs(_logs(s, d)).select("event_id", "event", F.col("attrs")["secret"].alias("secret"))


@query("SELECT event_id, CASE WHEN event_type = 'error' THEN 'ValueError' END AS exc_type, CASE WHEN event_type = 'error' THEN 'b.py:' || user_id END AS exc_location FROM events")
def flt9_reduce_exceptions(s: SparkSession, d: str) -> DataFrame:
    return logs.reduce_exceptions(_logs(s, d)).select("event_id", "exc_type", "exc_location")


@query("SELECT event_id, CASE WHEN user_id % 2 = 0 THEN 'run-' || user_id END AS correlation_id FROM events")
def flt11_stamp_correlation(s: SparkSession, d: str) -> DataFrame:
    runs = table(s, d, "events").where("user_id % 2 = 0").select(F.col("user_id").cast("string").alias("run_id")).distinct().withColumn("correlation_id", F.concat(F.lit("run-"), "run_id"))
    return logs.stamp_correlation(_logs(s, d), runs).select("event_id", F.col("attrs")["correlation_id"].alias("correlation_id"))


@query("SELECT event_type AS stage, count(*) FILTER (user_id % 2 = 0) AS ok, count(*) FILTER (user_id % 2 = 1) AS error, round(avg(value), 6) AS mean_seconds, quantile_disc(value, 0.5) AS median_seconds, count(*) FILTER (value <= 1) AS le_1, count(*) FILTER (value <= 10) AS le_10, count(*) AS le_inf FROM events GROUP BY 1")
def agg9_stage_durations(s: SparkSession, d: str) -> DataFrame:
    t = table(s, d, "events").select(F.col("event_type").alias("stage"), F.when(F.col("user_id") % 2 == 0, "ok").otherwise("error").alias("status"), F.col("value").alias("seconds"))
    m = metrics.stage_durations(t, (1.0, 10.0))
    h = F.col("histogram")
    return m.select("stage", "ok", "error", F.round("mean_seconds", 6).alias("mean_seconds"), "median_seconds", h["1.0"].alias("le_1"), h["10.0"].alias("le_10"), h["+Inf"].alias("le_inf"))


# --- ranking ------------------------------------------------------------------------------------------------------


_SQL_BM25 = """w AS (SELECT doc_id, lower(unnest(regexp_extract_all(text, '\\S+'))) AS term FROM documents), size AS (SELECT doc_id, count(*) AS size FROM w GROUP BY 1), tf AS (SELECT doc_id, term, count(*) AS tf FROM w GROUP BY 1, 2
), st AS (SELECT (SELECT count(*) FROM documents) AS n, (SELECT sum(size) FROM size)::DOUBLE / (SELECT count(*) FROM documents) AS mean_size
), idf0 AS (SELECT term, ln(n - count(*) + 0.5::DOUBLE) - ln(count(*) + 0.5::DOUBLE) AS idf FROM tf, st GROUP BY term, n), fl AS (SELECT 0.25::DOUBLE * avg(idf) AS f FROM idf0), idf AS (SELECT term, CASE WHEN idf < 0 THEN f ELSE idf END AS idf FROM idf0, fl
), q AS (SELECT item_id, term, count(*) AS times FROM (SELECT item_id, lower(unnest(regexp_extract_all(text, '\\S+'))) AS term FROM benchmark) GROUP BY 1, 2
), s AS (SELECT q.item_id AS query_id, tf.doc_id AS item_id, round(sum(times * idf * tf * 2.5::DOUBLE / (tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * size / mean_size))), 9) AS score FROM q JOIN tf USING (term) JOIN idf USING (term) JOIN size USING (doc_id), st GROUP BY 1, 2)"""


@query(f"""WITH {_SQL_BM25}
SELECT query_id, item_id, round(score, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id)::INT AS rank FROM s QUALIFY rank <= 5""")
def rnk1_bm25(s: SparkSession, d: str) -> DataFrame:
    docs = table(s, d, "documents").select(F.col("doc_id").alias("item_id"), "text")
    q = table(s, d, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    return ranking.bm25(docs, q, 5).withColumn("score", F.round("score", 6))


def _vectors(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    v = table(s, d, "embeddings").select(F.col("vec_id").alias("item_id"), "embedding", "label")
    return v, v.where("item_id % 20 = 0").withColumnRenamed("item_id", "query_id")


_SQL_DENSE = """v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings), u AS (SELECT vec_id, label, list_transform(e, lambda x: x / sqrt(list_dot_product(e, e))) AS e FROM v
), sims AS (SELECT q.vec_id AS query_id, u.vec_id AS item_id, q.label AS ql, u.label AS il, list_dot_product(q.e, u.e) AS score FROM u q, u WHERE q.vec_id % 20 = 0)"""


@query(f"WITH {_SQL_DENSE} SELECT query_id, item_id, round(score, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id)::INT AS rank FROM sims QUALIFY rank <= 10")
def top1_dense(s: SparkSession, d: str) -> DataFrame:
    return ranking.dense_scores(*_vectors(s, d), 10).withColumn("score", F.round("score", 6))


@query(f"WITH {_SQL_DENSE} SELECT query_id, item_id, round(score, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id)::INT AS rank FROM sims WHERE ql = il QUALIFY rank <= 5")
def top2_in_label(s: SparkSession, d: str) -> DataFrame:
    return ranking.top_in_label(*_vectors(s, d), 5).withColumn("score", F.round("score", 6))


@query(f"""WITH {_SQL_DENSE}, p AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id) AS r FROM sims QUALIFY r <= 40)
SELECT query_id, item_id, round(score, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id)::INT AS rank FROM p WHERE ql = il QUALIFY rank <= 2""")
def top2_pool(s: SparkSession, d: str) -> DataFrame:
    return ranking.top_in_label(*_vectors(s, d), 2, pool=True).withColumn("score", F.round("score", 6))


@query(f"""WITH {_SQL_DENSE}, r AS (SELECT query_id, item_id, score, row_number() OVER w AS rank, score - lead(score) OVER w AS gap FROM sims WHERE item_id <> query_id WINDOW w AS (PARTITION BY query_id ORDER BY score DESC, item_id))
SELECT query_id, item_id, round(score, 6) AS score, round(gap, 6) AS gap FROM r WHERE rank = 1""")
def win5_rank_gap(s: SparkSession, d: str) -> DataFrame:
    """The nearest other vector of each query and its lead over the second."""
    top = ranking.dense_scores(*_vectors(s, d), 3).where("item_id <> query_id").drop("rank")
    return ranking.rank_gap(top).select("query_id", "item_id", F.round("score", 6).alias("score"), F.round("gap", 6).alias("gap"))


_SQL_RANKINGS = f"""{_SQL_DENSE}, a AS (SELECT query_id, item_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id) AS rank FROM sims QUALIFY rank <= 50
), b AS (SELECT query_id, item_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id) AS rank FROM sims WHERE ql = il QUALIFY rank <= 50
), f AS (SELECT query_id, item_id, sum(1::DOUBLE / ({FUSION} + rank)) AS score FROM (SELECT * FROM a UNION ALL SELECT * FROM b) GROUP BY 1, 2
), fused AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 12) DESC, item_id) AS rank FROM f)"""


def _fused(s: SparkSession, d: str, n: int | None) -> DataFrame:
    v, q = _vectors(s, d)
    scores = ranking.hybrid(ranking.dense_scores(v, q, 50), ranking.top_in_label(v, q, 50), None).drop("rank")
    return ranking.ranked(scores.withColumn("score", F.round("score", 12)), n)


@query(f"WITH {_SQL_RANKINGS} SELECT query_id, item_id, round(score, 9) AS score, rank::INT AS rank FROM fused WHERE rank <= 20")
def rnk2_rrf(s: SparkSession, d: str) -> DataFrame:
    v, q = _vectors(s, d)
    scores = ranking.rrf([ranking.dense_scores(v, q, 50), ranking.top_in_label(v, q, 50)]).drop("rank")
    return ranking.ranked(scores.withColumn("score", F.round("score", 12)), 20).withColumn("score", F.round("score", 9))


@query(f"WITH {_SQL_RANKINGS} SELECT query_id, item_id, round(score, 9) AS score, rank::INT AS rank FROM fused WHERE rank <= 3")
def rnk3_hybrid(s: SparkSession, d: str) -> DataFrame:
    return _fused(s, d, 3).withColumn("score", F.round("score", 9))


@query(f"""WITH {_SQL_BM25}, a AS (SELECT query_id, item_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id) AS rank FROM s QUALIFY rank <= 50
), v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings), u AS (SELECT vec_id, list_transform(e, lambda x: x / sqrt(list_dot_product(e, e))) AS e FROM v
), b AS (SELECT x.vec_id AS query_id, u.vec_id AS item_id, row_number() OVER (PARTITION BY x.vec_id ORDER BY list_dot_product(x.e, u.e) DESC, u.vec_id) AS rank FROM u x, u WHERE x.vec_id IN (SELECT item_id FROM benchmark) QUALIFY rank <= 50
), f AS (SELECT query_id, item_id, round(sum(1::DOUBLE / ({FUSION} + rank)), 12) AS score FROM (SELECT * FROM a UNION ALL SELECT * FROM b) GROUP BY 1, 2)
SELECT query_id, item_id, round(score, 9) AS score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id)::INT AS rank FROM f QUALIFY rank <= 20""")
def rnk3_hybrid_texts(s: SparkSession, d: str) -> DataFrame:
    """Benchmark items as queries: BM25 over the documents fused with the nearest vectors of the item's own (vectors by document id)."""
    sparse = ranking.bm25(table(s, d, "documents").select(F.col("doc_id").alias("item_id"), "text"), table(s, d, "benchmark").select(F.col("item_id").alias("query_id"), "text"), 50)
    v, _ = _vectors(s, d)
    own = v.join(table(s, d, "benchmark").select("item_id").distinct(), "item_id", "left_semi").withColumnRenamed("item_id", "query_id")
    scores = ranking.hybrid(sparse, ranking.dense_scores(v, own, 50), None).drop("rank")
    return ranking.ranked(scores.withColumn("score", F.round("score", 12)), 20).withColumn("score", F.round("score", 9))


@query(f"""WITH {_SQL_RANKINGS}, c AS (SELECT query_id, item_id, CASE WHEN (query_id + item_id) % 4 <> 0 THEN ((query_id * 31 + item_id * 17) % 101)::DOUBLE END AS score FROM fused WHERE rank <= 20)
SELECT query_id, item_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC NULLS LAST, item_id)::INT AS rank, item_id % 3 = 0 AS is_target FROM c QUALIFY rank <= 5""")
def rnk4_rerank(s: SparkSession, d: str) -> DataFrame:
    c = _fused(s, d, 20)
    scores = c.where("(query_id + item_id) % 4 <> 0").select("query_id", "item_id", ((F.col("query_id") * 31 + F.col("item_id") * 17) % 101).cast("double").alias("score"))
    return ranking.rerank(c, scores, c.where("item_id % 3 = 0"))


@query(f"""WITH {_SQL_DENSE}, r AS (SELECT query_id, item_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id) AS rank FROM sims QUALIFY rank <= 20
), t AS (SELECT vec_id - vec_id % 20 AS query_id, vec_id AS item_id, [1, 3, 10, 20][(vec_id % 4 + 1)::INT] AS target FROM embeddings)
SELECT target, count(*) AS wanted, count(*) FILTER (coalesce(rank <= target, false)) AS hits, round((count(*) FILTER (coalesce(rank <= 10, false)))::DOUBLE / count(*), 9) AS recall_at_k, round(avg(coalesce(1::DOUBLE / rank, 0)), 9) AS mrr FROM t LEFT JOIN r USING (query_id, item_id) GROUP BY 1""")
def agg25_rank_eval(s: SparkSession, d: str) -> DataFrame:
    from aktenwerk.operators.evaluation import rank_eval

    v, q = _vectors(s, d)
    target = F.element_at(F.array(*map(F.lit, (1, 3, 10, 20))), (F.col("item_id") % 4 + 1).cast("int"))
    truth = v.select((F.col("item_id") - F.col("item_id") % 20).alias("query_id"), "item_id", target.alias("target"))
    return _rounded(rank_eval(truth, ranking.dense_scores(v, q, 20)))


@query("""SELECT source, doc_id, n_chars, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id)::INT AS rank FROM documents QUALIFY rank <= 5""")
def top3_per_group(s: SparkSession, d: str) -> DataFrame:
    """A top-k report: the five longest documents of each source."""
    from aktenwerk.operators.evaluation import top_per

    return top_per(table(s, d, "documents").select("source", "doc_id", "n_chars"), "source", [F.desc("n_chars"), F.asc("doc_id")], 5)


@query("""SELECT doc_id AS document_id, 'PERSON' AS entity_type FROM documents WHERE n_chars % 2 = 0 UNION ALL SELECT doc_id, 'EMAIL_ADDRESS' FROM documents WHERE regexp_matches(text, '@')""")
def set1_all_spans(s: SparkSession, d: str) -> DataFrame:
    docs = table(s, d, "documents")
    a = docs.where("n_chars % 2 = 0").select(F.col("doc_id").alias("document_id"), F.lit("PERSON").alias("entity_type"))
    return masking.all_spans(a, docs.where(F.contains("text", F.lit("@"))).select(F.col("doc_id").alias("document_id"), F.lit("EMAIL_ADDRESS").alias("entity_type")))


# --- statutes -----------------------------------------------------------------------------------------------------


def _law_files(s: SparkSession, d: str) -> str:
    """Law files rendered from ``part``, 500 paragraphs each, with norms that a scan must drop."""
    p = table(s, d, "part").select("p_partkey", "p_name", "p_size", (F.col("p_partkey") % 9).alias("k"), F.floor(F.col("p_partkey") / 9).alias("n"))
    law = F.element_at(F.array(*map(F.lit, ("BauGB", "BauNVO", "BImSchG", "BNatSchG", "EnWG", "VwGO", "WaStrG", "WHG", "WPG"))), (F.col("k") + 1).cast("int"))
    enbez = F.when(F.col("p_size") % 7 == 0, F.concat(F.lit("Anlage "), F.col("n") + 1)).otherwise(F.concat(F.lit("§   "), F.col("n") + 1))
    body = F.when(F.col("p_size") % 11 == 0, F.lit("<P>(weggefallen)</P>")).otherwise(F.concat(F.lit("<P>(1) Erster <I>"), F.col("p_name"), F.lit("</I> Satz.</P>\n<P>Weiter.</P>")))
    norm = F.concat(F.lit("<norm><metadaten><jurabk>x</jurabk><amtabk>"), law, F.lit("</amtabk><enbez>"), enbez, F.lit("</enbez></metadaten><textdaten><text><Content>"), body, F.lit("</Content></text></textdaten></norm>"))
    frame = F.concat(F.lit("<dokumente><norm><metadaten><jurabk>"), F.first(law), F.lit("</jurabk></metadaten></norm>"))
    rows = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", norm.alias("x")))), lambda r: r["x"]), "\n")
    files = p.groupBy("k", F.floor(F.col("n") / 500).alias("f")).agg(F.concat(frame, rows, F.lit("</dokumente>")).alias("value"))
    path = new_path(s, "laws")
    files.select(F.concat_ws("-", "k", "f").alias("file"), "value").write.partitionBy("file").option("lineSep", "\n").text(path)
    return path + "/*/*"


@query(f"""WITH {SQL_STATUTES}, p AS (SELECT p_partkey, p_size FROM part) SELECT gesetz, paragraph, canonical_key, '(1) Erster ' || text || ' Satz. Weiter.' AS text FROM statutes JOIN p ON p_partkey // 9 + 1 = paragraph::BIGINT AND gesetz = ['BauGB', 'BauNVO', 'BImSchG', 'BNatSchG', 'EnWG', 'VwGO', 'WaStrG', 'WHG', 'WPG'][(p_partkey % 9 + 1)::INT] WHERE p_size % 7 <> 0 AND p_size % 11 <> 0""")
def src1_read_statutes(s: SparkSession, d: str) -> DataFrame:
    return statute_source.read_statutes(s, _law_files(s, d)).select("gesetz", "paragraph", "canonical_key", "text")


@query(f"""WITH {SQL_STATUTES}, p AS (SELECT p_partkey, p_size FROM part), k AS (SELECT gesetz, paragraph, text FROM statutes JOIN p ON p_partkey // 9 + 1 = paragraph::BIGINT AND gesetz = ['BauGB', 'BauNVO', 'BImSchG', 'BNatSchG', 'EnWG', 'VwGO', 'WaStrG', 'WHG', 'WPG'][(p_partkey % 9 + 1)::INT] WHERE p_size % 7 <> 0 AND p_size % 11 <> 0)
SELECT lower(gesetz) || '_§' || paragraph || '_abs1' AS chunk_id, '§ ' || paragraph || ' ' || gesetz || ' – (1) Erster ' || text || ' Satz.' AS text FROM k UNION ALL SELECT lower(gesetz) || '_§' || paragraph, '§ ' || paragraph || ' ' || gesetz || ' – Weiter.' FROM k""")
def src2_read_statute_chunks(s: SparkSession, d: str) -> DataFrame:
    return statute_source.read_statute_chunks(s, _law_files(s, d)).select("chunk_id", "text")


@query(f"""WITH {SQL_STATUTES}, h AS (SELECT sha256(canonical_key || chr(0) || text || chr(0)) AS h FROM statutes), b AS (SELECT ('0x' || left(h, 4))::INT % 256 AS b, sha256(string_agg(h, '' ORDER BY h)) AS h FROM h GROUP BY 1)
SELECT sha256(string_agg(b || ':' || h, '' ORDER BY b)) AS corpus_id FROM b""")
def agg10_corpus_id(s: SparkSession, d: str) -> DataFrame:
    return statute_source.corpus_id(corpus.statutes(s, d))


@query(f"""WITH {SQL_STATUTES}, d AS (SELECT * FROM statutes UNION ALL SELECT * FROM statutes WHERE paragraph = '5'), k AS (SELECT gesetz, canonical_key, count(*) AS n, count(title) AS t FROM d GROUP BY 1, 2)
SELECT gesetz, sum(n)::BIGINT AS paragraphs, sum(t)::BIGINT AS titled, count(*) FILTER (n > 1) AS duplicate_keys FROM k GROUP BY 1""")
def agg11_corpus_profile(s: SparkSession, d: str) -> DataFrame:
    st = corpus.statutes(s, d)
    return statute_source.corpus_profile(st.unionByName(st.where("paragraph = '5'")))


@query("""SELECT event_id::VARCHAR AS event_id, user_id::VARCHAR AS document_id, '{"k":' || (props::JSON ->> 'k') || '}' AS payload, NULL::VARCHAR AS line FROM events WHERE event_id % 10 <> 3 UNION ALL SELECT NULL, NULL, NULL, '{"event_id": ' || event_id FROM events WHERE event_id % 10 = 3""")
def src7_read_audit(s: SparkSession, d: str) -> DataFrame:
    """An audit log of JSON lines, every tenth of them cut off, read back as events and bad lines."""
    e = corpus.custody(s, d)
    row = F.to_json(F.struct("event_id", "event_type", "document_id", "payload", "serialization_version"))
    path = new_path(s, "audit")
    # the payload is an object in the line, not a quoted text
    plain = F.regexp_replace(F.regexp_replace(row, r'"payload":"(.*?)","serialization', r'"payload":$1,"serialization'), r'\\"', '"')
    e.select(F.when(F.col("event_id").cast("long") % 10 == 3, F.concat(F.lit('{"event_id": '), "event_id")).otherwise(plain).alias("value")).write.text(path)
    good, bad = letter_source.read_audit(s, path)
    none = F.lit(None).cast("string")
    return good.select("event_id", "document_id", F.regexp_replace("payload", r"\s", "").alias("payload"), none.alias("line")).unionByName(bad.select(none.alias("event_id"), none.alias("document_id"), none.alias("payload"), "line"))


# --- streams ------------------------------------------------------------------------------------------------------


def _stream(s: SparkSession, d: str, name: str) -> DataFrame:
    return s.readStream.schema(table(s, d, name).schema).option("pathGlobFilter", f"{name}.parquet").parquet(f"{d}/")


@query(f"""WITH {SQL_LETTERS}, n AS (SELECT document_id, sum(CASE WHEN sec2 IS NULL THEN 1 ELSE 2 END)::INT AS n FROM lines GROUP BY 1)
SELECT document_id, length(text)::INT AS n_chars, coalesce(n, 0) AS n_citations, 2 AS names, 1 AS phones, 1 AS mails,
  sha256('Einreicher: Dr. [NAME], ' || n_name || chr(10) || 'Telefon: [TELEFON]' || chr(10) || 'E-Mail: [EMAIL]' || chr(10) || chr(10) || body || chr(10) || chr(10) || 'Mit freundlichen Grüßen' || chr(10) || '[NAME]') AS clean_text
FROM letters LEFT JOIN n USING (document_id)""")
def str1_ingest(s: SparkSession, d: str) -> DataFrame:
    """Letters as a stream: gate, masking, citations of the masked texts."""
    docs = _stream_of(s, corpus.letters(s, d))
    out = new_path(s, "ingested")
    jobs.run_available(jobs.ingest(docs), out, new_path(s, "state"))
    kind = lambda k: F.col("entity_counts")[k]
    return s.read.parquet(out).select("document_id", "n_chars", F.size("citations").alias("n_citations"), kind("NAME").alias("names"), kind("TELEFON").alias("phones"), kind("EMAIL").alias("mails"), F.sha2("clean_text", 256).alias("clean_text"))


_SQL_NOTES = """n AS (SELECT c_custkey AS k, 'Vermerk' || repeat('!', (c_custkey % 4)::INT) || ' ' AS front, (c_custkey % 5)::INT AS form FROM customer
), p AS (SELECT k, form, length(front)::INT AS p0 FROM n)"""


@query(f"""WITH {_SQL_NOTES} SELECT k AS document_id, s, e, entity_type FROM (
  SELECT k, p0 AS s, p0 + 9 AS e, 'PERSON' AS entity_type FROM p WHERE form = 0
  UNION ALL SELECT k, p0, p0 + 9, 'PHONE_NUMBER' FROM p WHERE form = 1
  UNION ALL SELECT k, p0, p0 + 4, 'PERSON' FROM p WHERE form = 2 UNION ALL SELECT k, p0 + 5, p0 + 9, 'EMAIL_ADDRESS' FROM p WHERE form = 2
  UNION ALL SELECT k, p0, p0 + 9, 'PERSON' FROM p WHERE form = 3
  UNION ALL SELECT k, p0, p0 + 4, 'PERSON' FROM p WHERE form = 4 UNION ALL SELECT k, p0 + 6, p0 + 9, 'PERSON' FROM p WHERE form = 4)""")
def win1_mixed_regions(s: SparkSession, d: str) -> DataFrame:
    """Two or three spans a note: overlapping ones of two types (the higher score wins, in a tie the earlier one), neighbours of
    two types, neighbours of one type with white space or a sign between them, and a chain in which the second span's type is
    taken over by the region."""
    key = F.col("c_custkey")
    front = F.concat(F.lit("Vermerk"), F.repeat(F.lit("!"), (key % 4).cast("int")), F.lit(" "))
    form = (key % 5).cast("int")
    text = F.concat(front, F.when(form == 4, "abcd. efg").otherwise("abcd efgh"), F.lit(" Ende"))
    docs = table(s, d, "customer").select(key.alias("document_id"), text.alias("text"), F.length(front).alias("at"), form.alias("form"))
    # (form, start, end, type, score)
    rows = ((0, 0, 6, "PERSON", 0.9), (0, 4, 9, "PHONE_NUMBER", 0.9), (1, 0, 6, "PERSON", 0.5), (1, 4, 9, "PHONE_NUMBER", 0.6), (2, 0, 4, "PERSON", 0.9), (2, 5, 9, "EMAIL_ADDRESS", 1.0),
            (3, 0, 3, "PHONE_NUMBER", 0.6), (3, 2, 4, "PERSON", 0.9), (3, 5, 9, "PERSON", 0.7), (4, 0, 4, "PERSON", 0.9), (4, 6, 9, "PERSON", 0.9))
    kinds = F.array(*[F.struct(*(F.lit(v).alias(n) for n, v in zip(("form", "s", "e", "entity_type", "score"), r, strict=True))) for r in rows])
    spans = docs.select("document_id", "at", F.explode(F.filter(kinds, lambda x: x["form"] == F.col("form"))).alias("x")).select("document_id", (F.col("at") + F.col("x.s")).alias("s"), (F.col("at") + F.col("x.e")).alias("e"), "x.entity_type", "x.score")
    return masking.region_rows(masking.merge_regions(docs, spans)).select("document_id", "r.s", "r.e", "r.entity_type")


def _stream_of(s: SparkSession, df: DataFrame) -> DataFrame:
    """A table as a stream of its files."""
    path = new_path(s, "stream")
    df.write.parquet(path)
    return s.readStream.schema(df.schema).parquet(path)


@query(f"WITH RECURSIVE {SQL_CHAIN} SELECT user_id::VARCHAR AS chain_id, event_id::VARCHAR AS event_id, seq AS sequence_number, h AS event_hash FROM chain")
def str2_stateful_chain(s: SparkSession, d: str) -> DataFrame:
    """Three deliveries, each a run of the stream from its checkpoint; every seventh event comes up to two days late, so
    later deliveries hold events that belong between earlier ones. A last event far ahead, which stays in the state,
    lets the rest leave."""
    e = corpus.custody(s, d)
    arrival = F.col("ts") + F.make_interval(hours=F.when(F.col("event_id").cast("long") % 7 == 0, F.col("event_id").cast("long") % 48).otherwise(0))
    end = e.limit(1).withColumn("chain_id", F.lit("end")).withColumn("ts", F.lit("2100-01-01").cast("timestamp"))
    e = e.unionByName(end).withColumn("part", F.when(arrival < F.lit("2024-01-11"), 0).when(arrival < F.lit("2024-01-21"), 1).otherwise(2))
    source, out, state = new_path(s, "stream"), new_path(s, "chain"), new_path(s, "state")
    for part in range(3):
        e.where(F.col("part") == part).drop("part").write.mode("append").parquet(source)
        jobs.run_available(jobs.chain(s.readStream.schema(e.drop("part").schema).option("maxFilesPerTrigger", 100).parquet(source), "2 days"), out, state)
    return s.read.parquet(out)


_SAMPLES = {"unresolved": "event_type = 'error'", "citations": "true", "failures": "event_type = 'signup' and user_id % 2 = 0", "arguments": "event_type in ('signup', 'view')", "failed_writes": "event_type = 'purchase' and user_id % 10 = 0"}


@query("""WITH w AS (SELECT date_trunc('hour', ts) AS window_start, count(*) FILTER (event_type = 'error') AS u, count(*) AS c, count(*) FILTER (event_type = 'signup' AND user_id % 2 = 0) AS f, count(*) FILTER (event_type IN ('signup', 'view')) AS a, count(*) FILTER (event_type = 'purchase' AND user_id % 10 = 0) AS w FROM events GROUP BY 1
), m AS (SELECT max(ts) - INTERVAL 1 HOUR AS mark FROM events)
SELECT strftime(window_start, '%Y-%m-%d %H:%M:%S') AS window_start, round(u::DOUBLE / c, 9) AS unresolved_ratio, round(CASE WHEN a > 0 THEN f::DOUBLE / a END, 9) AS failure_rate, w::BIGINT AS failed_writes, u::DOUBLE / c > 0.2 AS unresolved_alert, coalesce(CASE WHEN a > 0 THEN f::DOUBLE / a END > 0.1, false) AS verification_alert, w > 0 AS audit_alert
FROM w, m WHERE window_start + INTERVAL 1 HOUR <= mark""")
def str3_alerts(s: SparkSession, d: str) -> DataFrame:
    e = _stream(s, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    out = new_path(s, "alerts")
    jobs.run_available(jobs.alerts(e.select("ts", *(F.expr(x).cast("long").alias(k) for k, x in _SAMPLES.items()))), out, new_path(s, "state"))
    a = s.read.parquet(out)
    return _rounded(a.withColumn("window_start", F.date_format("window_start", "yyyy-MM-dd HH:mm:ss")))


@query("SELECT event_id FROM events")
def str4_distinct_events(s: SparkSession, d: str) -> DataFrame:
    """Every event published twice, once within the horizon."""
    e = table(s, d, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"))
    out = new_path(s, "distinct")
    jobs.run_available(jobs.distinct_events(_stream_of(s, e.unionByName(e))), out, new_path(s, "state"))
    return s.read.parquet(out).select("event_id")


# --- plug-ins, raw store, sinks -------------------------------------------------------------------------------------


@query(f"""WITH {SQL_LETTERS}, w AS (SELECT document_id, unnest([16, length(text) - length(name)]) AS place FROM letters) SELECT document_id, place::INT AS s, (place + 5)::INT AS e FROM w""")
def udf1_register_detector(s: SparkSession, d: str) -> DataFrame:
    """A plug-in name detector, batch-wise over Arrow."""
    import re

    find = masking.register_detector(lambda texts: texts.map(lambda t: [(m.start(), m.end(), "PERSON", 0.9) for m in re.finditer("Erika", t or "")]))
    return masking.detect_pii(corpus.letters(s, d), {}, (find,)).select("document_id", "s", "e")


@query(f"""WITH {SQL_LETTERS}, n AS (SELECT document_id, sum(CASE WHEN sec2 IS NULL THEN 1 ELSE 2 END)::INT AS n FROM lines GROUP BY 1) SELECT document_id, coalesce(n, 0) AS n FROM letters LEFT JOIN n USING (document_id)""")
def udf2_register_extractor(s: SparkSession, d: str) -> DataFrame:
    """A plug-in citation extractor, batch-wise over Arrow."""
    from aktenwerk.operators.evaluation import register_extractor

    find = register_extractor(lambda texts: texts.str.findall(r"§ \d+"))
    return corpus.letters(s, d).select("document_id", F.size(find("text")).alias("n"))


def _uuid(c: Column) -> Column:
    h = F.md5(c.cast("string").cast("binary"))
    return F.concat_ws("-", *(F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))))


@query("""WITH h AS (SELECT doc_id, md5(doc_id::VARCHAR) AS h, text FROM documents), u AS (SELECT doc_id, left(h, 8) || '-' || substr(h, 9, 4) || '-' || substr(h, 13, 4) || '-' || substr(h, 17, 4) || '-' || substr(h, 21, 12) AS id, text FROM h)
SELECT id AS document_id, sha256(text) AS text, NULL AS reason FROM u UNION ALL SELECT 'x' || doc_id, NULL, 'not_a_uuid' FROM documents""")
def src6_read_raw(s: SparkSession, d: str) -> DataFrame:
    """All documents stored raw and asked for, with their access events, and by a wrong id each."""
    docs = table(s, d, "documents").select("doc_id", _uuid(F.col("doc_id")).alias("document_id"), "text")
    store = new_path(s, "raw")
    letter_source.write_raw(docs.drop("doc_id"), store)
    asked = docs.select("document_id").unionByName(docs.select(F.concat(F.lit("x"), "doc_id").alias("document_id")))
    got, rejected = letter_source.read_raw(s, asked, store, new_path(s, "trail"), F.lit("2024-01-01").cast("timestamp"))
    none = F.lit(None).cast("string")
    return got.select("document_id", F.sha2("text", 256).alias("text"), none.alias("reason")).unionByName(rejected.select("document_id", none.alias("text"), "reason"))


@query(f"""WITH {SQL_LETTERS}, k AS (SELECT document_id, count(*) AS n, max(typ) AS typ FROM lines GROUP BY 1) SELECT document_id, coalesce(typ, 'TYP_1') AS typ, coalesce(n, 0)::INT AS entries FROM letters LEFT JOIN k USING (document_id)""")
def src8_write_briefings(s: SparkSession, d: str) -> DataFrame:
    """Nested briefings written as JSON and read back."""
    whole = _dossiers(s, d, "citations")
    b = briefing.assemble_dossiers(whole, corpus.statutes(s, d), statute_source.corpus_id(corpus.statutes(s, d)))
    path = new_path(s, "briefings")
    letter_source.write_briefings(b, path)
    return s.read.schema(b.schema).json(path).select("document_id", "typ", F.size("entries").alias("entries"))


@query(f"WITH {SQL_BREAKS}, last AS (SELECT user_id, max(idx) AS top FROM numbered GROUP BY 1) SELECT DISTINCT user_id::VARCHAR AS chain_id FROM (SELECT user_id, idx FROM broken UNION ALL SELECT user_id, idx FROM w WHERE before = 7) JOIN last USING (user_id) WHERE idx > top - 40")
def chn4_refused_chains(s: SparkSession, d: str) -> DataFrame:
    """Chains that an append would refuse: the last 40 events don't verify."""
    return custody.verify_tail(_tampered(s, d), 40).select("chain_id").distinct()


@query(f"""WITH {SQL_LINES} SELECT document_id::VARCHAR AS document_id, prim AS norm, CASE WHEN part % 4 = 0 THEN 'gesetz_erwaehnung' ELSE 'paragraph_norm' END AS kind FROM lines UNION ALL SELECT o_orderkey::VARCHAR, NULL, NULL FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)""")
def src9_read_gt_citations(s: SparkSession, d: str) -> DataFrame:
    """Ground truth of all letters written as files of JSON arrays (about a thousand letters each) and read back as rows."""
    entry = F.struct(F.col("primary").alias("norm"), F.when(F.col("part") % 4 == 0, "gesetz_erwaehnung").otherwise("paragraph_norm").alias("type"))
    per = corpus.lines(s, d).groupBy("document_id").agg(F.collect_list(entry).alias("explizit_zitierte_normen"))
    docs = table(s, d, "orders").select(F.col("o_orderkey").alias("document_id")).join(per, "document_id", "left")
    none = F.array().cast("array<struct<norm:string,type:string>>")
    row = F.struct(F.col("document_id").cast("string").alias("dokument"), F.coalesce("explizit_zitierte_normen", none).alias("explizit_zitierte_normen"))
    files = docs.groupBy(F.floor(F.col("document_id") / 1000).alias("file")).agg(F.to_json(F.collect_list(row)).alias("value"))
    path = new_path(s, "truth")
    files.write.partitionBy("file").text(path)
    return letter_source.read_gt_citations(s, path + "/*/*")


def _truth_files(s: SparkSession, rows: DataFrame, root: str | None = None) -> str:
    """``rows(document_id, row)`` as files of JSON, about a thousand documents each: an array, or an object that holds one."""
    whole = F.collect_list("row")
    files = rows.groupBy(F.floor(F.col("document_id") / 1000).alias("file")).agg(F.to_json(F.struct(whole.alias(root)) if root else whole).alias("value"))
    path = new_path(s, "truth")
    files.write.partitionBy("file").text(path)
    return path + "/*/*"


@query(f"""WITH {SQL_LINES} SELECT document_id::VARCHAR AS doc_id, 'A' || ord AS argument_id, CASE part % 3 WHEN 0 THEN 'must_retrieve' WHEN 1 THEN 'should_retrieve' ELSE 'not_retrievable' END AS need,
CASE WHEN part % 3 < 2 THEN '§ ' || sec || ' ' || law END AS paragraph_id, prim AS citation, CASE WHEN part % 3 < 2 THEN 'top_' || (part % 3 + 1) END AS rank_target FROM lines""")
def src9_read_gt_retrieval(s: SparkSession, d: str) -> DataFrame:
    """Retrieval ground truth of all letters, an argument a line, written and read back."""
    kind = F.col("part") % 3
    entry = F.struct(F.concat(F.lit("§ "), F.col("sec"), F.lit(" "), F.col("law")).alias("paragraph_id"), F.col("primary").alias("citation"), F.concat(F.lit("top_"), kind + 1).alias("rank_target"))
    only = lambda k, e: F.when(kind == k, F.array(e)).otherwise(F.filter(F.array(e), lambda _: F.lit(False)))
    norms = F.struct(only(0, entry).alias("must_retrieve"), only(1, entry).alias("should_retrieve"), only(2, F.struct(F.col("primary").alias("citation"))).alias("not_retrievable_via_xml"))
    per = corpus.lines(s, d).groupBy("document_id").agg(F.collect_list(F.struct(F.concat(F.lit("A"), "ord").alias("argument_id"), norms.alias("expected_norms"))).alias("expected_arguments"))
    return letter_source.read_gt_retrieval(s, _truth_files(s, per.select("document_id", F.struct(F.col("document_id").cast("string").alias("doc_id"), "expected_arguments").alias("row"))))


@query(f"""WITH {SQL_LINES} SELECT document_id::VARCHAR AS document_id, CASE WHEN document_id % 3 = 0 THEN 'typ1' ELSE 'typ2' END AS doc_type, max(typ) AS expected_typ, string_agg(DISTINCT lower(law), ',' ORDER BY lower(law)) AS expected_catalog_ids, 1 AS low, count(*)::INT AS high FROM lines GROUP BY lines.document_id""")
def src9_read_gt_catalog(s: SparkSession, d: str) -> DataFrame:
    """Expected catalogs of all letters with arguments, written and read back."""
    per = corpus.arguments(s, d).join(corpus.lines(s, d).select("document_id", F.col("ord").alias("pos"), "law"), ["document_id", "pos"]).groupBy("document_id").agg(
        F.max("einwendungs_typ").alias("expected_einwendungs_typ"), F.array_sort(F.collect_set(F.lower("law"))).alias("expected_catalog_ids"), F.array(F.lit(1), F.count(F.lit(1)).cast("int")).alias("expected_argument_count_range")
    )
    row = F.struct(F.col("document_id").cast("string").alias("dokument"), F.when(F.col("document_id") % 3 == 0, "typ1").otherwise("typ2").alias("doc_type"), "expected_einwendungs_typ", "expected_catalog_ids", "expected_argument_count_range")
    got = letter_source.read_gt_catalog(s, _truth_files(s, per.select("document_id", row.alias("row")), "expected_catalog_assignment"))
    return got.withColumn("expected_catalog_ids", F.array_join("expected_catalog_ids", ","))


@query(f"""WITH {SQL_LETTERS} SELECT document_id || '.txt' AS file, name AS names_must_mask, n_name || '|Mit freundlichen' AS must_survive FROM letters""")
def src9_read_gt_pii(s: SparkSession, d: str) -> DataFrame:
    """Names to mask and terms to keep of all letters, written and read back."""
    n = table(s, d, "orders").join(table(s, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(table(s, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    names = masking.extract_zones(corpus.letters(s, d)).select("document_id", "names").join(n.select(F.col("o_orderkey").alias("document_id"), "n_name"), "document_id")
    row = F.struct(F.concat(F.col("document_id").cast("string"), F.lit(".txt")).alias("file"), F.col("names").alias("names_must_mask"), F.array("n_name", F.lit("Mit freundlichen")).alias("must_survive"))
    got = letter_source.read_gt_pii(s, _truth_files(s, names.select("document_id", row.alias("row")), "documents"))
    return got.select("file", F.array_join("names_must_mask", "|").alias("names_must_mask"), F.array_join("must_survive", "|").alias("must_survive"))


@query(f"""WITH RECURSIVE {SQL_CHAIN}, h AS (SELECT h, seq FROM chain WHERE user_id = (SELECT min(user_id) FROM events) ORDER BY seq DESC LIMIT 1)
SELECT event_type AS stage, count(*) AS n, any_value(h.h) AS chain_head_hash, any_value(h.seq) AS chain_head_sequence FROM events, h GROUP BY 1""")
def src10_write_results(s: SparkSession, d: str) -> DataFrame:
    """Counts by event type, written with the head of one custody chain in every row and read back."""
    results = table(s, d, "events").groupBy(F.col("event_type").alias("stage")).agg(F.count(F.lit(1)).alias("n"))
    events = corpus.custody(s, d)
    first = table(s, d, "events").agg(F.min("user_id").cast("string").alias("chain_id"))
    head = custody.chain_head(custody.append_chain(events.join(first, "chain_id", "left_semi")))
    path = new_path(s, "results")
    letter_source.write_results(results, head, path)
    return s.read.schema("stage string, n long, chain_head_hash string, chain_head_sequence long").json(path)


def _text_files(s: SparkSession, d: str) -> str:
    """Every document's text as a file in a folder named after its id."""
    path = new_path(s, "letters")
    letter_source.write_documents(table(s, d, "documents").select("doc_id", "text"), path, "doc_id")
    return path


@query("""SELECT 'doc_id=' || doc_id AS doc_type, sha256(coalesce(text, '') || chr(10)) AS text FROM documents""")
def src3_read_documents(s: SparkSession, d: str) -> DataFrame:
    """Texts of all documents written as files and scanned; the type is the folder's name."""
    return letter_source.read_documents(s, _text_files(s, d)).select("doc_type", F.sha2("text", 256).alias("text"))


@query("""SELECT doc_id, octet_length(encode(coalesce(text, '')))::BIGINT + 1 AS length, octet_length(encode(coalesce(text, ''))) + 1 <= 5000 AS accepted FROM documents""")
def src4_size_guard(s: SparkSession, d: str) -> DataFrame:
    """The same files, accepted up to 5000 bytes from the listing alone."""
    good, bad = letter_source.size_guard(s, _text_files(s, d), 5000)
    both = good.withColumn("accepted", F.lit(True)).unionByName(bad.withColumn("accepted", F.lit(False)))
    return both.select(F.regexp_extract("path", r"doc_id=(\d+)/", 1).cast("long").alias("doc_id"), "length", "accepted")


_SQL_CARDS = """cards AS (SELECT c_custkey AS k, lpad((c_custkey * 7919)::VARCHAR, 18, '4') AS bban FROM customer), ibans AS (SELECT k, bban, 98 - (bban || '131400')::HUGEINT % 97 AS digits FROM cards
), shown AS (SELECT k, lpad((digits % 100)::VARCHAR, 2, '0') || bban AS good, lpad(((digits + 1) % 100)::VARCHAR, 2, '0') || bban AS wrong FROM ibans)"""


@query(f"""WITH {_SQL_CARDS} SELECT k AS document_id, 'PHONE_NUMBER' AS entity_type, '0171 ' || (k + 1000000) AS found FROM shown UNION ALL SELECT k, 'IBAN_CODE', 'DE' || good FROM shown UNION ALL SELECT k, 'EMAIL_ADDRESS', 'm' || k || '@post.example.org' FROM shown
UNION ALL SELECT k, 'PHONE_NUMBER', unnest(list_filter([good, wrong], lambda x: x LIKE '0%')) FROM shown""")
def txt5_detect_all(s: SparkSession, d: str) -> DataFrame:
    """A note of each customer with a phone number, a mail address, a valid IBAN and one with a wrong check digit; digits
    that begin with 0 look like a phone number too (the higher score wins when regions are merged)."""
    key = F.col("c_custkey")
    c = table(s, d, "customer").select(key.alias("document_id"), F.lpad((key * 7919).cast("string"), 18, "4").alias("bban"))
    check = lambda add: F.lpad(((98 - F.concat("bban", F.lit("131400")).cast("decimal(38,0)") % 97 + add) % 100).cast("int").cast("string"), 2, "0")
    iban = lambda add: F.concat(F.lit("DE"), check(add), "bban")
    text = F.concat(F.lit("Rückruf 0171 "), F.col("document_id") + 1000000, F.lit(", Konto "), iban(0), F.lit(" statt "), iban(1), F.lit("; m"), "document_id", F.lit("@post.example.org."))
    docs = c.select("document_id", text.alias("text"))
    return masking.detect_pii(docs).join(docs, "document_id").select("document_id", "entity_type", F.substring(F.col("text"), F.col("s") + 1, F.col("e") - F.col("s")).alias("found"))


@query("""WITH t AS (SELECT c_custkey AS document_id, 'Max Beispiel' || c_custkey AS name, 'Einreichende Organisation: Verein ' || c_custkey || ' e.V., ' || c_mktsegment || chr(10) AS front, repeat('Wir lehnen das Vorhaben ab. ', 6) AS body FROM customer), x AS (SELECT *, front || 'vertreten durch: Prof. Dr. ' || name AS head FROM t)
SELECT document_id, name AS names, length(front)::INT AS anchor_start, length(head)::INT AS anchor_end, (length(head) + length(', Vorstand' || chr(10) || chr(10) || body || chr(10) || chr(10)))::INT AS signature_start FROM x""")
def txt3_organisation_zones(s: SparkSession, d: str) -> DataFrame:
    """Letters of organisations: no submitter's name, a representative with titles, and no closing formula."""
    c, nl = table(s, d, "customer"), F.lit("\n")
    text = F.concat(F.lit("Einreichende Organisation: Verein "), "c_custkey", F.lit(" e.V., "), "c_mktsegment", nl, F.lit("vertreten durch: Prof. Dr. Max Beispiel"), "c_custkey", F.lit(", Vorstand\n\n"), F.repeat(F.lit("Wir lehnen das Vorhaben ab. "), F.lit(6)), F.lit("\n\nMax Beispiel"), "c_custkey", F.lit("\nVorstand"))
    z = masking.extract_zones(c.select(F.col("c_custkey").alias("document_id"), text.alias("text")))
    return z.select("document_id", F.array_join("names", "; ").alias("names"), F.col("anchor.s").alias("anchor_start"), F.col("anchor.e").alias("anchor_end"), F.col("signature.s").alias("signature_start"))


@query(f"""WITH {SQL_BREAKS}, last AS (SELECT user_id, max(idx) AS top FROM numbered GROUP BY 1), bad AS (SELECT DISTINCT user_id FROM (SELECT user_id, idx FROM broken UNION ALL SELECT user_id, idx FROM w WHERE before = 7) JOIN last USING (user_id) WHERE idx > top - 256)
SELECT count(*) > 0 AS refused, (SELECT count(*) FROM numbered) AS stored_events FROM bad""")
def chn6_refused_delivery(s: SparkSession, d: str) -> DataFrame:
    """A delivery to a tampered store is refused, and the store is as long afterwards as before."""
    store = new_path(s, "tampered")
    _tampered(s, d).write.parquet(f"{store}/v=0")
    event = corpus.custody(s, d).withColumn("event_id", F.concat(F.lit("new-"), "event_id"))
    try:
        custody_store.deliver(event.select("document_id"), event, store, new_path(s, "out"))
        refused = False
    except ValueError:
        refused = True
    return s.read.parquet(store).agg(F.lit(refused).alias("refused"), F.count(F.lit(1)).alias("stored_events"))


def _refused(append, *args) -> bool:
    try:
        append(*args)
    except ValueError:
        return True
    return False


_SQL_STORED = f"""WITH RECURSIVE {SQL_CHAIN} SELECT user_id::VARCHAR AS chain_id, true AS refused, count(*) AS stored_events, arg_max(h, seq) AS event_hash FROM chain WHERE event_id IN (SELECT event_id FROM events WHERE ts < TIMESTAMP '2024-01-16') GROUP BY 1"""


@query(_SQL_STORED)
def chn6_broken_batch(s: SparkSession, d: str) -> DataFrame:
    """The first half of January is stored; a batch of the rest in which some events have an unknown version is refused as a
    whole, and store and heads are as before."""
    e, store = corpus.custody(s, d), new_path(s, "custody")
    custody_store.append(e.where("ts < timestamp'2024-01-16'"), store)
    wrong = F.when(F.col("event_id").cast("long") % 97 == 3, 99).otherwise(F.col("serialization_version"))
    refused = _refused(custody_store.append, e.where("ts >= timestamp'2024-01-16'").withColumn("serialization_version", wrong), store)
    n = custody_store.read(s, store).groupBy("chain_id").agg(F.count(F.lit(1)).alias("stored_events"))
    return custody_store.heads(s, store).join(n, "chain_id").select("chain_id", F.lit(refused).alias("refused"), "stored_events", "event_hash")


@query(_SQL_STORED)
def chn6_two_writers(s: SparkSession, d: str) -> DataFrame:
    """Two writers stage from one version: the first to publish wins, the other is refused and no chain is forked."""
    e, store = corpus.custody(s, d), new_path(s, "custody")
    custody_store.append(e.where("ts < timestamp'2024-01-09'"), store)
    one = custody_store.stage(e.where("ts < timestamp'2024-01-16'"), store)
    two = custody_store.stage(e.where("ts >= timestamp'2024-01-16'"), store)
    custody_store.publish(s, one)
    refused = _refused(custody_store.publish, s, two)
    n = custody_store.read(s, store).groupBy("chain_id").agg(F.count(F.lit(1)).alias("stored_events"))
    return custody_store.heads(s, store).join(n, "chain_id").select("chain_id", F.lit(refused).alias("refused"), "stored_events", "event_hash")


@query(f"WITH RECURSIVE {SQL_CHAIN} SELECT user_id::VARCHAR AS chain_id, count(*) AS stored_events, max(seq) AS sequence_number, arg_max(h, seq) AS event_hash FROM chain GROUP BY 1")
def chn4_head_table(s: SparkSession, d: str) -> DataFrame:
    """Four appends of eight days each; every one reads the heads and the segments that hold the tails of its chains."""
    e, store = corpus.custody(s, d), new_path(s, "custody")
    for part in range(4):
        custody_store.append(e.where(F.floor((F.dayofmonth("ts") - 1) / 8) == part), store, 8)
    n = custody_store.read(s, store).groupBy("chain_id").agg(F.count(F.lit(1)).alias("stored_events"))
    return custody_store.heads(s, store).join(n, "chain_id").select("chain_id", "stored_events", "sequence_number", "event_hash")


@query("""WITH h AS (SELECT md5(doc_id::VARCHAR) AS h FROM documents) SELECT left(h, 8) || '-' || substr(h, 9, 4) || '-' || substr(h, 13, 4) || '-' || substr(h, 17, 4) || '-' || substr(h, 21, 12) AS document_id, 2 AS accesses FROM h""")
def src6_repeated_access(s: SparkSession, d: str) -> DataFrame:
    """All documents asked for twice at one time, the second request repeated after a failure: two access events each."""
    docs = table(s, d, "documents").select(_uuid(F.col("doc_id")).alias("document_id"), "text")
    store, trail = new_path(s, "raw"), new_path(s, "trail")
    letter_source.write_raw(docs, store)
    for request in ("first", "second", "second"):
        letter_source.read_raw(s, docs, store, trail, F.lit("2024-01-01").cast("timestamp"), request=request)
    return custody_store.read(s, trail).groupBy("document_id").agg(F.count(F.lit(1)).alias("accesses"))
