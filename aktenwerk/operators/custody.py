"""Tamper-evident custody chains: canonical form, append, parallel verification, order of stages (stored by ``sources.custody_store``)."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from aktenwerk.functions.fixed import BREAKS, GENESIS

#: Serialization version -> builder of the canonical text.
VERSIONS = (1,)


def canonical_text(df: DataFrame) -> Column:
    """CHN-3: JSON with sorted keys, tight separators, nulls kept and the event's hash left out; null for an unknown version.

    ``payload`` is a JSON object text; its keys (and those of flat maps in it) are sorted.
    """
    # a string's JSON form is what stands between {"v": and }
    quoted = lambda c: F.when(F.col(c).isNull(), "null").otherwise(F.regexp_extract(F.to_json(F.struct(F.col(c).cast("string").alias("v"))), r'(?s)^\{"v":(.*)\}$', 1))
    number = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("null"))
    def sorted_value(v: Column) -> Column:
        text = F.to_json(v)
        inner = F.array_sort(F.transform(F.map_entries(F.from_json(text, "map<string,string>")), lambda e: F.struct(e["key"].alias("key"), F.to_json(F.map_from_arrays(F.array(e["key"]), F.array(F.variant_get(v, "$", "map<string,variant>")[e["key"]]))).alias("j"))))
        flat = F.concat(F.lit("{"), F.array_join(F.transform(inner, lambda e: F.substring(e["j"], F.lit(2), F.length(e["j"]) - 2)), ","), F.lit("}"))
        return F.when(F.startswith(text, F.lit("{")), flat).otherwise(F.coalesce(text, F.lit("null")))

    def key_text(k: Column) -> Column:
        return F.regexp_extract(F.to_json(F.struct(k.alias("v"))), r'(?s)^\{"v":(.*)\}$', 1)

    payload = F.when(F.col("payload").isNull(), "null").otherwise(
        F.concat(F.lit("{"), F.array_join(F.array_sort(F.transform(F.map_keys(F.from_json("payload", "map<string,variant>")), lambda k: F.concat(key_text(k), F.lit(":"), sorted_value(F.from_json("payload", "map<string,variant>")[k])))), ","), F.lit("}"))
    )
    fields = {
        "document_id": quoted("document_id"),
        "event_id": quoted("event_id"),
        "event_type": quoted("event_type"),
        "payload": payload,
        "sequence_number": number("sequence_number"),
        "serialization_version": number("serialization_version"),
        "timestamp": F.coalesce(F.concat(F.lit('"'), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"), F.lit('"')), F.lit("null")),
    }
    parts = [F.concat(F.lit(f'"{k}":'), v) for k, v in fields.items()]
    return F.when(F.col("serialization_version").isin(*VERSIONS), F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}")))


def link(canonical: Column, previous: Column) -> Column:
    """SHA-256 of the canonical bytes and the predecessor's hash."""
    return F.sha2(F.concat(canonical, previous).cast("binary"), 256)


def number_events(events: DataFrame, heads: DataFrame | None = None) -> DataFrame:
    """WIN-2: ``sequence_number`` 0.. per chain by time and id, going on from ``heads(chain_id, sequence_number)``."""
    n = F.row_number().over(Window.partitionBy("chain_id").orderBy("ts", "event_id")) - 1
    numbered = events.withColumn("sequence_number", n.cast("long"))
    if heads is None:
        return numbered
    last = heads.select("chain_id", F.col("sequence_number").alias("_last"))
    return numbered.join(last, "chain_id", "left").withColumn("sequence_number", F.col("sequence_number") + F.coalesce(F.col("_last") + 1, F.lit(0))).drop("_last")


def append_chain(events: DataFrame, heads: DataFrame | None = None) -> DataFrame:
    """CHN-1: numbers events and adds ``event_hash``, each over its predecessor's, from the stored head or genesis.

    A chain is sequential; the chains run in parallel. Rows are sorted by chain and number, and only the last hash goes
    from row to row, so a task holds a batch of rows however long its chains are. Events without a chain are left out.
    """
    numbered = number_events(events.where("chain_id is not null"), heads)
    rows = numbered.withColumn("_c", canonical_text(numbered))
    if heads is not None:
        rows = rows.join(heads.select("chain_id", F.col("event_hash").alias("_head")), "chain_id", "left")
    else:
        rows = rows.withColumn("_head", F.lit(None).cast("string"))
    rows = rows.withColumn("_chain", F.col("chain_id").cast("string"))
    names = numbered.columns

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chain = head = None
        for b in batches:
            hashes = []
            for key, text, start in zip(*(b.column(c).to_pylist() for c in ("_chain", "_c", "_head")), strict=True):
                if key != chain:
                    chain, head = key, start or GENESIS
                head = None if text is None or head is None else hashlib.sha256((text + head).encode()).hexdigest()
                hashes.append(head)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), pa.array(hashes, pa.string())], [*names, "event_hash"])

    schema = StructType([*numbered.schema.fields, StructField("event_hash", StringType())])
    return rows.repartition("chain_id").sortWithinPartitions("chain_id", "sequence_number").mapInArrow(fold, schema)


def with_predecessor(events: DataFrame, heads: DataFrame | None = None) -> DataFrame:
    """JON-6: each stored event with its predecessor's hash by stored position ``idx`` (0.. per chain); ``heads`` are the
    last events before a segment."""
    before = events.select("chain_id", (F.col("idx") + 1).alias("idx"), F.col("event_hash").alias("prev_hash"), F.col("sequence_number").alias("prev_sequence"))
    if heads is not None:
        n = F.col("sequence_number")
        before = before.unionByName(heads.select("chain_id", (n + 1).alias("idx"), F.col("event_hash").alias("prev_hash"), n.alias("prev_sequence")))
    return events.join(before, ["chain_id", "idx"], "left")


def chain_breaks(events: DataFrame, heads: DataFrame | None = None) -> DataFrame:
    """CHN-2: every row that doesn't continue its chain (behind ``heads``, for a segment): ``(chain_id, idx, sequence_number,
    reason, expected, found)``.

    Each row is checked against its stored predecessor only, so verification is parallel. The first break of a chain is
    the one a walk from genesis finds.
    """
    p = with_predecessor(events, heads)
    p = p.withColumn("_hash", link(canonical_text(p), F.coalesce("prev_hash", F.lit(GENESIS))))
    first = F.col("idx") == 0
    reason = (
        F.when(~F.col("sequence_number").eqNullSafe(F.col("idx")), BREAKS["sequence"])
        .when(F.col("event_hash").isNull(), BREAKS["no_hash"])
        .when(F.col("_hash").isNull(), BREAKS["version"])
        .when(F.col("event_hash") != F.col("_hash"), F.when(first, BREAKS["genesis"]).otherwise(BREAKS["hash"]))
    )
    p = p.withColumn("reason", reason).where("reason is not null")
    numbers = F.col("reason") == BREAKS["sequence"]
    missing = F.col("reason") == BREAKS["no_hash"]
    expected = F.when(numbers, F.col("idx").cast("string")).when(missing, BREAKS["digest"]).otherwise(F.col("_hash"))
    found = F.when(numbers, F.coalesce(F.col("sequence_number").cast("string"), F.lit("None"))).when(missing, "None").otherwise(F.col("event_hash"))
    return p.select("chain_id", "idx", "sequence_number", "reason", expected.alias("expected"), found.alias("found"))


def first_breaks(breaks: DataFrame) -> DataFrame:
    """WIN-3: the first break of each chain."""
    row = F.struct("idx", "sequence_number", "reason", "expected", "found")
    return breaks.groupBy("chain_id").agg(F.min_by(row, "idx").alias("b")).select("chain_id", "b.*")


def verify_chain(events: DataFrame) -> DataFrame:
    """CHN-2: one row a chain: ``ok`` and its first break."""
    return events.select("chain_id").distinct().join(first_breaks(chain_breaks(events)), "chain_id", "left").withColumn("ok", F.col("reason").isNull())


TAIL = 256


def tail_breaks(events: DataFrame, heads: DataFrame, k: int = TAIL) -> DataFrame:
    """CHN-4: the breaks among the last ``k`` events of the chains in ``heads(chain_id, sequence_number, event_hash)``, each tail seeded
    from the event before it, and chains whose last stored event isn't the head. ``events`` may hold the tails only."""
    h = heads.select("chain_id", F.col("sequence_number").alias("_top"), F.col("event_hash").alias("_head"))
    tail = events.join(h, "chain_id").where(F.col("idx") >= F.col("_top") - k)
    p = with_predecessor(tail)
    p = p.withColumn("_hash", link(canonical_text(p), F.coalesce("prev_hash", F.lit(GENESIS)))).where(F.col("idx") > F.col("_top") - k)
    expected = F.coalesce(F.col("prev_sequence"), F.lit(-1)) + 1
    reason = F.when(~F.col("sequence_number").eqNullSafe(expected), BREAKS["sequence"]).when(F.col("event_hash").isNull(), BREAKS["no_hash"]).when(~F.col("event_hash").eqNullSafe(F.col("_hash")), BREAKS["hash"])
    found = p.withColumn("reason", reason).where("reason is not null").select("chain_id", "idx", "sequence_number", "reason")
    last = tail.where(F.col("idx") == F.col("_top")).select("chain_id", F.col("event_hash").alias("_last"))
    lost = h.join(last, "chain_id", "left").where(~F.col("_last").eqNullSafe(F.col("_head")))
    return found.unionByName(lost.select("chain_id", F.col("_top").alias("idx"), F.col("_top").alias("sequence_number"), F.lit(BREAKS["hash"]).alias("reason")))


def verify_tail(events: DataFrame, k: int = TAIL) -> DataFrame:
    """WIN-4: the breaks among the last ``k`` events of each chain, seeded from the event before them.

    The ends of chains are an aggregate, so no chain is sorted; where a store keeps them (``sources.custody_store``), they are read."""
    ends = events.groupBy("chain_id").agg(F.max("idx").alias("sequence_number"), F.max_by("event_hash", "idx").alias("event_hash"))
    return tail_breaks(events, ends, k)


def chain_head(events: DataFrame) -> DataFrame:
    """AGG-26: last hash and sequence number of each chain."""
    return events.groupBy("chain_id").agg(F.max_by("event_hash", "sequence_number").alias("event_hash"), F.max("sequence_number").alias("sequence_number"))


def assert_appendable(events: DataFrame, bad_lines: DataFrame | None = None, k: int = TAIL) -> None:
    """CHN-4: raises if a line doesn't parse or the tail of a chain doesn't verify."""
    if bad_lines is not None and not bad_lines.isEmpty():
        raise ValueError("the audit log has lines that don't parse")
    broken = verify_tail(events, k).take(1)
    if broken:
        raise ValueError(f"chain {broken[0]['chain_id']} breaks at {broken[0]['idx']}: {broken[0]['reason']}")


ORDER = ("eingang", "triage", "retrieval")
TERMINAL = ("briefing_erstellt", "kein_treffer", "pipeline_fehler")


def custody_gaps(events: DataFrame, briefings: DataFrame) -> DataFrame:
    """WIN-6: ``(document_id, gap)``: documents whose stages are out of order or incomplete, or briefings without an end."""
    seen = F.transform(F.array_sort(F.collect_list(F.struct("ts", "event_id", "event_type"))), lambda x: x["event_type"])
    lists = events.where(F.col("event_type").isin(*ORDER, *TERMINAL)).groupBy("document_id").agg(seen.alias("seen"))
    whole = F.exists(F.array(*[F.array(*map(F.lit, (*ORDER, t))) for t in TERMINAL[:2]]), lambda x: x == F.col("seen"))
    last = F.element_at("seen", -1)
    failed = last == "pipeline_fehler"
    gap = F.when(~whole & ~failed, F.when(~last.isin(*TERMINAL), "no_terminal_event").otherwise("stages_out_of_order"))
    wrong = lists.select("document_id", gap.alias("gap")).where("gap is not null")
    done = events.where(F.col("event_type").isin(*TERMINAL[:2])).select("document_id").distinct()
    lost = briefings.select("document_id").distinct().join(done, "document_id", "left_anti").withColumn("gap", F.lit("briefing_without_event"))
    return wrong.unionByName(lost)


def custody_events(docs: DataFrame, stage: str | Column, payload: Column, ts: Column) -> DataFrame:
    """CHN-5: one event of a stage (given, or in a column) for each row of ``docs(document_id, ...)``; ids are hashes, so reruns agree."""
    stage = F.lit(stage) if isinstance(stage, str) else stage
    return docs.select(
        F.sha2(F.concat_ws("|", F.col("document_id").cast("string"), stage), 256).alias("event_id"),
        stage.alias("event_type"),
        F.col("document_id").cast("string").alias("document_id"),
        ts.alias("ts"),
        payload.alias("payload"),
        F.lit(1).alias("serialization_version"),
    )


def pipeline_events(masked: DataFrame, flags: DataFrame, arguments: DataFrame, resolutions: DataFrame, ends: DataFrame, start: Column) -> DataFrame:
    """CHN-5: the four events of each processed document, one second apart."""
    a = arguments.groupBy("document_id").agg(F.count(F.lit(1)).alias("_a"))
    r = resolutions.groupBy("document_id").agg(F.count_if("resolved").alias("_r"))
    d = masked.join(flags, "document_id").join(ends, "document_id").join(a, "document_id", "left").join(r, "document_id", "left").fillna(0, ["_a", "_r"])
    end = F.when(F.col("terminal_status").isin(*TERMINAL[:2]), F.col("terminal_status"))
    events = (
        (F.lit("eingang"), F.struct(F.col("document_id").cast("string").alias("document_id"), F.col("entity_counts").alias("masked_entity_counts"))),
        (F.lit("triage"), F.struct(F.col("_a").alias("argument_count"), "contradiction_detected", "substance_threshold_exceeded")),
        (F.lit("retrieval"), F.struct(F.col("_r").alias("resolved_norm_count"))),
        (end, F.struct(F.col("_a").alias("entry_count"))),
    )
    # all four in the row, so that a document is processed once; an outer explode for the reason given at masking.region_rows
    rows = [F.struct(stage.alias("stage"), F.to_json(payload).alias("payload"), (start + F.expr(f"interval {k} seconds")).alias("ts")) for k, (stage, payload) in enumerate(events)]
    out = d.select("document_id", F.explode_outer(F.array(*rows)).alias("x")).where("x.stage is not null")
    return custody_events(out, F.col("x.stage"), F.col("x.payload"), F.col("x.ts"))
