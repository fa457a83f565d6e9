"""Structured Streaming: ingestion, stateful chains, alert windows, duplicate events."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, TimerValues

from aktenwerk.functions.fixed import GENESIS, UNRESOLVED_LIMIT, VERIFICATION_LIMIT
from aktenwerk.operators.citations import citations
from aktenwerk.operators.custody import canonical_text
from aktenwerk.operators.gates import ingest_reason
from aktenwerk.operators.masking import masked_documents


PROVIDER, ROCKSDB = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def run_available(stream: DataFrame, out: str, checkpoint: str, mode: str = "append") -> None:
    """Processes what is there and stops; ``out`` becomes a parquet table. State is kept in RocksDB and the checkpoint."""
    conf = stream.sparkSession.conf
    was = conf.get(PROVIDER, None)
    conf.set(PROVIDER, ROCKSDB)
    try:
        stream.writeStream.format("parquet").outputMode(mode).option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    finally:
        conf.unset(PROVIDER) if was is None else conf.set(PROVIDER, was)


def ingest(docs: DataFrame, plugins: tuple = ()) -> DataFrame:
    """STR-1: a stream of ``(document_id, text)`` through the gate, masked, with the citations of the masked text.

    ``(document_id, n_chars, clean_text, entity_counts, citations)``; masking is row-wise (``masking.masked_documents``, with
    plug-in detectors), so the stream keeps no state. Raw texts and their names don't leave the job.
    """
    clean = masked_documents(docs.where(ingest_reason(F.col("text")).isNull()).select("document_id", "text"), plugins)
    return clean.select("document_id", F.length("text").alias("n_chars"), "clean_text", "entity_counts", citations(F.col("clean_text")).alias("citations"))


CHAINED = "chain_id string, event_id string, sequence_number long, event_hash string"


class ChainProcessor(StatefulProcessor):
    """The state of one chain: its head, and the events that wait for the watermark to pass them."""

    def __init__(self, step: int) -> None:
        self.step = step

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.head = handle.getValueState("head", "event_hash string, sequence_number long")
        self.waiting = handle.getListState("waiting", "at long, event_id string, front string, back string")

    def handleInputRows(self, key: tuple, rows: Iterator, timerValues: TimerValues) -> Iterator:
        first = None
        for f in rows:
            self.waiting.appendList(list(f[["at", "event_id", "front", "back"]].itertuples(index=False, name=None)))
            least = int(f["at"].min())
            first = least if first is None else min(first, least)
        if first is not None:
            self.handle.registerTimer(first // 1000 + 1)
        return iter(())

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator:
        import pandas as pd

        mark = timerValues.getCurrentWatermarkInMs() * 1000
        due, rest = [], []
        for row in self.waiting.get():
            (due if row[0] < mark else rest).append(tuple(row))
        if not due:
            return
        if rest:
            self.waiting.put(rest)
            self.handle.registerTimer(min(r[0] for r in rest) // 1000 + 1)
        else:
            self.waiting.clear()
        head, number = self.head.get() if self.head.exists() else (GENESIS, -1)
        due.sort(key=lambda r: r[:2])
        for i in range(0, len(due), self.step):
            out = []
            for _, event_id, front, back in due[i : i + self.step]:
                number += 1
                head = hashlib.sha256((front + str(number) + back + head).encode()).hexdigest()
                out.append((key[0], event_id, number, head))
            yield pd.DataFrame(out, columns=["chain_id", "event_id", "sequence_number", "event_hash"])
        self.head.update((head, number))

    def close(self) -> None:
        pass


def chain(events: DataFrame, delay: str = "1 hour", step: int = 10_000) -> DataFrame:
    """STR-2: a stream of events, numbered and hashed per chain in the order of time and id, as the batch does.

    Events wait in the state store (a list per chain, beside its head) until the watermark, ``delay`` behind the newest event
    of all, has passed them; so rows that come late within ``delay`` take their places, whatever the triggers. Later ones are not lost: they
    are appended behind what has left already. The newest events leave once later ones, of any chain, have come.
    A task holds what waits in one chain, which a bounded trigger (``maxFilesPerTrigger`` of the source) and ``delay`` bound;
    nothing is kept outside the state store.

    The sequence number is part of the canonical text, which comes in two halves around it: what stands before the last
    mark for it, as no key that follows it in the order of keys holds text from outside. Events without a chain or time
    are left out.
    """
    mark = "#sequence#"
    marked = events.where("chain_id is not null and ts is not null").withColumn("sequence_number", F.lit(mark))
    whole = canonical_text(marked)
    back = F.substring_index(whole, mark, -1)
    front = F.substring(whole, F.lit(1), F.length(whole) - F.length(back) - len(mark))
    # the time as a number is no event-time column, so that Spark doesn't drop rows that come after the watermark
    texts = marked.withWatermark("ts", delay).select(F.col("chain_id").cast("string").alias("chain_id"), F.col("event_id").cast("string").alias("event_id"), F.unix_micros("ts").alias("at"), front.alias("front"), back.alias("back"))
    return texts.groupBy("chain_id").transformWithStateInPandas(ChainProcessor(step), CHAINED, "append", "eventTime")


def alerts(samples: DataFrame, delay: str = "1 hour", size: str = "1 hour") -> DataFrame:
    """STR-3: per window of event time, the unresolved ratio, the verification failure rate and failed audit writes with
    their alerts. ``samples(ts, unresolved, citations, failures, arguments, failed_writes)``; late rows are dropped."""
    w = samples.withWatermark("ts", delay).groupBy(F.window("ts", size)).agg(*(F.sum(c).alias(c) for c in ("unresolved", "citations", "failures", "arguments", "failed_writes")))
    ratio = F.try_divide(F.col("unresolved").cast("double"), F.col("citations"))
    rate = F.try_divide(F.col("failures").cast("double"), F.col("arguments"))
    return w.select(
        F.col("window.start").alias("window_start"), ratio.alias("unresolved_ratio"), rate.alias("failure_rate"), "failed_writes",
        F.coalesce(ratio > UNRESOLVED_LIMIT, F.lit(False)).alias("unresolved_alert"), F.coalesce(rate > VERIFICATION_LIMIT, F.lit(False)).alias("verification_alert"), (F.col("failed_writes") > 0).alias("audit_alert"),
    )


def distinct_events(events: DataFrame, horizon: str = "1 hour") -> DataFrame:
    """STR-4 (an option): repeated event ids within the horizon are dropped."""
    return events.withWatermark("ts", horizon).dropDuplicatesWithinWatermark(["event_id"])
