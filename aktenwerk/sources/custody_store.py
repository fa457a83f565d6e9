"""The store of custody chains: segments that are staged, verified and published by one rename, and a table of heads.

``store/v=0``, ``store/v=1``, ... are the published segments, one for each append, as Parquet: ``spark.read.parquet(store)`` gives all
events with ``v``. ``store/_heads/v=n`` has the heads of the chains that segment n goes on, with the segments that hold
each chain's last events; readers of the store don't see it, nor what is being staged in ``store/_staged``.

An append reads the heads of its chains and, of the events, only the segments that hold their tails. It writes a
segment, verifies it against the heads, and renames it to the number after the one it began with; the rename fails where
another writer has published that number (``FileContext.rename`` without overwriting, which is atomic where the file system's is). Until then the store is as it was.
If a writer ends between the rename and its heads, the next one computes these from the segment.
"""

from __future__ import annotations

import re
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from aktenwerk.operators.custody import TAIL, TERMINAL, append_chain, chain_breaks, tail_breaks

#: After so many segments the heads of all chains are written again.
SNAPSHOT = 16


class ConcurrentAppend(ValueError):
    """Another writer has published the version that this append was to become."""


def _files(spark: SparkSession, path: str) -> tuple:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    conf = spark._jsparkSession.sessionState().newHadoopConf()
    return p, p.getFileSystem(conf), conf


def versions(spark: SparkSession, path: str) -> list[int]:
    """The numbers of the segments below ``path``."""
    p, fs, _ = _files(spark, path)
    if not fs.exists(p):
        return []
    found = (re.fullmatch(r"v=(\d+)", f.getPath().getName()) for f in fs.listStatus(p))
    return sorted(int(m[1]) for m in found if m)


def _rename(spark: SparkSession, source: str, target: str) -> bool:
    """Gives ``source`` the new name; false if there is something of that name."""
    to, fs, conf = _files(spark, target)
    fs.mkdirs(to.getParent())
    none = spark._sc._gateway.new_array(spark._jvm.org.apache.hadoop.fs.Options.Rename, 0)
    try:
        spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(to.toUri(), conf).rename(_files(spark, source)[0], to, none)
    except Exception as e:
        if "FileAlreadyExistsException" not in str(e):
            raise
        return False
    return True


def read(spark: SparkSession, store: str, only: list[int] | None = None) -> DataFrame | None:
    """The published events, or those of some segments; None if there are none."""
    there = versions(spark, store) if only is None else only
    return spark.read.option("basePath", store).parquet(*[f"{store}/v={v}" for v in there]) if there else None


def _after(events: DataFrame, v: int, before: DataFrame | None, k: int) -> DataFrame:
    """Heads of the chains that segment ``v`` goes on: ``(chain_id, sequence_number, event_hash, recent)``; ``recent`` has the
    segments (with the last number in each) that hold the last ``k`` events and their predecessor."""
    new = events.groupBy("chain_id").agg(F.max("idx").alias("sequence_number"), F.max_by("event_hash", "idx").alias("event_hash"))
    none = F.array().cast("array<struct<v:int,last:bigint>>")
    own = F.array(F.struct(F.lit(v).alias("v"), F.col("sequence_number").cast("long").alias("last")))
    old = new.withColumn("_old", none) if before is None else new.join(before.select("chain_id", F.col("recent").alias("_old")), "chain_id", "left")
    recent = F.filter(F.concat(F.coalesce("_old", none), own), lambda r: r["last"] >= F.col("sequence_number") - k)
    return old.select("chain_id", "sequence_number", "event_hash", recent.alias("recent"))


def heads(spark: SparkSession, store: str, k: int = TAIL) -> DataFrame | None:
    """The head of every chain, from the last snapshot and the heads written after it; None if nothing is stored."""
    there, told = versions(spark, store), versions(spark, f"{store}/_heads")
    if not there:
        return None
    whole = [v for v in told if v % SNAPSHOT == 0]
    since = whole[-1] if whole else -1
    parts = [v for v in told if v >= since]
    now = _latest(spark.read.parquet(*[f"{store}/_heads/v={v}" for v in parts])) if parts else None
    for v in there:  # segments whose writer ended before it wrote their heads
        if v not in told:
            late = _after(read(spark, store, [v]), v, now, k)
            now = late if now is None else _latest(now.unionByName(late))
    return now


def _latest(heads: DataFrame) -> DataFrame:
    rest = F.struct("sequence_number", "event_hash", "recent")
    return heads.groupBy("chain_id").agg(F.max_by(rest, "sequence_number").alias("h")).select("chain_id", "h.*")


@dataclass
class Staged:
    """A verified segment that waits for its publication as ``version``; ``path`` is None if there is nothing to append."""

    store: str
    version: int
    path: str | None
    heads: DataFrame | None
    k: int


def stage(events: DataFrame, store: str, k: int = TAIL) -> Staged:
    """Chains the events that the store lacks behind the stored heads, as a segment outside the published ones, and verifies it.

    CHN-4: raises if the tail of one of the chains doesn't verify, or ends with another event than the head says, or if the
    new segment doesn't verify. The store is then as it was.
    """
    spark = events.sparkSession
    there = versions(spark, store)
    version = there[-1] + 1 if there else 0
    own = None
    if there:
        chains = events.select("chain_id").distinct()
        own = heads(spark, store, k).join(chains, "chain_id", "left_semi")
        tails = {r["v"] for r in own.select(F.explode("recent.v").alias("v")).distinct().collect()}  # numbers of segments
        held = read(spark, store, sorted(tails & set(there)) or there[-1:])  # of a lost segment, the heads tell
        broken = tail_breaks(held, own, k).take(1)
        if broken:
            raise ValueError(f"the stored custody chains don't verify; nothing was appended: chain {broken[0]['chain_id']} breaks at {broken[0]['idx']}: {broken[0]['reason']}")
        events = events.join(read(spark, store).select("event_id"), "event_id", "left_anti")
    path = f"{store}/_staged/{uuid.uuid4().hex}"
    append_chain(events, own).withColumn("idx", F.col("sequence_number")).write.parquet(path)
    segment = spark.read.parquet(path)
    staged = Staged(store, version, path, own, k)
    if segment.isEmpty():
        drop(spark, staged)
        staged.path = None
    elif broken := chain_breaks(segment, own).take(1):
        drop(spark, staged)
        raise ValueError(f"the new events don't verify; nothing was appended: chain {broken[0]['chain_id']} at {broken[0]['idx']}: {broken[0]['reason']}")
    return staged


def drop(spark: SparkSession, staged: Staged) -> None:
    """Deletes a staged segment."""
    path, fs, _ = _files(spark, staged.path)
    fs.delete(path, True)


def publish(spark: SparkSession, staged: Staged) -> None:
    """Makes a staged segment the next version of the store, then writes its heads."""
    if staged.path is None:
        return
    target = f"{staged.store}/v={staged.version}"
    if versions(spark, staged.store)[-1:] != ([staged.version - 1] if staged.version else []) or not _rename(spark, staged.path, target):
        drop(spark, staged)
        raise ConcurrentAppend(f"another writer has published version {staged.version}; nothing was appended")
    new = _after(read(spark, staged.store, [staged.version]), staged.version, staged.heads, staged.k)
    if staged.version % SNAPSHOT == 0 and (whole := heads(spark, staged.store, staged.k)) is not None:
        new = whole
    path = f"{staged.store}/_staged/{uuid.uuid4().hex}"
    new.write.parquet(path)
    _rename(spark, path, f"{staged.store}/_heads/v={staged.version}")


def append(events: DataFrame, store: str, k: int = TAIL, tries: int = 3) -> DataFrame | None:
    """Stages and publishes; if another writer was faster, again behind its events. Returns the stored events."""
    for left in reversed(range(tries)):
        try:
            publish(events.sparkSession, stage(events, store, k))
            break
        except ConcurrentAppend:
            if not left:
                raise
    return read(events.sparkSession, store)


def deliver(briefings: DataFrame, events: DataFrame, store: str, out: str) -> DataFrame:
    """CHN-6: appends the events that the store lacks, and only then writes briefings with a stored completion event.

    If the stored tails or the new events don't verify, or another writer is in the way, nothing is appended and no briefing
    written. Event ids are deterministic, so a rerun after a failure appends what is missing and delivers the rest.
    """
    stored = append(events, store)
    ids = briefings.select(F.col("document_id").cast("string").alias("_done"))
    done = ids.limit(0) if stored is None else stored.where(F.col("event_type").isin(*TERMINAL[:2])).select(F.col("document_id").alias("_done")).distinct()
    delivered = briefings.join(done, briefings["document_id"].cast("string") == done["_done"], "left_semi")
    delivered.write.mode("overwrite").json(out, ignoreNullFields=False)
    return delivered
