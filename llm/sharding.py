"""Shards that all have the mixture of the whole: proportional stratified interleaving, with DataFrame functions.

Rows are shuffled by a seeded hash and ranked within their source; a row's fractional rank is its rank, moved by a phase of
its source's own, over the source's rows. Sorted by fractional rank, every stretch of the table holds each source in
its share (within one row), so equal cuts give shards of the whole mixture whose counts are at most one apart. The phase keeps many small
sources from meeting in the middle.

Both sorts are of two levels: hashes and fractional ranks fall into buckets of about equal counts, bucket totals are
added up, and windows number the rows inside of a bucket only. No source, however hot, is held in one task. Rows that
repeat each other in id, source, size and checksum are one row with a count until they have their ranks.

Edge cases: a null text has no bytes, so size 1 and checksum 0, like an empty one; a null source is a source of its own, last in ties;
a null id is hashed as none; rows that repeat an id are told apart by checksum and size, and those that are equal in all of it are
interchangeable; fewer rows than shards leave shards empty; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from llm.common import stored

SHARDS, SEED = 16, "interleave"
BUCKET_ROWS, LEAST_BUCKETS, EXPLODED = 65_536, 128, 4096
_ROW = ("doc_id", "source", "size", "text_crc32")


def digest_columns() -> list[Column]:
    """Size (UTF-8 bytes and one) and checksum of the text."""
    text = F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")
    return [(F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).cast("long").alias("text_crc32")]


def _key(*parts: Column) -> Column:
    return F.md5(F.concat_ws("|", *parts).cast("binary"))


def _fraction(of_hex: Column) -> Column:
    """The first 52 bits of a hash, as a fraction."""
    return F.conv(F.substring(of_hex, 1, 13), 16, 10).cast("long").cast("double") / float(1 << 52)


def fractional_ranks(rows: DataFrame, n_buckets: int, seed: str) -> DataFrame:
    """``(*_ROW, key, rank, copies, n)``: the rank from 0 of the first of ``copies`` equal rows among the ``n`` of the source."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    r = rows.withColumn("key", _key(F.lit(seed), text("doc_id"), text("text_crc32"), text("size")))
    r = r.withColumn("bucket", F.floor(_fraction(F.col("key")) * n_buckets).cast("int")).withColumn("named", F.col("source").isNotNull()).withColumn("name", text("source"))
    cell = ["named", "name", "bucket"]
    source = Window.partitionBy("named", "name")
    place = r.groupBy(*cell).agg(F.sum("copies").alias("held"))
    place = place.select(*cell, (F.sum("held").over(source.orderBy("bucket")) - F.col("held")).alias("offset"), F.sum("held").over(source).alias("n"))
    inside = Window.partitionBy(*cell).orderBy("key", "doc_id", "text_crc32", "size")
    r = r.withColumn("inside", F.sum("copies").over(inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("copies"))
    return r.join(place, cell).select(*_ROW, "key", (F.col("offset") + F.col("inside")).alias("rank"), "copies", "n")


def interleaved(docs: DataFrame, n_shards: int = SHARDS, seed: str = SEED) -> DataFrame:
    """``(doc_id, source, size, text_crc32, shard, slot)`` for every row: slots count from 0 in each shard without gaps."""
    n_rows = docs.count()
    n_buckets = max(LEAST_BUCKETS, n_rows // BUCKET_ROWS)
    rows = docs.select("doc_id", F.col("source").cast("string").alias("source"), *digest_columns()).groupBy(*_ROW).agg(F.count(F.lit(1)).alias("copies"))
    r = fractional_ranks(stored(rows, "rows"), n_buckets, seed)
    # equal rows get their own ranks; no array grows with their number
    last = F.col("copies") - 1
    r = r.withColumn("high", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(last / EXPLODED))))
    r = r.withColumn("low", F.explode(F.sequence(F.lit(0).cast("long"), F.least(F.lit(EXPLODED - 1).cast("long"), last - F.col("high") * EXPLODED))))
    rank = F.col("rank") + F.col("high") * EXPLODED + F.col("low")
    phase = _fraction(_key(F.lit(seed), F.coalesce("source", F.lit(""))))
    r = r.select(*_ROW, "key", rank.alias("rank"), ((rank.cast("double") + phase) / F.col("n")).alias("at"))
    r = r.withColumn("bucket", F.least(F.floor(F.col("at") * n_buckets).cast("int"), F.lit(n_buckets - 1)))
    r = stored(r, "ranked")
    offsets = r.groupBy("bucket").agg(F.count(F.lit(1)).alias("held"))
    # one row a bucket of BUCKET_ROWS rows
    offsets = offsets.select("bucket", (F.sum("held").over(Window.orderBy("bucket")) - F.col("held")).alias("offset"))
    inside = Window.partitionBy("bucket").orderBy("at", F.col("source").isNull(), "source", "key", "doc_id", "rank")
    r = r.withColumn("inside", F.row_number().over(inside) - 1).join(offsets, "bucket").withColumn("position", F.col("offset") + F.col("inside"))
    r = r.withColumn("shard", F.expr(f"cast(position * {n_shards} div {max(1, n_rows)} as int)"))
    begins = F.expr(f"(shard * {n_rows}L + {n_shards - 1}) div {n_shards}")
    return r.select(*_ROW, "shard", (F.col("position") - begins).cast("long").alias("slot"))


def write_shards(docs: DataFrame, placed: DataFrame, path: str, files: int | None = None) -> None:
    """Writes ``(doc_id, source, text, shard, slot)`` as Parquet, a folder a shard and files in the order of slots.

    Texts meet their places by id, source, size and checksum. A shard is cut into files by ranges of slots, so no task
    writes a whole shard; ``files`` is the number of ranges (the session's shuffle partitions by default).
    """
    n = files or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    texts = docs.select("doc_id", F.col("source").cast("string").alias("source"), "text", *digest_columns()).dropDuplicates(list(_ROW))
    keys = {"doc_id": "_id", "source": "_source", "size": "_size", "text_crc32": "_crc32"}
    p = placed.select(*(F.col(c).alias(k) for c, k in keys.items()), "shard", "slot")
    same = [F.col(c).eqNullSafe(F.col(k)) for c, k in keys.items()]
    whole = p.join(texts, same[0] & same[1] & same[2] & same[3]).select("doc_id", "source", "text", "shard", "slot")
    whole.repartitionByRange(n, "shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
