"""Mixing sources to target weights by Efraimidis-Spirakis sampling, with DataFrame functions only.

Every document gets the key ``-ln(u) / weight`` with ``u`` from a hash of its id, so that reruns agree. Within a source
the documents are taken in key order: complete epochs first, then documents until the rest of the target is filled
(the last one in part). Running sums are two-level: keys fall into buckets, bucket totals are summed per source, and
windows run inside (source, bucket) only, so that a hot source is spread over many tasks.

Edge cases: a null or blank text has size 0 and nothing is taken of it; a null source is a source of its own, sorted
last; a null id gets the key of the empty text; repeated rows are separate documents with equal keys, and rows that
repeat an id with other texts are taken by rising size, then in an order by content, so that reruns agree on them too; no
documents or only empty ones give targets of 0; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from llm.common import WORD

#: Weights of the sources in code-point order, repeating; a source is repeated at most this often.
SHARES, MOST = (5, 2, 1), 3
#: Weights by quality label: good, unlabelled, poor.
GOOD, UNKNOWN, POOR = 4.0, 2.0, 1.0
BUCKET_ROWS, LEAST_BUCKETS = 65_536, 128


def quality_weights(labels: DataFrame) -> DataFrame:
    """``(doc_id, weight)`` from quality labels; of repeated labels the best counts."""
    best = labels.where("doc_id is not null").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    return best.select("doc_id", F.when(F.col("quality") == 1, GOOD).when(F.col("quality") == 0, POOR).otherwise(UNKNOWN).alias("weight"))


def targets(sizes: DataFrame) -> DataFrame:
    """Adds ``target`` to ``(source, source_size)``, one row a source: shares by weight, at most ``MOST`` times the size,
    the excess shared among the others by weight (sources by rising ``MOST * size / weight`` are capped while their
    cap is below what the rest would give them)."""
    order = Window.orderBy(F.col("source").isNull(), F.col("source"))
    share = F.element_at(F.array(*map(F.lit, SHARES)), (F.pmod(F.row_number().over(order) - 1, F.lit(len(SHARES))) + 1).cast("int"))
    s = sizes.withColumn("share", share.cast("double")).withColumn("cap", MOST * F.col("source_size").cast("double"))
    rising = Window.orderBy(F.col("cap") / F.col("share"), F.col("source").isNull(), F.col("source"))
    every = Window.partitionBy(F.lit(1))
    before = F.coalesce(F.sum("cap").over(rising.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    left = F.sum("share").over(rising.rowsBetween(0, Window.unboundedFollowing))
    s = s.withColumn("level", (F.sum("source_size").over(every) - before) / left)
    s = s.withColumn("capped", F.col("cap") / F.col("share") <= F.col("level"))
    rest = F.sum("source_size").over(every) - F.coalesce(F.sum(F.when(F.col("capped"), F.col("cap"))).over(every), F.lit(0.0))
    open_share = F.sum(F.when(~F.col("capped"), F.col("share"))).over(every)
    return s.withColumn("target", F.when(F.col("capped"), F.col("cap")).otherwise(F.col("share") * (rest / open_share))).select("source", "source_size", "target")


def mix(docs: DataFrame, weights: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """``(doc_id, size, source_size, target, taken, source, *keep)`` for every row of ``docs``."""
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    # rows that repeat an id come in the order of their size and content; rows that agree in all of it are alike
    base = docs.select("doc_id", "source", *keep, size.alias("size"), F.xxhash64("text", *(c for c in keep if c != "text")).alias("content"))
    base = base.join(weights, "doc_id", "left")
    # 52 bits of a hash of the id, in (0, 1)
    bits = F.conv(F.substring(F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), 1, 13), 16, 10).cast("double")
    base = base.withColumn("key", -F.log((bits + 0.5) / float(1 << 52)) / F.coalesce("weight", F.lit(UNKNOWN)))
    base = base.withColumn("named", F.col("source").isNotNull()).withColumn("name", F.coalesce("source", F.lit("")))
    n_buckets = max(LEAST_BUCKETS, docs.count() // BUCKET_ROWS)
    # 1 - exp(-key) rises with the key and is nearly uniform
    base = base.withColumn("bucket", F.floor((1 - F.exp(-F.col("key"))) * n_buckets))
    sums = base.groupBy("named", "name", "bucket").agg(F.sum("size").alias("bucket_size"))
    by_source = Window.partitionBy("named", "name")
    offsets = sums.withColumn("offset", F.sum("bucket_size").over(by_source.orderBy("bucket")) - F.col("bucket_size"))
    per_source = sums.groupBy("named", "name").agg(F.sum("bucket_size").alias("source_size"))
    aimed = targets(per_source.select(F.when(F.col("named"), F.col("name")).alias("source"), "source_size"))
    aimed = aimed.select(F.col("source").isNotNull().alias("named"), F.coalesce("source", F.lit("")).alias("name"), "source_size", "target")
    place = offsets.join(aimed, ["named", "name"]).drop("bucket_size")
    inside = Window.partitionBy("named", "name", "bucket").orderBy("key", "doc_id", "size", "content").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    run = base.withColumn("run", F.sum("size").over(inside) - F.col("size")).join(place, ["named", "name", "bucket"])
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    rest = F.floor("target") - epochs * F.col("source_size") - F.col("offset") - F.col("run")
    taken = epochs * F.col("size") + F.greatest(F.lit(0), F.least(rest, F.col("size")))
    return run.select("doc_id", "size", "source_size", "target", taken.cast("long").alias("taken"), "source", *keep)
