"""How filters interact: what each of them removes first, again or alone, in every order of applying them.

``profiles`` reads every text once with the byte transducer (``transducer``) and gives words, distinct words, capitals, code
points and symbols. ``failures`` turns these into the filters that a document fails, and ``audit`` needs only the number of
documents of each part for each set of failed filters: it is at most ``2 ** n`` numbers a part, whatever the table's size.

Filter ``E`` fails documents whose text is that of a document with a smaller id anywhere in the table. Groups of equal
texts are never brought together row by row: counts and smallest ids are added up by SHA-256 of the text, so a text that
a third of all rows share costs one row a part, set of failed filters and task.

Edge cases: a null text is an empty one (it fails A, and C where 0 > 0 is false it doesn't; 0 < 0 is false, so B neither);
a null part is the empty string, and so one with it; a row with a null id is neither smaller nor larger than any other, so it never
fails E and lets no other fail it; rows that repeat an id and a text are equal in id, so neither is smaller; of repeated
labels any that says so counts, null labels say nothing; an empty table has no parts and gives no rows; other columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from llm import transducer as t
from llm.common import small_batches, stored

FILTERS = "ABCDE"
LEAST_WORDS, DISTINCT_PERCENT, CAPITAL_PERCENT = 200, 50, 3
COUNTS = ("words", "distinct_words", "capitals", "points", "symbols")


def profiles(docs: DataFrame, keep: Sequence[str]) -> DataFrame:
    """``(*keep, words, distinct_words, capitals, points, symbols)`` of every row's ``text``, all long."""

    def run(batches):
        for b in batches:
            out = [np.zeros(b.num_rows, np.int64) for _ in COUNTS]
            for s in t.scan(b.column("text")):
                at = slice(s.first, s.first + s.n_docs)
                for column, values in zip(out, (np.diff(s.bounds), t.distinct(s), s.count(t.CAPITAL), s.count(t.POINT), s.count(t.SYMBOL)), strict=True):
                    column[at] = values
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), *map(pa.array, out)], [*keep, *COUNTS])

    kinds = dict(docs.dtypes)
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in keep), *(f"{c} long" for c in COUNTS)])
    return docs.select(*keep, F.col("text").cast("string").alias("text")).mapInArrow(run, schema)


def mask_of_counts() -> Column:
    """The filters A to D that a profile fails, as bits 0 to 3."""
    fails = [
        F.col("words") < LEAST_WORDS,
        100 * F.col("distinct_words") < DISTINCT_PERCENT * F.col("words"),
        100 * F.col("capitals") > CAPITAL_PERCENT * F.col("points"),
        F.col("symbols") > 0,
    ]
    return sum((F.when(f, 1 << i).otherwise(0) for i, f in enumerate(fails)), F.lit(0)).cast("int")


def failures(docs: DataFrame, labels: DataFrame, part: str = "lang") -> DataFrame:
    """``(part, mask, good, toxic, n)``: documents of each part by the filters they fail and by their labels."""
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    d = d.withColumn("digest", F.unhex(F.sha2(F.col("text").cast("binary"), 256)))
    rows = profiles(d, ("doc_id", "part", "digest")).select("doc_id", "part", "digest", mask_of_counts().alias("mask"))
    says = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic"))
    flags = [F.coalesce(c, F.lit(False)).alias(c) for c in ("good", "toxic")]
    none = [F.lit(False).alias(c) for c in ("good", "toxic")]
    spark = docs.sparkSession
    with small_batches(spark):
        rows = stored(rows, "profiles")
    named = rows.where("doc_id is not null").join(says, "doc_id", "left").select("doc_id", "part", "digest", "mask", *flags)
    kinds = ["part", "mask", "good", "toxic"]
    each = stored(named.groupBy("doc_id", "digest", *kinds).agg(F.count(F.lit(1)).alias("n")), "failures")
    first = each.groupBy("digest").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last").select("digest", "first")
    # of a group of equal texts and kind, the row of its smallest id stays if that is the smallest of all
    groups = each.groupBy("digest", *kinds).agg(F.sum("n").alias("n"), F.min(F.struct("doc_id", "n")).alias("least")).join(first, "digest", "left")
    stays = F.when(F.col("first").isNull(), F.col("n")).when(F.col("least.doc_id") == F.col("first"), F.col("least.n")).otherwise(0)
    both = F.array(F.struct(F.col("mask").alias("mask"), stays.alias("n")), F.struct(F.col("mask").bitwiseOR(F.lit(16)).alias("mask"), (F.col("n") - stays).alias("n")))
    counted = groups.select("part", "good", "toxic", F.explode(both).alias("x")).select("part", "x.mask", "good", "toxic", "x.n")
    counted = counted.unionByName(rows.where("doc_id is null").select("part", "mask", *none, F.lit(1).cast("long").alias("n")))
    return counted.repartition(*kinds).groupBy(*kinds).agg(F.sum("n").alias("n")).where("n > 0")


def audit(counts: DataFrame, filters: str = FILTERS) -> DataFrame:
    """The audit of every order of ``filters`` from ``counts(part, mask, good, toxic, n)``: one row a part, order and step."""
    kinds = F.collect_list(F.struct("mask", "good", "toxic", "n"))  # at most 4 * 2 ** len(filters) of them
    parts = counts.groupBy("part").agg(kinds.alias("kinds"))
    orders = F.explode(F.array(*[F.lit("".join(o)) for o in permutations(filters)]))
    r = parts.select("part", "kinds", orders.alias("filter_order"))
    r = r.select("part", "kinds", "filter_order", F.explode(F.sequence(F.lit(1), F.lit(len(filters)))).alias("step"))
    place = lambda letters: F.aggregate(F.filter(F.split(letters, ""), lambda x: x != ""), F.lit(0), lambda acc, x: acc + F.element_at(F.create_map(*[F.lit(v) for i, f in enumerate(filters) for v in (f, 1 << i)]), x))
    r = r.withColumn("bit", place(F.substring("filter_order", F.col("step"), F.lit(1)))).withColumn("earlier", place(F.substring("filter_order", F.lit(1), F.col("step") - 1)))
    zero = F.lit(0).cast("long")

    def total(which, value=lambda k: k["n"]) -> Column:
        return F.aggregate(F.filter("kinds", which), zero, lambda acc, k: acc + value(k))

    fails = lambda k: k["mask"].bitwiseAND(F.col("bit")) != 0
    before = lambda k: k["mask"].bitwiseAND(F.col("earlier")) != 0
    removed = lambda k: fails(k) & ~before(k)
    n_orders = int(np.prod(range(1, len(filters) + 1)))
    # a document that fails k filters is removed by each of them in one k-th of the orders
    share = lambda k: F.lit(n_orders).cast("long") * k["n"] / F.greatest(F.bit_count(k["mask"]), F.lit(1))
    return r.select(
        "part",
        "filter_order",
        "step",
        total(lambda k: ~fails(k) & ~before(k)).alias("kept"),
        total(removed).alias("removed"),
        total(lambda k: fails(k) & before(k)).alias("redundant"),
        total(lambda k: k["mask"] == F.col("bit")).alias("unique_fails"),
        total(lambda k: removed(k) & k["good"]).alias("good_lost"),
        total(lambda k: removed(k) & k["toxic"]).alias("toxic_lost"),
        total(fails, lambda k: share(k).cast("long")).alias("shapley"),
    )
