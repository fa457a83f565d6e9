"""Document fingerprints as Merkle trees over sections and paragraphs, with DataFrame functions only.

A text is split into sections (at blank lines), paragraphs (lines) and leaves of ``LEAF`` code points. A leaf's digest
is its MD5; a paragraph's node hashes its leaves, a section's node its paragraphs, and the root is the SHA-256 of the
sections' nodes, each with the number of newlines that follow it, so equal roots are equal texts: roots test equality.

The fingerprint is the root and a sketch of the tree to find differences and likeness with: ``root:section;section`` with
``,`` between paragraphs and the first 8 hex digits of a paragraph's leaves in a row. Equal fingerprints are equal texts;
where they differ, differing branches locate the edit (texts that differ in the number of blank lines alone differ in the
root and in no branch).

Edge cases: a null text counts as empty; an empty text has a fingerprint without leaves; a null id is lowest in the
order of ids; rows that repeat an id are ordered by text; a single document is its own next document; other columns
are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from llm.common import stored

LEAF, DIGITS = 48, 8
SECTION_END = "\n\n+"
NO_ID = -(1 << 63)


def tree(text: Column) -> Column:
    """Sections of paragraphs of leaf digests."""

    def leaves(paragraph: Column) -> Column:
        return F.transform(F.regexp_extract_all(paragraph, F.lit(f"[^\\n]{{1,{LEAF}}}"), F.lit(0)), lambda leaf: F.md5(leaf.cast("binary")))

    return F.transform(F.split(text, SECTION_END), lambda section: F.transform(F.split(section, "\n"), leaves))


def shortened(of_tree: Column) -> Column:
    """The tree with the first ``DIGITS`` digits of each leaf."""
    return F.transform(of_tree, lambda s: F.transform(s, lambda p: F.transform(p, lambda leaf: F.substring(leaf, 1, DIGITS))))


def _nodes(of_tree: Column) -> Column:
    """The nodes of the sections."""

    def node(leaves: Column) -> Column:
        return F.md5(F.array_join(leaves, "").cast("binary"))

    return F.transform(of_tree, lambda s: F.md5(F.array_join(F.transform(s, node), "").cast("binary")))


def root(text: Column, of_tree: Column) -> Column:
    """Full leaf digests upward, and the newlines between sections: different texts have different roots."""
    gaps = F.transform(F.regexp_extract_all(text, F.lit(SECTION_END), F.lit(0)), lambda x: F.length(x).cast("string"))
    return F.sha2(F.array_join(F.zip_with(_nodes(of_tree), gaps, lambda n, g: F.concat(n, F.coalesce(g, F.lit("")))), ".").cast("binary"), 256)


def fingerprint(of_root: Column, of_short: Column) -> Column:
    body = F.array_join(F.transform(of_short, lambda s: F.array_join(F.transform(s, lambda p: F.array_join(p, "")), ",")), ";")
    return F.concat_ws(":", of_root, body)


def likeness(a: Column, b: Column) -> Column:
    """Jaccard similarity of the distinct leaves of two trees, 1 for two empty ones."""
    a, b = F.flatten(F.flatten(a)), F.flatten(F.flatten(b))
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / union)


def parsed(of_fingerprint: Column) -> Column:
    """The tree of a fingerprint: sections of paragraphs of leaf digests."""
    body = F.element_at(F.split(of_fingerprint, ":"), 2)
    return F.transform(F.split(body, ";"), lambda s: F.transform(F.split(s, ","), lambda p: F.regexp_extract_all(p, F.lit(f"[0-9a-f]{{{DIGITS}}}"), F.lit(0))))


def differing_branches(pairs: DataFrame, left: str, right: str) -> DataFrame:
    """``(*pairs, section, paragraph, leaf)`` for each leaf at which two fingerprints differ (0-based).

    Equal fingerprints give no row; below their roots only differing sections and paragraphs are opened.
    """
    d = pairs.where(F.split(left, ":")[0] != F.split(right, ":")[0])
    d = d.select(*pairs.columns, F.posexplode(F.arrays_zip(parsed(F.col(left)).alias("l"), parsed(F.col(right)).alias("r"))).alias("section", "s"))
    d = d.where(~F.col("s.l").eqNullSafe(F.col("s.r")))
    none = F.array().cast("array<array<string>>")
    d = d.select(*pairs.columns, "section", F.posexplode(F.arrays_zip(F.coalesce("s.l", none).alias("l"), F.coalesce("s.r", none).alias("r"))).alias("paragraph", "p"))
    d = d.where(~F.col("p.l").eqNullSafe(F.col("p.r")))
    none = F.array().cast("array<string>")
    d = d.select(*pairs.columns, "section", "paragraph", F.posexplode(F.arrays_zip(F.coalesce("p.l", none).alias("l"), F.coalesce("p.r", none).alias("r"))).alias("leaf", "x"))
    return d.where(~F.col("x.l").eqNullSafe(F.col("x.r"))).drop("x")


def _bucket(splits: Column, key: Column) -> Column:
    """Number of ``splits`` (sorted) at or below ``key``, by halving."""
    ends = F.struct(F.lit(0).alias("low"), F.size(splits).alias("high"))

    def halve(at: Column, _: Column) -> Column:
        middle = F.floor((at["low"] + at["high"]) / 2).cast("int")
        right = (at["low"] < at["high"]) & (F.get(splits, middle) <= key)
        left = (at["low"] < at["high"]) & (F.get(splits, middle) > key)
        return F.struct(F.when(right, middle + 1).otherwise(at["low"]).alias("low"), F.when(left, middle).otherwise(at["high"]).alias("high"))

    steps = F.sequence(F.lit(1), F.ceil(F.log2(F.size(splits) + F.lit(1))).cast("int") + 1)
    return F.aggregate(steps, ends, halve, lambda at: at["low"])


def with_next(docs: DataFrame) -> DataFrame:
    """``(doc_id, text, tree, short, next_text, next_short)`` with the next document by descending id, the first after the last.

    Ids are cut into ranges of about equal counts; a window runs in each range, whose last row finds the first
    document of the range below as an extra row. No task holds more than a range. The ranges' bounds and first rows
    are small tables that are joined, so the plan is the same for any number of ranges.
    """
    n_ranges = max(2, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    keyed = docs.select("doc_id", F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("key"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    bounds = keyed.agg(F.percentile_approx("key", [i / n_ranges for i in range(1, n_ranges)], 10_000).alias("_s"))
    bounds = stored(bounds.select(F.array_sort(F.array_distinct(F.coalesce("_s", F.array().cast("array<long>")))).alias("splits")), "ranges")
    placed = keyed.crossJoin(F.broadcast(bounds)).withColumn("bucket", _bucket(F.col("splits"), F.col("key"))).drop("splits")  # one row
    # the first row of each range goes to the range above it too, that of the highest to the lowest
    tops = stored(placed.groupBy("bucket").agg(F.max("key").alias("top")), "tops")  # a row a range
    over = Window.orderBy("bucket")
    lowest = F.min("bucket").over(Window.partitionBy(F.lit(1)))
    goes = tops.select("top", F.coalesce(F.lead("bucket").over(over), lowest).alias("goes"))
    first = keyed.select("key", "text").join(goes, F.col("key") == F.col("top")).groupBy("key", "goes").agg(F.min("text").alias("text"))
    first = first.select(F.lit(None).cast(dict(docs.dtypes)["doc_id"]).alias("doc_id"), "key", "text", F.col("goes").alias("bucket"), F.lit(True).alias("extra"))
    whole = placed.withColumn("extra", F.lit(False)).unionByName(first)
    window = Window.partitionBy("bucket").orderBy("extra", F.desc("key"), "text")
    treed = whole.repartition(n_ranges, "bucket").withColumn("tree", tree(F.col("text")))
    treed = treed.withColumn("short", shortened(F.col("tree")))
    led = treed.withColumn("next_text", F.lead("text").over(window)).withColumn("next_short", F.lead("short").over(window))
    return led.where(~F.col("extra")).select("doc_id", "text", "tree", "short", "next_text", "next_short")


def fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprints of the texts and of their edited forms, see ``op5`` in ``queries``."""
    d = with_next(docs).withColumn("n_chars", F.length("text").cast("long"))
    cut = F.floor(F.col("n_chars") / 3).cast("int")
    d = d.withColumn("edited", F.concat(F.substring(F.col("text"), F.lit(1), F.col("n_chars").cast("int") - cut), F.substring(F.col("next_text"), F.lit(1), cut)))
    d = d.withColumn("root", root(F.col("text"), F.col("tree"))).withColumn("edited_tree", tree(F.col("edited")))
    d = d.withColumn("edited_root", root(F.col("edited"), F.col("edited_tree"))).withColumn("edited_short", shortened(F.col("edited_tree")))
    return d.select(
        "doc_id",
        "n_chars",
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        fingerprint(F.col("root"), F.col("short")).alias("fingerprint"),
        fingerprint(F.col("edited_root"), F.col("edited_short")).alias("edited_fingerprint"),
        likeness(F.col("short"), F.col("edited_short")).alias("near_edited"),
        likeness(F.col("short"), F.col("next_short")).alias("near_next"),
        "root",
        "edited_root",
    )
