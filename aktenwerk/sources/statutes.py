"""Statute corpora: scans of law XML, chunks, dimension tables, identifiers and profiles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from aktenwerk.functions.fixed import CATALOG, LAWS
from aktenwerk.functions.text import squeezed, stripped


def _norms(spark: SparkSession, path: str) -> DataFrame:
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), "value")
    norms = files.select("file", F.posexplode(F.regexp_extract_all("value", F.lit(r"(?s)<norm[ >].*?</norm>"), F.lit(0))).alias("position", "x"))
    one = lambda p: squeezed(F.xpath_string("x", F.lit(f"norm/metadaten/{p}")))
    law = F.when(one("amtabk") != "", one("amtabk")).otherwise(one("jurabk"))
    return norms.select("file", "position", "x", law.alias("gesetz"), one("enbez").alias("enbez"), one("titel").alias("title"))


def _joined(x: str, path: str) -> Column:
    """Text nodes in order, each stripped, blank ones left out."""
    nodes = F.transform(F.xpath(F.col(x), F.lit(path)), stripped)
    return F.array_join(F.filter(nodes, lambda t: t != ""), " ")


def _paragraphs(norms: DataFrame) -> DataFrame:
    text = _joined("x", "norm/textdaten/text/Content//text()")
    p = norms.where(F.col("enbez").rlike(r"^§\s*\d")).withColumn("text", text)
    p = p.where((F.col("text") != "") & ~F.lower(F.col("text")).startswith("(weggefallen)") & ~F.lower(F.col("title")).contains("(weggefallen)"))
    return p.withColumn("paragraph", F.regexp_extract("enbez", r"^§\s*(\d+\s?[a-z]?)", 1)).withColumn("paragraph", F.replace("paragraph", F.lit(" "), F.lit("")))


def read_statutes(spark: SparkSession, path: str) -> DataFrame:
    """SRC-1: one row for each real paragraph: ``(file, position, gesetz, paragraph, canonical_key, title, text)``."""
    key = F.concat(F.lit("§ "), F.col("paragraph"), F.lit(" "), F.col("gesetz"))
    return _paragraphs(_norms(spark, path)).select("file", "position", "gesetz", "paragraph", key.alias("canonical_key"), "title", "text")


def read_statute_chunks(spark: SparkSession, path: str) -> DataFrame:
    """SRC-2: one row for each ``<P>``: ``(chunk_id, gesetz, paragraph, absatz, text)``; ids end in ``_absN`` for ``(N) ...``."""
    p = _paragraphs(_norms(spark, path))
    body = F.regexp_extract_all("x", F.lit(r"(?s)<P[ >].*?</P>"), F.lit(0))
    c = p.select("gesetz", "paragraph", F.posexplode(body).alias("n", "px"))
    c = c.withColumn("text", F.array_join(F.filter(F.transform(F.xpath("px", F.lit("P//text()")), stripped), lambda t: t != ""), " ")).where("text <> ''")
    absatz = F.nullif(F.regexp_extract("text", r"^\((\d+)\)", 1), F.lit(""))
    start = F.concat(F.lower("gesetz"), F.lit("_§"), F.col("paragraph"))
    return c.select(
        F.concat(start, F.coalesce(F.concat(F.lit("_abs"), absatz), F.lit(""))).alias("chunk_id"), "gesetz", "paragraph", absatz.alias("absatz"),
        F.concat(F.lit("§ "), F.col("paragraph"), F.lit(" "), F.col("gesetz"), F.lit(" – "), F.col("text")).alias("text"),
    )


def latest(statutes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Statutes with unique keys (the last by file and position wins), and the duplicate keys with their counts."""
    w = Window.partitionBy("canonical_key").orderBy(F.desc("file"), F.desc("position"))
    unique = statutes.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
    return unique, statutes.groupBy("canonical_key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def catalog(spark: SparkSession) -> DataFrame:
    """SRC-11: ``(catalog_id, beschreibung, gesetz)``."""
    return spark.createDataFrame([(k, v, law) for (k, v), law in zip(CATALOG.items(), LAWS, strict=True)], "catalog_id string, beschreibung string, gesetz string")


#: Rows of a leaf of the tree of hashes, about.
LEAF_ROWS = 65_536


def corpus_id(statutes: DataFrame, buckets: int = 256, leaf_rows: int = LEAF_ROWS) -> DataFrame:
    """AGG-10: one row ``corpus_id``: changes with any key or text, not with the order of rows.

    Rows are hashed and dealt to the leaves of a tree whose nodes have ``buckets`` children; a leaf's hashes are sorted and
    hashed, and so are each node's children. The number of rows decides the depth, so that leaves hold about ``leaf_rows`` at
    most and no row of the job grows with the corpus.
    """
    row = F.sha2(F.concat(F.col("canonical_key"), F.lit("\0"), F.col("text"), F.lit("\0")).cast("binary"), 256)
    depth, n = 1, statutes.count()
    while buckets**depth * leaf_rows < n:
        depth += 1
    levels = [f"b{k}" for k in range(depth)]
    h = statutes.select(row.alias("h"))
    h = h.select("h", *((F.conv(F.substring("h", 4 * k + 1, 4), 16, 10).cast("int") % buckets).alias(b) for k, b in enumerate(levels)))
    nodes = h.groupBy(*levels).agg(F.sha2(F.array_join(F.array_sort(F.collect_list("h")), "").cast("binary"), 256).alias("h"))
    for k in reversed(range(depth)):
        listed = F.array_sort(F.collect_list(F.struct(levels[k], "h")))
        joined = F.array_join(F.transform(listed, _child(levels[k])), "")
        nodes = nodes.groupBy(*levels[:k]).agg(F.sha2(joined.cast("binary"), 256).alias("h"))
    return nodes.select(F.col("h").alias("corpus_id"))


def _child(level: str) -> Callable[[Column], Column]:
    return lambda x: F.concat_ws(":", x[level].cast("string"), x["h"])


def corpus_profile(statutes: DataFrame) -> DataFrame:
    """AGG-11: paragraphs, titled paragraphs and duplicate keys per law."""
    s = statutes.groupBy("gesetz", "canonical_key").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.coalesce("title", F.lit("")) != "").alias("t"))
    return s.groupBy("gesetz").agg(F.sum("n").alias("paragraphs"), F.sum("t").alias("titled"), F.count_if(F.col("n") > 1).alias("duplicate_keys"))
