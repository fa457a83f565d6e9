"""A training-data pipeline of five operators: every stage is written as a table and read again by the next.

toxicity and quality reject documents, the n-gram Jaccard join keeps one document of each group (the one with the
smallest id; rows with a null id belong to no group and stay), decontamination rejects documents that hold a benchmark
item, and mixing returns the documents that the mix takes with their words.

Edge cases: a null text counts as empty (it is neither toxic nor contaminated); rows with a null id stay in the near-duplicate
stage; of rows that repeat an id one stays there, the least by text, language, source and length; without labels no document is
rejected as toxic or poor, and without benchmark items none as contaminated; columns besides those of documents are dropped
at the start, whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from llm import decontaminate, jaccard_join, mixing, quality, toxicity
from llm.common import stored, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents that the toxicity classifier scores at 0.5 or more."""
    labels = table(spark, sf_dir, "labels").where(~toxicity.fold())
    model = toxicity.train(docs.where(~toxicity.fold()), labels)
    return toxicity.score(docs, model, COLUMNS).where("score < 0.5").select(*COLUMNS)


def drop_poor(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents that the quality classifier scores below 0.5."""
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    return quality.score(docs, model, COLUMNS).where("score >= 0.5").select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each component of the n-gram Jaccard join."""
    first = jaccard_join.jaccard_components(docs).where("doc_id = component_id").select("doc_id").distinct()
    # of rows that repeat the id, the least by text and the other columns stays, whatever the order of the rows
    kept = docs.join(first, "doc_id").groupBy("doc_id").agg(F.min(F.struct(*COLUMNS[1:])).alias("row")).select("doc_id", "row.*")
    return kept.unionByName(docs.where("doc_id is null").select(*COLUMNS))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents in which a benchmark item occurs."""
    return decontaminate.contamination(docs, table(spark, sf_dir, "benchmark"), COLUMNS).where("not contaminated").select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents of the mix, with the words taken of each (``taken`` above ``size``: repeated)."""
    weights = mixing.quality_weights(table(spark, sf_dir, "labels"))
    mixed = mixing.mix(docs, weights, ("text", "lang", "n_chars"))
    return mixed.where("taken > 0").select(*COLUMNS, "size", "source_size", "target", "taken")


STAGES = [
    ("toxicity", drop_toxic),
    ("quality classifier", drop_poor),
    ("n-gram Jaccard join", drop_near_duplicates),
    ("benchmark decontamination", drop_contaminated),
    ("mixing sources to target weights", mix_sources),
]
#: SQL can't express the classifiers and the SimHash search; the pipeline is tested against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(*COLUMNS)
    for _, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), "stage")
    return docs
