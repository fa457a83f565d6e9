"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from llm import sql
from llm.common import table


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from llm.quality import score, train

    docs = table(spark, sf_dir, "documents")
    model = train(docs, table(spark, sf_dir, "labels"))
    return score(docs, model).withColumn("keep", F.col("score") >= 0.5)


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from llm.language_id import identify, train

    fold = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 3
    docs = table(spark, sf_dir, "documents").withColumn("held_out", fold == 1)
    return identify(docs, train(docs.where("not held_out")))


def op3_warc_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    from llm.warc import round_trip

    found = round_trip(spark, table(spark, sf_dir, "pages"))
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from llm.toxicity import fold, score, train

    docs = table(spark, sf_dir, "documents")
    model = train(docs.where(~fold()), table(spark, sf_dir, "labels").where(~fold()))
    return score(docs, model).select("doc_id", fold().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op5_merkle_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from llm.merkle import fingerprints

    return fingerprints(table(spark, sf_dir, "documents"))


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from llm.decontaminate import contamination

    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from llm.jaccard_join import jaccard_components

    return jaccard_components(table(spark, sf_dir, "documents"))


def op8_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    from llm.mixing import mix, quality_weights

    return mix(table(spark, sf_dir, "documents"), quality_weights(table(spark, sf_dir, "labels")))


def op9_gru_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    from llm.lm_score import scores

    return scores(table(spark, sf_dir, "documents"))


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from llm.url_filter import judge

    return judge(table(spark, sf_dir, "pages"))


def op11_interleaved_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    from llm.sharding import interleaved

    placed = interleaved(table(spark, sf_dir, "documents"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    from llm.filter_audit import audit, failures

    return audit(failures(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from llm.periodic_runs import edited, periodic_runs, strongest

    found = periodic_runs(table(spark, sf_dir, "documents"), ("doc_id",), edited).withColumn("best", strongest(F.col("runs")))
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    told = F.when(F.size("runs") > 0, F.concat(lines, F.lit("\n"))).otherwise("")
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        "best.start",
        "best.length",
        "best.period",
        F.expr("best.length * 1000 div best.period").alias("exponent_milli"),
        F.sha2(told.cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality_classifier": op1_quality_classifier,
    "op2_language_id": op2_language_id,
    "op3_warc_index": op3_warc_index,
    "op4_toxicity": op4_toxicity,
    "op5_merkle_fingerprints": op5_merkle_fingerprints,
    "op6_decontaminate": op6_decontaminate,
    "op7_ngram_jaccard_join": op7_ngram_jaccard_join,
    "op8_mix_sources": op8_mix_sources,
    "op9_gru_scores": op9_gru_scores,
    "op10_url_filter": op10_url_filter,
    "op11_interleaved_shards": op11_interleaved_shards,
    "op12_filter_audit": op12_filter_audit,
    "op13_periodic_runs": op13_periodic_runs,
    "pipeline": pipeline,
}
SQL: dict[str, str] = {
    "op3_warc_index": sql.OP3,
    "op5_merkle_fingerprints": sql.OP5,
    "op7_ngram_jaccard_join": sql.OP7,
    "op8_mix_sources": sql.OP8,
    "op11_interleaved_shards": sql.OP11,
    "op12_filter_audit": sql.OP12,
}
