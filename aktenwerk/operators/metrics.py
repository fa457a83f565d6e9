"""Operational counters and histograms as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aktenwerk.functions.fixed import ARGUMENT_BOUNDS


def arguments_histogram(docs: DataFrame, arguments: DataFrame, bounds: tuple[int, ...] = ARGUMENT_BOUNDS) -> DataFrame:
    """AGG-6: cumulative histogram ``(le, n)`` of arguments per document, documents without any included."""
    a = arguments.groupBy("document_id").agg(F.count(F.lit(1)).alias("_a"))
    d = docs.select("document_id").join(a, "document_id", "left").select(F.coalesce("_a", F.lit(0)).alias("a"))
    # all bounds in one pass; then one row a bound
    one = d.agg(*(F.count_if(F.col("a") <= b).alias(f"b{b}") for b in bounds), F.count(F.lit(1)).alias("all"))
    rows = F.array(*(F.struct(F.lit(str(b)).alias("le"), F.col(f"b{b}").alias("n")) for b in bounds), F.struct(F.lit("+Inf").alias("le"), F.col("all").alias("n")))
    return one.select(F.inline(rows))


def verification_rate(arguments: DataFrame) -> DataFrame:
    """AGG-7: unverified arguments, all arguments and the failure rate (null without arguments)."""
    bad = F.count_if(~F.col("argument_verified"))
    return arguments.agg(bad.alias("failures"), F.count(F.lit(1)).alias("arguments"), F.try_divide(bad.cast("double"), F.count(F.lit(1))).alias("failure_rate"))


def outcome_counters(ends: DataFrame, flags: DataFrame, audit_writes: DataFrame) -> DataFrame:
    """AGG-8: ``(metric, label, n)``: documents by terminal status, contradictions, failed audit writes (``ok`` false)."""
    by = ends.groupBy(F.col("terminal_status").alias("label")).agg(F.count(F.lit(1)).alias("n")).select(F.lit("objections").alias("metric"), "label", "n")
    c = flags.agg(F.count_if("contradiction_detected").alias("n")).select(F.lit("contradictions").alias("metric"), F.lit("").alias("label"), "n")
    w = audit_writes.agg(F.count_if(~F.col("ok")).alias("n")).select(F.lit("failed_audit_writes").alias("metric"), F.lit("").alias("label"), "n")
    return by.unionByName(c).unionByName(w)


def stage_durations(timings: DataFrame, bounds: tuple[float, ...]) -> DataFrame:
    """AGG-9: per stage the numbers of ok and failed runs, mean and median duration, and a cumulative histogram."""
    counts = F.map_from_arrays(F.array(*map(F.lit, [str(b) for b in bounds] + ["+Inf"])), F.array(*(F.count_if(F.col("seconds") <= b) for b in bounds), F.count("seconds")))
    return timings.groupBy("stage").agg(
        F.count_if(F.col("status") == "ok").alias("ok"), F.count_if(F.col("status") == "error").alias("error"), F.avg("seconds").alias("mean_seconds"), F.percentile_approx("seconds", 0.5, 10_000).alias("median_seconds"), counts.alias("histogram")
    )
