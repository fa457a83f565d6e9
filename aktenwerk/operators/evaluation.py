"""Evaluation tables: set comparisons, precision and recall, losses, confusion, inventories.

Undefined figures are null unless ``vacuous`` gives another value.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def compare_sets(expected: DataFrame, extracted: DataFrame) -> DataFrame:
    """JON-7: ``(document_id, item, outcome)`` with TP, FP, FN from two tables of distinct (document_id, item)."""
    e = expected.select("document_id", "item").distinct().withColumn("_e", F.lit(True))
    x = extracted.select("document_id", "item").distinct().withColumn("_x", F.lit(True))
    j = e.join(x, ["document_id", "item"], "full_outer")
    return j.select("document_id", "item", F.when(F.col("_e") & F.col("_x"), "TP").when(F.col("_x"), "FP").otherwise("FN").alias("outcome"))


def counted(outcomes: DataFrame, *by: str) -> DataFrame:
    return outcomes.groupBy(*by).agg(*(F.count_if(F.col("outcome") == k).alias(k.lower()) for k in ("TP", "FP", "FN")))


def scored(counts: DataFrame, vacuous: float | None = None) -> DataFrame:
    """Adds precision (null with nothing extracted), recall (null with nothing expected) and F1 (0 when recall is defined
    and precision isn't). ``vacuous`` replaces undefined precision and recall."""
    tp, fp, fn = (F.col(c).cast("double") for c in ("tp", "fp", "fn"))
    d = counts.withColumn("precision", F.try_divide(tp, tp + fp)).withColumn("recall", F.try_divide(tp, tp + fn))
    if vacuous is not None:
        d = d.fillna(vacuous, ["precision", "recall"])
    p, r = F.col("precision"), F.col("recall")
    f1 = F.when(r.isNull(), None).when(p.isNull() | (p + r == 0), 0.0).otherwise(2 * p * r / (p + r))
    return d.withColumn("f1", f1)


def _met(**tables: DataFrame) -> DataFrame:
    """``(document_id, item, ...)``: each pair once, with a flag for each of the tables that has it.

    The tables meet in one shuffle by document. As in a join, a null equals nothing: pairs with one stay apart by table.
    """
    out = None
    for name, d in tables.items():
        one = d.select("document_id", "item", *(F.lit(k == name).alias(k) for k in tables))
        one = one.withColumn("_apart", F.when(F.col("document_id").isNull() | F.col("item").isNull(), F.lit(name)))
        out = one if out is None else out.unionByName(one)
    out = out.repartition("document_id")  # shuffled here, so that the parts of the union needn't be laid out alike
    return out.groupBy("document_id", "item", "_apart").agg(*(F.bool_or(k).alias(k) for k in tables)).drop("_apart")


def loss_breakdown(expected: DataFrame, assigned: DataFrame, found: DataFrame) -> DataFrame:
    """JON-8: ``(document_id, item, loss)``: lost_by_assignment (found in the document, not assigned), truly_missing
    (expected, not found), spurious (assigned, not expected)."""
    e, a, f = map(F.col, ("_e", "_a", "_f"))
    # what is expected and not found is missing, assigned or not, so a pair has one loss at most
    loss = F.when(e & ~f, "truly_missing").when(e & ~a, "lost_by_assignment").when(a & ~e, "spurious")
    return _met(_e=expected, _a=assigned, _f=found).select("document_id", "item", loss.alias("loss")).where("loss is not null")


def orphan_refs(truth: DataFrame, statutes: DataFrame) -> DataFrame:
    """JON-9: rows of ``truth(paragraph_id, ...)`` that no statute has."""
    return truth.join(statutes.select(F.col("canonical_key").alias("paragraph_id")).distinct(), "paragraph_id", "left_anti")


def vocabulary_drift(laws: DataFrame, statutes: DataFrame) -> DataFrame:
    """JON-10: ``(gesetz, drift)``: laws without paragraphs and paragraphs of unlisted laws."""
    a, b = laws.select("gesetz").distinct(), statutes.select("gesetz").distinct()
    return a.join(b, "gesetz", "left_anti").withColumn("drift", F.lit("no_paragraphs")).unionByName(b.join(a, "gesetz", "left_anti").withColumn("drift", F.lit("not_listed")))


def coverage_metrics(docs: DataFrame, expected: DataFrame, assigned: DataFrame, found: DataFrame) -> DataFrame:
    """AGG-12: per document P, R, F1 of assigned and of found citations, and the assignment gap (found minus assigned recall)."""
    e, a, f = map(F.col, ("_e", "_a", "_f"))
    counts = lambda x, p: (F.count_if(e & x).alias(f"{p}_tp"), F.count_if(~e & x).alias(f"{p}_fp"), F.count_if(e & ~x).alias(f"{p}_fn"))
    both = _met(_e=expected, _a=assigned, _f=found).groupBy("document_id").agg(*counts(a, "assigned"), *counts(f, "doc"))
    for p in ("assigned", "doc"):
        both = scored(both.withColumnsRenamed({f"{p}_{k}": k for k in ("tp", "fp", "fn")})).drop("tp", "fp", "fn")
        both = both.withColumnsRenamed({k: f"{p}_{k}" for k in ("precision", "recall", "f1")})
    j = docs.select("document_id").join(both, "document_id", "left")
    return j.withColumn("assignment_gap", F.col("doc_recall") - F.col("assigned_recall"))


def macro_average(metrics: DataFrame) -> DataFrame:
    """AGG-12: means over the documents where a figure is defined."""
    names = [c for c, kind in metrics.dtypes if kind == "double"]
    return metrics.agg(*(F.avg(c).alias(c) for c in names), F.count(F.lit(1)).alias("documents"))


def extraction_summary(docs: DataFrame, outcomes: DataFrame) -> DataFrame:
    """AGG-13: totals and means of TP, loss and overcount by document type."""
    c = counted(outcomes, "document_id")
    d = docs.select("document_id", "doc_type").join(c, "document_id", "left").fillna(0, ["tp", "fp", "fn"])
    return d.groupBy("doc_type").agg(
        F.count(F.lit(1)).alias("documents"), F.sum("tp").alias("tp"), F.sum("fn").alias("loss"), F.sum("fp").alias("overcount"),
        F.avg("tp").alias("mean_tp"), F.avg("fn").alias("mean_loss"), F.avg("fp").alias("mean_overcount"),
    )


def catalog_eval(truth: DataFrame, arguments: DataFrame) -> DataFrame:
    """AGG-14: per document of ``truth(document_id, doc_type, expected_typ, expected_catalog_ids, low, high)``: catalog
    recall (1 with nothing expected) and precision, type match, count in range, verified rate, missing, extra ids."""
    got = arguments.groupBy("document_id").agg(
        F.array_sort(F.collect_set("catalog_id")).alias("got"), F.count(F.lit(1)).alias("n"), F.bool_or(F.col("einwendungs_typ") == "TYP_2").alias("_t"), F.avg(F.col("argument_verified").cast("double")).alias("verified_rate")
    )
    j = truth.join(got, "document_id", "left")
    have = F.coalesce("got", F.array().cast("array<string>"))
    want = F.array_distinct("expected_catalog_ids")
    hit = F.size(F.array_intersect(want, have)).cast("double")
    typ = F.when(F.col("_t"), "TYP_2").otherwise("TYP_1")
    return j.select(
        "document_id", "doc_type",
        F.when(F.size(want) == 0, 1.0).otherwise(F.try_divide(hit, F.size(want))).alias("recall"),
        F.try_divide(hit, F.size(have)).alias("precision"),
        (typ == F.col("expected_typ")).alias("typ_match"),
        F.coalesce(F.col("n"), F.lit(0)).between(F.col("low"), F.col("high")).alias("count_in_range"),
        "verified_rate",
        F.array_sort(F.array_except(want, have)).alias("missing"),
        F.array_sort(F.array_except(have, want)).alias("extra"),
    )


def catalog_summary(evaluated: DataFrame) -> DataFrame:
    """AGG-15: means by document type with their denominators, and an overall row (null type)."""
    rate = lambda c: F.avg(F.col(c).cast("double"))
    return evaluated.rollup("doc_type").agg(
        F.count(F.lit(1)).alias("documents"), F.avg("recall").alias("recall"), F.count("recall").alias("recall_n"), F.avg("precision").alias("precision"),
        F.count("precision").alias("precision_n"), rate("typ_match").alias("typ_accuracy"), rate("count_in_range").alias("count_in_range"), F.avg("verified_rate").alias("verified_rate"),
    )


def catalog_confusion(truth: DataFrame, arguments: DataFrame) -> DataFrame:
    """AGG-16: TP, FP, FN, precision and recall per catalog id."""
    e = truth.select("document_id", F.explode("expected_catalog_ids").alias("item"))
    x = arguments.where("catalog_id is not null").select("document_id", F.col("catalog_id").alias("item"))
    return scored(counted(compare_sets(e, x), "item")).withColumnRenamed("item", "catalog_id")


def distractors(catalog: DataFrame, truth: DataFrame, arguments: DataFrame) -> DataFrame:
    """AGG-17: catalogs that no document expects, with the number of documents that hit them."""
    wanted = truth.select(F.explode("expected_catalog_ids").alias("catalog_id")).distinct()
    never = catalog.select("catalog_id").distinct().join(wanted, "catalog_id", "left_anti")
    hits = arguments.join(never, "catalog_id", "left_semi").groupBy("catalog_id").agg(F.count_distinct("document_id").alias("documents"))
    return never.join(hits, "catalog_id", "left").fillna(0, ["documents"])


def resolution_report(wanted: DataFrame, resolutions: DataFrame) -> DataFrame:
    """AGG-19: distinct citations of ``wanted(citation)`` by law and method, with recall; the null law is the total."""
    d = wanted.select(F.col("citation").alias("canonical")).distinct().join(resolutions.select("canonical", "method").distinct(), "canonical", "left").fillna("none", ["method"])
    d = d.withColumn("law", F.element_at(F.split("canonical", " "), -1))
    exact, none = F.count_if(F.col("method") == "exact"), F.count_if(F.col("method") == "none")
    return d.rollup("law").agg(exact.alias("exact"), none.alias("none"), F.try_divide(exact.cast("double"), F.count(F.lit(1))).alias("recall"))


def zero_extraction(docs: DataFrame, arguments: DataFrame, assigned: DataFrame) -> DataFrame:
    """AGG-20: why documents have no assigned citation: H1 no arguments, H2 no § in any quote, H3 other."""
    a = arguments.groupBy("document_id").agg(
        F.count(F.lit(1)).alias("arguments"), F.avg(F.length("original_zitat")).alias("mean_quote"), F.max(F.length("original_zitat")).alias("max_quote"), F.count_if(F.contains("original_zitat", F.lit("§"))).alias("with_sign")
    )
    d = docs.select("document_id").join(assigned.select("document_id").distinct(), "document_id", "left_anti").join(a, "document_id", "left")
    why = F.when(F.coalesce("arguments", F.lit(0)) == 0, "H1").when(F.col("with_sign") == 0, "H2").otherwise("H3")
    return d.select("document_id", why.alias("hypothesis"), F.coalesce("arguments", F.lit(0)).alias("arguments"), "mean_quote", "max_quote", F.coalesce("with_sign", F.lit(0)).alias("with_sign"))


def top_per(df: DataFrame, by: str, order: list[Column], k: int) -> DataFrame:
    """TOP-3: the first ``k`` rows of each group by a total order."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(*order))).where(F.col("rank") <= k)


def miss_frequency(losses: DataFrame, k: int = 15) -> DataFrame:
    """AGG-21: the ``k`` most frequent citations of each kind of loss."""
    c = losses.groupBy("loss", "item").agg(F.count(F.lit(1)).alias("n"))
    return top_per(c, "loss", [F.desc("n"), F.asc("item")], k)


#: Accuracy of the approximate ranks, and how far the bracket reaches from the middle.
_ACCURACY, _REACH = 10_000, 0.001


def upper_median(values: DataFrame, key: str, value: str) -> DataFrame:
    """``(key, median)``: element ``n div 2`` (from 0) of each key's sorted values, exactly; nulls count for nothing.

    Approximate percentiles, whose error in rank is below ``_REACH``, bracket the middle; what lies below the bracket is
    counted, and only distinct values inside it are sorted. No row or task holds a key's values.
    """
    v = values.where(F.col(value).isNotNull()).select(key, F.col(value).alias("_v"))
    ends = v.groupBy(key).agg(F.percentile_approx("_v", [0.5 - _REACH, 0.5 + _REACH], _ACCURACY).alias("_e"))
    ends = ends.select(key, F.get("_e", F.lit(0)).alias("_low"), F.get("_e", F.lit(1)).alias("_high"))
    j = v.join(ends, key)
    counts = j.groupBy(key).agg(F.count(F.lit(1)).alias("_n"), F.count_if(F.col("_v") < F.col("_low")).alias("_below"))
    inside = j.where("_v between _low and _high").groupBy(key, "_v").agg(F.count(F.lit(1)).alias("_c"))
    upto = F.sum("_c").over(Window.partitionBy(key).orderBy("_v").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    placed = inside.withColumn("_upto", upto).join(counts, key).where(F.col("_below") + F.col("_upto") > F.floor(F.col("_n") / 2))
    return placed.groupBy(key).agg(F.min("_v").alias("median"))


def extractor_benchmark(truth: DataFrame, outputs: DataFrame, laws: DataFrame) -> DataFrame:
    """AGG-22: per extractor, macro P, R, F1 raw and whitelisted, mean and upper median of the time.

    ``truth(document_id, item)``; ``outputs(extractor, document_id, citations, elapsed_ms)``, which is read several times (a
    stored table is best). Sets meet in one join by document and are compared in the row.
    """
    none = F.array().cast("array<string>")
    want = truth.groupBy("document_id").agg(F.collect_set("item").alias("want"))
    got = outputs.groupBy("extractor", "document_id").agg(F.array_distinct(F.flatten(F.collect_list("citations"))).alias("raw"))
    known = laws.agg(F.collect_set("gesetz").alias("known"))  # one row
    cells = got.join(want, "document_id", "left").crossJoin(F.broadcast(known)).withColumn("want", F.coalesce("want", none))
    cells = cells.withColumn("listed", F.filter("raw", lambda x: F.array_contains("known", F.element_at(F.split(x, " "), -1))))
    cells = cells.where((F.size("raw") > 0) | (F.size("want") > 0))
    for name in ("raw", "listed"):
        tp = F.size(F.array_intersect(name, "want"))
        s = scored(cells.withColumn("tp", tp).withColumn("fp", F.size(name) - F.col("tp")).withColumn("fn", F.size("want") - F.col("tp")))
        cells = s.withColumnsRenamed({c: f"{name}_{c}" for c in ("precision", "recall", "f1")})
    macro = cells.groupBy("extractor").agg(*(F.avg(f"{name}_{c}").alias(f"{name}_{c}") for name in ("raw", "listed") for c in ("precision", "recall", "f1")))

    middle = upper_median(outputs, "extractor", "elapsed_ms").withColumnRenamed("median", "median_ms")
    times = outputs.groupBy("extractor").agg(F.avg("elapsed_ms").alias("mean_ms")).join(middle, "extractor", "left")
    return macro.join(times, "extractor")


def fp_resilience(truth: DataFrame, outputs: DataFrame) -> DataFrame:
    """AGG-23: citations found in documents that have none, per extractor and document."""
    clean = outputs.join(truth.select("document_id").distinct(), "document_id", "left_anti")
    return clean.groupBy("extractor", "document_id").agg(F.sum(F.size(F.array_distinct("citations"))).alias("false_positives"))


def extractor_only(truth: DataFrame, outputs: DataFrame) -> DataFrame:
    """SET-2: citations that one extractor alone found, labelled TP or FP."""
    pairs = outputs.select("extractor", "document_id", F.explode("citations").alias("item")).distinct()
    one = pairs.groupBy("document_id", "item").agg(F.count(F.lit(1)).alias("_n"), F.min("extractor").alias("extractor")).where("_n = 1")
    t = truth.select("document_id", "item").distinct().withColumn("_t", F.lit(True))
    return one.join(t, ["document_id", "item"], "left").select("extractor", "document_id", "item", F.when(F.col("_t"), "TP").otherwise("FP").alias("label"))


def gt_inventory(entries: DataFrame, kinds: list[str]) -> DataFrame:
    """AGG-24: entries per document and kind from ``entries(document_id, kind)``, one column a kind."""
    return entries.groupBy("document_id").pivot("kind", kinds).count().fillna(0)


def rank_eval(truth: DataFrame, ranking: DataFrame, k: int = 10) -> DataFrame:
    """AGG-25: hits within each target (``truth(query_id, item_id, target)``), recall at ``k`` and mean reciprocal rank."""
    j = truth.join(ranking.select("query_id", "item_id", "rank"), ["query_id", "item_id"], "left")
    hit = lambda limit: F.count_if(F.coalesce(F.col("rank") <= limit, F.lit(False)))
    return j.groupBy("target").agg(F.count(F.lit(1)).alias("wanted"), hit(F.col("target")).alias("hits"), F.try_divide(hit(F.lit(k)).cast("double"), F.count(F.lit(1))).alias("recall_at_k"), F.avg(F.coalesce(1 / F.col("rank"), F.lit(0.0))).alias("mrr"))


def register_extractor(find) -> object:
    """UDF-2: a citation extractor ``Series of texts -> Series of lists of canonical strings`` as an Arrow UDF."""
    @F.pandas_udf("array<string>")
    def extractor(texts: pd.Series) -> pd.Series:
        return find(texts)

    return extractor
