"""Triage flags, statuses, prompts and nested briefings."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from aktenwerk.functions.fixed import FENCE, SUBSTANCE_CHARS
from aktenwerk.functions.text import let
from aktenwerk.operators import citations


def triage_flags(docs: DataFrame, cited: DataFrame, arguments: DataFrame) -> DataFrame:
    """FLT-10: ``contradiction_detected`` (citations, no arguments) and ``substance_threshold_exceeded`` (a long text, none)."""
    c = cited.groupBy("document_id").agg(F.count(F.lit(1)).alias("_c"))
    a = arguments.groupBy("document_id").agg(F.count(F.lit(1)).alias("_a"))
    d = docs.select("document_id", F.length("text").alias("_n")).join(c, "document_id", "left").join(a, "document_id", "left")
    none = F.coalesce("_a", F.lit(0)) == 0
    return d.select("document_id", ((F.coalesce("_c", F.lit(0)) > 0) & none).alias("contradiction_detected"), (none & (F.coalesce("_n", F.lit(0)) >= SUBSTANCE_CHARS)).alias("substance_threshold_exceeded"))


def document_type(docs: DataFrame, arguments: DataFrame) -> DataFrame:
    """AGG-3: TYP_2 if any argument is, else TYP_1."""
    t = arguments.groupBy("document_id").agg(F.bool_or(F.col("einwendungs_typ") == "TYP_2").alias("_t"))
    return docs.select("document_id").join(t, "document_id", "left").select("document_id", F.when(F.col("_t"), "TYP_2").otherwise("TYP_1").alias("typ"))


def argument_norms(arguments: DataFrame, resolutions: DataFrame) -> DataFrame:
    """Adds ``norms`` (array of resolutions in order) to arguments; ``resolutions`` has ``document_id, pos, ord``."""
    entry = F.struct("ord", F.col("canonical").alias("citation"), "paragraph_key", "source_text", "resolved")
    lists = resolutions.groupBy("document_id", "pos").agg(F.sort_array(F.collect_list(entry)).alias("_n"))
    none = F.array().cast("array<struct<citation:string,paragraph_key:string,source_text:string,resolved:boolean>>")
    drop = F.transform("_n", lambda x: F.struct(x["citation"], x["paragraph_key"], x["source_text"], x["resolved"]))
    return arguments.join(lists, ["document_id", "pos"], "left").withColumn("norms", F.coalesce(drop, none)).drop("_n")


def status(verified: Column, catalog_id: Column, norms: Column) -> Column:
    """Unverified before no catalog before an unresolved norm before ready; no norms at all is ready."""
    return (
        F.when(~verified, "ARGUMENT_UNVERIFIED")
        .when(catalog_id.isNull(), "NO_CATALOG_MATCH")
        .when(F.exists(norms, lambda n: ~n["resolved"]), "NORM_UNRESOLVED")
        .otherwise("BRIEFING_READY")
    )


def statuses(arguments: DataFrame, resolutions: DataFrame) -> DataFrame:
    """AGG-4: arguments with their norms and status."""
    return argument_norms(arguments, resolutions).withColumn("status", status(F.col("argument_verified"), F.col("catalog_id"), F.col("norms")))


def terminal_status(docs: DataFrame, arguments: DataFrame, failed: DataFrame | None = None) -> DataFrame:
    """AGG-4: how a document ends: without arguments, with a briefing, or failed (``failed(document_id)``)."""
    a = arguments.groupBy("document_id").agg(F.count(F.lit(1)).alias("_a"))
    d = docs.select("document_id").join(a, "document_id", "left")
    lost = (failed.select("document_id").distinct() if failed is not None else docs.select("document_id").limit(0)).withColumn("_f", F.lit(True))
    end = F.when(F.col("_f"), "pipeline_fehler").when(F.col("_a") > 0, "briefing_erstellt").otherwise("kein_treffer")
    return d.join(lost, "document_id", "left").select("document_id", end.alias("terminal_status"))


def with_catalog(arguments: DataFrame, catalog: DataFrame) -> DataFrame:
    """JON-5: arguments with their catalog's description; all stay."""
    return arguments.join(catalog, "catalog_id", "left")


def assemble(docs: DataFrame, arguments: DataFrame, resolutions: DataFrame, corpus: DataFrame) -> DataFrame:
    """JON-11: one nested briefing a document; entries in argument order, norms in citation order."""
    s = statuses(arguments, resolutions)
    entry = F.struct("pos", "argument_text", "original_zitat", "catalog_id", "einwendungs_typ", "argument_verified", "status", "norms")
    lists = s.groupBy("document_id").agg(F.array_sort(F.collect_list(entry)).alias("entries"), F.bool_or(F.col("einwendungs_typ") == "TYP_2").alias("_t"))
    d = docs.select("document_id").join(lists, "document_id", "left")
    none = F.array().cast(lists.schema["entries"].dataType)
    return d.select("document_id", F.when(F.col("_t"), "TYP_2").otherwise("TYP_1").alias("typ"), F.coalesce("entries", none).alias("entries")).crossJoin(F.broadcast(corpus.select("corpus_id")))  # one row


def assemble_dossiers(dossier: DataFrame, statutes: DataFrame, corpus: DataFrame) -> DataFrame:
    """JON-11 from dossiers (``citations.dossiers``): the same briefings as ``assemble`` gives.

    Only the documents' distinct norms are resolved and come back, in one row for each document; arguments, their norms and
    status are put together in the row and are neither taken apart nor grouped again.
    """
    norms = F.array_distinct(F.flatten(F.transform("arguments", lambda a: a["norms"])))
    # an outer explode, as in citations.argued_in
    cited = dossier.select("document_id", F.explode_outer(norms).alias("canonical")).where("canonical is not null")
    entry = F.struct(F.col("canonical").alias("citation"), "paragraph_key", "source_text", "resolved")
    lists = citations.resolve(cited, statutes).groupBy("document_id").agg(F.collect_list(entry).alias("_r"))

    def with_status(a: Column) -> Callable[[Column], Column]:
        own = ("pos", "argument_text", "original_zitat", "catalog_id", "einwendungs_typ", "argument_verified")
        return lambda n: F.struct(*(a[c].alias(c) for c in own), status(a["argument_verified"], a["catalog_id"], n).alias("status"), n.alias("norms"))

    def entered(a: Column) -> Column:
        return let(F.flatten(F.transform(a["norms"], lambda c: F.filter("_r", lambda r: r["citation"] == c))), with_status(a))

    d = dossier.select("document_id", F.when(F.col("document_id").isNotNull(), F.col("arguments")).alias("_a")).join(lists, "document_id", "left")
    d = d.select("document_id", F.coalesce("_a", F.array().cast(dossier.schema["arguments"].dataType)).alias("_a"), F.coalesce("_r", F.array().cast(lists.schema["_r"].dataType)).alias("_r"))
    typ = F.when(F.exists("_a", lambda a: a["einwendungs_typ"] == "TYP_2"), "TYP_2").otherwise("TYP_1")
    return d.select("document_id", typ.alias("typ"), F.transform("_a", entered).alias("entries")).crossJoin(F.broadcast(corpus.select("corpus_id")))  # one row


def neutral(text: Column) -> Column:
    for mark, plain in FENCE.items():
        text = F.replace(text, F.lit(mark), F.lit(plain))
    return text


def build_prompts(docs: DataFrame, catalog: DataFrame, instruction: str = "") -> DataFrame:
    """TXT-8: ``prompt``: instruction, the catalog as a list, and the fenced text with its own fence marks defused."""
    start, end = FENCE
    line = F.concat(F.lit("- "), F.col("catalog_id"), F.lit(": "), F.col("beschreibung"))
    listed = catalog.agg(F.array_join(F.array_sort(F.collect_list(line)), "\n").alias("_catalog"))
    prompt = F.concat(F.lit(instruction), F.col("_catalog"), F.lit(f"\n{start}\n"), neutral(F.col("text")), F.lit(f"\n{end}"))
    return docs.crossJoin(F.broadcast(listed)).select("document_id", prompt.alias("prompt"))  # one row
