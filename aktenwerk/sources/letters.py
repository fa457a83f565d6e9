"""Letters: scans with a size guard, the raw store, reads with an access trail, briefings out."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from aktenwerk.functions.fixed import MAX_CHARS
from aktenwerk.sources import custody_store

UUID = r"^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$"


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """SRC-3: ``(document_id, doc_type, text)``: one row a text file below ``path``, the folder's name as type.

    Files are read as bytes: the reader of whole texts copies the job's settings for each file, one task at a time.
    """
    f = F.col("_metadata.file_path")
    d = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.txt").load(path)
    return d.select(F.regexp_extract(f, r"([^/]+)\.txt$", 1).alias("document_id"), F.regexp_extract(f, r"([^/]+)/[^/]+$", 1).alias("doc_type"), F.col("content").cast("string").alias("text"))


def _local(spark: SparkSession, path: str) -> str | None:
    """``path`` as the operating system names it, where it is in a file system that this machine has mounted."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    whole = p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).makeQualified(p).toUri()
    return whole.getPath() if whole.getScheme() == "file" else None


#: Folders above those of the documents, so that a listing is dealt to tasks.
FOLDERS = 256


def write_documents(docs: DataFrame, path: str, key: str = "document_id") -> None:
    """Texts of ``docs(key long, text)`` as files in the new folder ``path``: a row a file, with a line end, in
    ``bucket=../<key>=../``.

    Where ``path`` is a mounted folder, tasks write the files themselves: Hadoop's local file system starts several ``chmod``
    processes for each file. A file gets its name once it is whole, and a repeated task writes the same names.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    d = docs.select(F.pmod(F.xxhash64(key), F.lit(FOLDERS)).cast("int").alias("bucket"), F.col(key).cast("long").alias(key), text.alias("text"))
    root = _local(docs.sparkSession, path)
    if root is None:
        d.repartition(key).write.option("maxRecordsPerFile", 1).option("mapreduce.fileoutputcommitter.algorithm.version", "2").partitionBy("bucket", key).text(path)
        return

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before, n = None, 0
        for b in batches:
            for bucket, i, text in zip(*(b.column(c).to_pylist() for c in ("bucket", key, "text")), strict=True):
                where = f"{root}/bucket={bucket}/{key}={'__HIVE_DEFAULT_PARTITION__' if i is None else i}"
                if where != before:
                    os.makedirs(where, exist_ok=True)
                    before, n = where, 0
                part = f"{where}/.part-{n}-{uuid.uuid4().hex}"
                with open(part, "wb") as f:
                    f.write(text + b"\n")
                os.replace(part, f"{where}/part-{n}.txt")
                n += 1
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows])], ["n"])

    os.makedirs(root, exist_ok=True)  # also where there are no documents
    dealt = d.withColumn("text", F.col("text").cast("binary")).repartition(key).sortWithinPartitions(key)
    dealt.mapInArrow(write, "n long").agg(F.sum("n")).collect()  # one row


def size_guard(spark: SparkSession, path: str, most: int = MAX_CHARS) -> tuple[DataFrame, DataFrame]:
    """SRC-4: files of at most ``most`` bytes and the others, decided from the listing (contents aren't read)."""
    d = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return d.where(F.col("length") <= most).select("path", "length"), d.where(F.col("length") > most).select("path", "length")


def write_raw(docs: DataFrame, path: str, buckets: int = 64) -> None:
    """SRC-5: appends raw documents, partitioned by a hash of their id."""
    docs.withColumn("bucket", F.pmod(F.xxhash64("document_id"), F.lit(buckets)).cast("int")).write.mode("append").partitionBy("bucket").parquet(path)


ACCESS = "rohdokument_zugriff"


def read_raw(spark: SparkSession, ids: DataFrame, store: str, log: str, at: Column, buckets: int = 64, request: str | None = None) -> tuple[DataFrame, DataFrame]:
    """SRC-6: stored documents of ``ids(document_id)`` and the rejected ids; every access is in the log before content is returned.

    Each access is an event of its own: ``request`` names it (a new name for each call by default), so two reads at
    one time give two events, and a retry under the same name gives one. A log whose tails don't verify is refused before
    anything is added or read."""
    asked = ids.select("document_id").distinct().withColumn("bucket", F.pmod(F.xxhash64("document_id"), F.lit(buckets)).cast("int"))
    stored = spark.read.parquet(store)
    known = asked.where(F.col("document_id").rlike(UUID)).join(stored.select("bucket", "document_id"), ["bucket", "document_id"], "left_semi")
    reason = F.when(~F.coalesce(F.col("document_id").rlike(UUID), F.lit(False)), "not_a_uuid").otherwise("unknown")
    rejected = asked.join(known.select("document_id"), "document_id", "left_anti").select("document_id", reason.alias("reason"))
    name = F.lit(request or uuid.uuid4().hex)
    events = known.select(
        F.sha2(F.concat_ws("|", "document_id", F.lit(ACCESS), at.cast("string"), name), 256).alias("event_id"), F.lit(ACCESS).alias("event_type"), "document_id", at.alias("ts"),
        F.to_json(F.struct("document_id")).alias("payload"), F.lit(1).alias("serialization_version"), F.col("document_id").alias("chain_id"),
    )
    trail = custody_store.append(events, log)
    if trail is None:  # no id is known
        return stored.limit(0).drop("bucket"), rejected
    told = trail.join(events.select("event_id"), "event_id", "left_semi").select("document_id").distinct()
    return stored.join(known.select("document_id"), "document_id", "left_semi").join(told, "document_id", "left_semi").drop("bucket"), rejected


AUDIT = "event_id string, event_type string, document_id string, ts timestamp, payload string, serialization_version int, sequence_number long, event_hash string, chain_id string, idx long"


def read_audit(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """SRC-7: events of an audit log of JSON lines, and the lines that don't parse."""
    lines = spark.read.text(path).select("value", F.from_json("value", f"{AUDIT}, _corrupt_record string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}).alias("r"))
    bad = F.col("r._corrupt_record").isNotNull() | F.col("r.event_id").isNull()
    return lines.where(~bad).select("r.*").drop("_corrupt_record"), lines.where(bad).select(F.col("value").alias("line"))


def write_briefings(briefings: DataFrame, path: str, compression: str = "gzip") -> None:
    """SRC-8: nested JSON lines, nulls kept; compressed, as names and quoted statutes repeat in every row."""
    briefings.write.mode("overwrite").json(path, compression=compression, ignoreNullFields=False)


def write_results(results: DataFrame, head: DataFrame, path: str) -> None:
    """SRC-10: evaluation results with the head of the custody chain in every row."""
    h = head.agg(F.max_by("event_hash", "sequence_number").alias("chain_head_hash"), F.max("sequence_number").alias("chain_head_sequence"))
    results.crossJoin(F.broadcast(h)).write.mode("overwrite").json(path, ignoreNullFields=False)  # one row


def read_gt_citations(spark: SparkSession, path: str) -> DataFrame:
    """SRC-9: ``(document_id, norm, kind)`` from explicit-citation ground truth."""
    d = spark.read.json(path, multiLine=True, schema="dokument string, explizit_zitierte_normen array<struct<norm string, type string>>")
    return d.select(F.col("dokument").alias("document_id"), F.inline_outer("explizit_zitierte_normen").alias("norm", "kind"))


def read_gt_retrieval(spark: SparkSession, path: str) -> DataFrame:
    """SRC-9: ``(doc_id, argument_id, need, paragraph_id, citation, rank_target)`` from retrieval ground truth."""
    e = "array<struct<paragraph_id string, citation string, rank_target string>>"
    schema = f"doc_id string, expected_arguments array<struct<argument_id string, expected_norms struct<must_retrieve {e}, should_retrieve {e}, not_retrievable_via_xml array<struct<citation string>>>>>"
    a = spark.read.json(path, multiLine=True, schema=schema).select("doc_id", F.explode("expected_arguments").alias("a"))
    need = lambda n: F.transform(f"a.expected_norms.{n}", lambda x: F.struct(F.lit(n).alias("need"), x["paragraph_id"].alias("paragraph_id"), x["citation"].alias("citation"), x["rank_target"].alias("rank_target")))
    none = F.transform("a.expected_norms.not_retrievable_via_xml", lambda x: F.struct(F.lit("not_retrievable").alias("need"), F.lit(None).cast("string").alias("paragraph_id"), x["citation"].alias("citation"), F.lit(None).cast("string").alias("rank_target")))
    empty = F.array().cast("array<struct<need:string,paragraph_id:string,citation:string,rank_target:string>>")
    rows = F.concat(*(F.coalesce(x, empty) for x in (need("must_retrieve"), need("should_retrieve"), none)))
    return a.select("doc_id", F.col("a.argument_id").alias("argument_id"), F.inline(rows))


def read_gt_catalog(spark: SparkSession, path: str) -> DataFrame:
    """SRC-9: expected catalogs: ``(document_id, doc_type, expected_typ, expected_catalog_ids, low, high)``."""
    schema = "expected_catalog_assignment array<struct<dokument string, doc_type string, expected_einwendungs_typ string, expected_catalog_ids array<string>, expected_argument_count_range array<int>>>"
    d = spark.read.json(path, multiLine=True, schema=schema).select(F.inline("expected_catalog_assignment"))
    return d.select(F.col("dokument").alias("document_id"), "doc_type", F.col("expected_einwendungs_typ").alias("expected_typ"), "expected_catalog_ids", F.get("expected_argument_count_range", F.lit(0)).alias("low"), F.get("expected_argument_count_range", F.lit(1)).alias("high"))


def read_gt_pii(spark: SparkSession, path: str) -> DataFrame:
    """SRC-9: ``(file, names_must_mask, must_survive)``."""
    d = spark.read.json(path, multiLine=True, schema="documents array<struct<file string, names_must_mask array<string>, must_survive array<string>>>")
    return d.select(F.inline("documents"))
