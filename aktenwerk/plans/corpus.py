"""Letters and statutes rendered from the example tables, so that jobs on text can be compared with the keys behind it.

Every order is a letter of its customer, every line item an argument with a citation; parts are the statutes. The lines
of an order are numbered by (l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from aktenwerk.functions.fixed import LAWS


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _law(key: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, LAWS)), (key % 9 + 1).cast("int"))


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(document_id, ord, law, sec, nr, sec2, cite, sentence, ...)``, one row for each line item."""
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    # texts cost more time than their bytes say: a fixed number of partitions, made before texts are, which jobs on documents share
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    d = table(spark, sf_dir, "lineitem").repartition(n, "l_orderkey").withColumn("ord", F.row_number().over(w))
    sec = F.floor(F.col("l_partkey") / 9) + 1 + F.when(F.col("l_suppkey") % 7 == 0, 100_000).otherwise(0)
    d = d.select(
        F.col("l_orderkey").alias("document_id"), "ord", _law(F.col("l_partkey")).alias("law"), sec.alias("sec"), F.when(F.col("ord") % 2 == 0, F.col("ord")).alias("nr"),
        F.when(F.col("l_suppkey") % 5 == 0, F.col("l_suppkey") % 50 + 1).alias("sec2"), (F.col("l_returnflag") != "R").alias("quoted"), (F.col("l_linestatus") == "O").alias("matched"),
        F.when(F.col("l_quantity") > 25, "TYP_2").otherwise("TYP_1").alias("typ"), F.col("l_partkey").alias("part"),
    )
    front = F.concat(F.lit("§ "), F.col("sec"), F.lit(" Abs. "), F.col("ord"), F.coalesce(F.concat(F.lit(" Nr. "), F.col("nr")), F.lit("")))
    cite = F.concat(front, F.coalesce(F.concat(F.lit(" i.V.m. § "), F.col("sec2")), F.lit("")), F.lit(" "), F.col("law"))
    d = d.withColumn("primary", F.concat(front, F.lit(" "), F.col("law"))).withColumn("cite", cite)
    return d.withColumn("sentence", F.concat(F.lit("Punkt "), F.col("ord"), F.lit(": Das Vorhaben verstößt gegen "), F.col("cite"), F.lit(", siehe Teil "), F.col("part"), F.lit(".")))


def letters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(document_id, text)``, one letter for each order."""
    body = lines(spark, sf_dir).groupBy("document_id").agg(F.array_join(F.sort_array(F.collect_list(F.struct("ord", "sentence")))["sentence"], "\n").alias("body"))
    c = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "n_name")
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("document_id"), "o_custkey").join(c, F.col("o_custkey") == F.col("c_custkey"))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))  # as in lines, also where the bodies are broadcast
    o = o.repartition(n, "document_id").join(body, "document_id", "left")
    name = F.concat(F.lit("Erika Muster"), F.col("c_custkey"))
    head = F.concat(F.lit("Einreicher: Dr. "), name, F.lit(", "), F.col("n_name"), F.lit("\nTelefon: 0171 "), F.col("c_custkey") + 1_000_000, F.lit("\nE-Mail: k"), F.col("c_custkey"), F.lit("@example.org\n\n"))
    return o.select("document_id", F.concat(head, F.coalesce("body", F.lit("")), F.lit("\n\nMit freundlichen Grüßen\n"), name).alias("text"))


def arguments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(document_id, pos, argument_text, original_zitat, catalog_id, einwendungs_typ)`` as a model would return them."""
    d = lines(spark, sf_dir)
    quote = F.when(F.col("quoted"), F.col("sentence")).otherwise(F.concat(F.lit("Erfundenes Zitat "), F.col("ord")))
    return d.select("document_id", F.col("ord").alias("pos"), F.concat(F.lit("Argument "), F.col("ord")).alias("argument_text"), quote.alias("original_zitat"), F.when(F.col("matched"), F.lower("law")).alias("catalog_id"), F.col("typ").alias("einwendungs_typ"))


def statutes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(gesetz, paragraph, canonical_key, title, text)``, one row for each part."""
    p = table(spark, sf_dir, "part").select(_law(F.col("p_partkey")).alias("gesetz"), (F.floor(F.col("p_partkey") / 9) + 1).cast("string").alias("paragraph"), F.col("p_name").alias("text"), "p_partkey")
    title = F.when(F.col("p_partkey") % 3 != 0, F.concat(F.lit("Titel "), F.col("p_partkey")))
    return p.select("gesetz", "paragraph", F.concat(F.lit("§ "), F.col("paragraph"), F.lit(" "), F.col("gesetz")).alias("canonical_key"), title.alias("title"), "text")


def custody(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Custody events ``(event_id, event_type, document_id, chain_id, ts, payload, serialization_version)`` from ``events``."""
    e = table(spark, sf_dir, "events")
    return e.select(
        F.col("event_id").cast("string").alias("event_id"), "event_type", F.col("user_id").cast("string").alias("document_id"), F.col("user_id").cast("string").alias("chain_id"), F.col("ts").cast("timestamp").alias("ts"),
        F.col("props").alias("payload"), F.lit(1).alias("serialization_version"),
    )


#: The same in SQL: lines, letters and statutes by key.
SQL_LINES = """
laws AS (SELECT ['BauGB', 'BauNVO', 'BImSchG', 'BNatSchG', 'EnWG', 'VwGO', 'WaStrG', 'WHG', 'WPG'] AS laws),
raw_lines AS (
  SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice)::INT AS ord FROM lineitem
), keyed AS (
  SELECT l_orderkey AS document_id, ord, laws[(l_partkey % 9 + 1)::INT] AS law, l_partkey // 9 + 1 + CASE WHEN l_suppkey % 7 = 0 THEN 100000 ELSE 0 END AS sec,
    CASE WHEN ord % 2 = 0 THEN ord END AS nr, CASE WHEN l_suppkey % 5 = 0 THEN l_suppkey % 50 + 1 END AS sec2, l_returnflag <> 'R' AS quoted, l_linestatus = 'O' AS matched,
    CASE WHEN l_quantity > 25 THEN 'TYP_2' ELSE 'TYP_1' END AS typ, l_partkey AS part FROM raw_lines, laws
), fronted AS (SELECT *, '§ ' || sec || ' Abs. ' || ord || coalesce(' Nr. ' || nr, '') AS front FROM keyed
), lines AS (
  SELECT *, front || ' ' || law AS prim, '§ ' || sec2 || ' ' || law AS linked, front || coalesce(' i.V.m. § ' || sec2, '') || ' ' || law AS cite,
    'Punkt ' || ord || ': Das Vorhaben verstößt gegen ' || front || coalesce(' i.V.m. § ' || sec2, '') || ' ' || law || ', siehe Teil ' || part || '.' AS sentence FROM fronted
)"""
SQL_LETTERS = (
    SQL_LINES
    + """, bodies AS (SELECT document_id, string_agg(sentence, chr(10) ORDER BY ord) AS body FROM lines GROUP BY document_id
), senders AS (
  SELECT o_orderkey AS document_id, 'Erika Muster' || c_custkey AS name, n_name, c_custkey FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
), heads AS (
  SELECT document_id, name, n_name, c_custkey, 'Einreicher: Dr. ' || name || ', ' || n_name || chr(10) || 'Telefon: 0171 ' || (c_custkey + 1000000) || chr(10) || 'E-Mail: k' || c_custkey || '@example.org' || chr(10) || chr(10) AS head FROM senders
), letters AS (
  SELECT document_id, name, n_name, c_custkey, head, coalesce(body, '') AS body, head || coalesce(body, '') || chr(10) || chr(10) || 'Mit freundlichen Grüßen' || chr(10) || name AS text FROM heads LEFT JOIN bodies USING (document_id)
)"""
)
SQL_STATUTES = """statutes AS (
  SELECT ['BauGB', 'BauNVO', 'BImSchG', 'BNatSchG', 'EnWG', 'VwGO', 'WaStrG', 'WHG', 'WPG'][(p_partkey % 9 + 1)::INT] AS gesetz, (p_partkey // 9 + 1)::VARCHAR AS paragraph, p_name AS text,
    '§ ' || (p_partkey // 9 + 1) || ' ' || ['BauGB', 'BauNVO', 'BImSchG', 'BNatSchG', 'EnWG', 'VwGO', 'WaStrG', 'WHG', 'WPG'][(p_partkey % 9 + 1)::INT] AS canonical_key,
    CASE WHEN p_partkey % 3 <> 0 THEN 'Titel ' || p_partkey END AS title FROM part
)"""
#: Citations with their order in the document.
SQL_CITATIONS = """cites AS (
  SELECT document_id, ord AS pos, 0 AS k, prim AS canonical, law FROM lines UNION ALL SELECT document_id, ord, 1, linked, law FROM lines WHERE sec2 IS NOT NULL
), citations AS (SELECT *, (row_number() OVER (PARTITION BY document_id ORDER BY pos, k) - 1)::INT AS ord FROM cites)"""
