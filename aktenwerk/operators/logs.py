"""Governed log records ``(run_id, origin, event, level, ts, attrs MAP, exc_text)``: default deny."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What replaces an unregistered event, and the cap of foreign event names.
UNREGISTERED, CAP, CUT = "unregistered_event", 200, "[truncated]"


def _listed(key: Column, values: tuple[str, ...]) -> Column:
    return key.isin(*values)


def log_allowlist(logs: DataFrame, keys: tuple[str, ...]) -> tuple[DataFrame, DataFrame]:
    """FLT-6: records with registered keys only, and the offending ``(run_id, event, key)``."""
    kept = logs.withColumn("attrs", F.map_filter("attrs", lambda k, v: _listed(k, keys)))
    offenders = logs.select("run_id", "event", F.explode(F.map_keys("attrs")).alias("key")).where(~_listed(F.col("key"), keys))
    return kept, offenders


def enforce_vocabulary(logs: DataFrame, events: DataFrame) -> DataFrame:
    """FLT-7: an own event that isn't in ``events(event)`` becomes a constant without attributes; foreign ones stay."""
    known = events.select("event").distinct().withColumn("_known", F.lit(True))
    bad = (F.col("origin") == "own") & F.col("_known").isNull()
    j = logs.join(known, "event", "left")
    bare = F.map_filter("attrs", lambda k, v: k == "correlation_id")
    return j.withColumn("event", F.when(bad, UNREGISTERED).otherwise(F.col("event"))).withColumn("attrs", F.when(bad, bare).otherwise(F.col("attrs"))).withColumn("exc_text", F.when(~bad, F.col("exc_text"))).select(*logs.columns)


def sanitize_logs(logs: DataFrame) -> DataFrame:
    """FLT-8: no C0 control characters in any string; foreign events of more than 200 characters are cut."""
    clean = lambda c: F.regexp_replace(c, r"[\x00-\x1f]", "")
    event = clean(F.col("event"))
    capped = F.when((F.col("origin") != "own") & (F.length(event) > CAP), F.concat(F.substring(event, 1, CAP), F.lit(CUT))).otherwise(event)
    return logs.withColumn("event", capped).withColumn("attrs", F.transform_values("attrs", lambda k, v: clean(v)))


def reduce_exceptions(logs: DataFrame) -> DataFrame:
    """FLT-9: of a traceback only ``exc_type`` and ``exc_location`` (file:line of the last frame) stay, never the message."""
    frames = F.regexp_extract_all("exc_text", F.lit(r'File "([^"]+)", line (\d+)'), F.lit(0))
    last = F.try_element_at(frames, F.lit(-1))
    place = F.when(last.isNotNull(), F.concat_ws(":", F.regexp_extract(F.regexp_extract(last, r'File "([^"]+)"', 1), r"([^/\\]+)$", 1), F.regexp_extract(last, r"line (\d+)", 1)))
    lines = F.filter(F.split("exc_text", "\n"), lambda x: x.rlike(r"^[A-Za-z_][\w.]*(:|$)") & ~x.startswith("Traceback"))
    kind = F.regexp_extract(F.try_element_at(lines, F.lit(-1)), r"^([A-Za-z_][\w.]*)", 1)
    return logs.withColumn("exc_type", F.nullif(kind, F.lit(""))).withColumn("exc_location", place).drop("exc_text")


def stamp_correlation(logs: DataFrame, runs: DataFrame) -> DataFrame:
    """FLT-11: ``attrs['correlation_id']`` comes from ``runs(run_id, correlation_id)`` only; any other value is removed."""
    r = runs.select("run_id", F.col("correlation_id").alias("_id"))
    rest = F.map_filter("attrs", lambda k, v: k != "correlation_id")
    stamped = F.when(F.col("_id").isNotNull(), F.map_concat(rest, F.create_map(F.lit("correlation_id"), F.col("_id")))).otherwise(rest)
    return logs.join(r, "run_id", "left").withColumn("attrs", stamped).drop("_id")
