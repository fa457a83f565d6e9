"""URL filter: allow and block rules, and a logistic regression on hashed character n-grams for all other URLs.

The regression is trained from a small labelled URL table, by default a bounded sample (``TRAIN_URLS``) of the URLs
that a rule decides, with the rule's verdict as label.

Edge cases: a null URL or one without ``://`` has an empty host and path, fits no rule and is judged on empty
features (the model's intercept); without any labelled URL, or with labels of one kind, the score is constant; equal
URLs get equal verdicts, and white space in host and path is left out before n-grams are taken, so URLs that differ in it
alone have equal features (rules see it); rows that repeat a page are judged alike; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from llm import kernel
from llm.common import in_fraction
from llm.linear import fit_sparse, sigmoid

#: (verdict, host, path)
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))
TRAIN_URLS = 4096
SIZES, DIMS = (3, 4, 5), 1 << 16
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def with_parts(pages: DataFrame) -> DataFrame:
    """Adds ``host`` (A-Z lower-cased) and ``path``."""
    url = F.coalesce(F.col("url").cast("string"), F.lit(""))
    return pages.withColumn("host", F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER)).withColumn("path", F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1))


def rule_columns(rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits ``host`` and ``path`` and its verdict, or nulls."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, host, path in sorted(rules, key=lambda r: len(r[1] + r[2])):  # the longest is tested first
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(path)
        rule, verdict = F.when(fits, host + path).otherwise(rule), F.when(fits, what).otherwise(verdict)
    return rule, verdict


def ngrams(hosts: pa.Array, paths: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """``(row, dimension)`` of every hashed n-gram of ``^host$`` and ``^path$``."""
    rows, dims = [], []
    for salt, column in ((np.uint64(0x11), hosts), (np.uint64(0x77), paths)):
        marked = pa.array([f"^{''.join((x or '').split())}$" for x in column.to_pylist()], pa.string())
        for w in kernel.words(marked):
            length = w.ends - w.starts
            for n in SIZES:
                count = np.maximum(length - n + 1, 0)
                at = np.repeat(w.starts, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
                down = kernel._powers.down
                with np.errstate(over="ignore"):
                    h = kernel.mix(((w.sums[at + n] - w.sums[at]) * down[at]) ^ (salt + np.uint64(n << 8)))
                rows.append(np.repeat(w.first + np.arange(w.n_docs), count))
                dims.append((h >> np.uint64(20)).astype(np.int64) % DIMS)
    return np.concatenate(rows or [np.zeros(0, np.int64)]), np.concatenate(dims or [np.zeros(0, np.int64)])


def train(labelled: DataFrame) -> tuple[np.ndarray, float]:
    """Model from ``labelled(host, path, allowed double)``, a small table."""
    t = labelled.select("host", "path", "allowed").toArrow()
    y = np.asarray(t.column("allowed").to_pylist(), float)
    r, d = ngrams(t.column("host").combine_chunks(), t.column("path").combine_chunks()) if len(y) else (np.zeros(0, np.int64),) * 2
    weight = np.where(y > 0.5, 0.5 / max(1, (y > 0.5).sum()), 0.5 / max(1, (y <= 0.5).sum())) if len(y) else y
    scale = 1 / np.sqrt(np.maximum(1, np.bincount(r, minlength=len(y))))
    return fit_sparse(r, d, scale[r], y, weight, DIMS, l2=1e-6, rounds=150)


def judge(pages: DataFrame, rules=RULES, labelled: DataFrame | None = None) -> DataFrame:
    """``(page_id, host, path, rule, verdict, score)``; score is the regression's probability of ``allow``."""
    rule, verdict = rule_columns(rules)
    parts = with_parts(pages.select("page_id", "url")).withColumn("rule", rule).withColumn("verdict", verdict).drop("url")
    if labelled is None:
        url = F.concat_ws("\n", "host", "path")
        ruled = parts.where("verdict is not null").select("host", "path", "verdict").distinct()  # a URL has one verdict
        sample = ruled.where(in_fraction(url, 1.25 * TRAIN_URLS / max(1, ruled.count()))).orderBy(F.xxhash64(url), "host", "path").limit(TRAIN_URLS)
        labelled = sample.select("host", "path", (F.col("verdict") == "allow").cast("double").alias("allowed")).orderBy("host", "path")
    w, b = train(labelled)
    model = pages.sparkSession.sparkContext.broadcast((w.astype(np.float32), b))  # DIMS numbers

    def run(batches):
        w, b = model.value
        for x in batches:
            r, d = ngrams(x.column("host"), x.column("path"))
            n = np.bincount(r, minlength=x.num_rows)
            z = np.bincount(r, w[d], x.num_rows) / np.sqrt(np.maximum(1, n)) + b
            yield pa.RecordBatch.from_arrays([*x.columns, pa.array(sigmoid(z))], [*x.schema.names, "score"])

    kind = dict(parts.dtypes)["page_id"]
    scored = parts.mapInArrow(run, f"page_id {kind}, host string, path string, rule string, verdict string, score double")
    return scored.select("page_id", "host", "path", "rule", F.coalesce("verdict", F.when(F.col("score") >= 0.5, "allow").otherwise("block")).alias("verdict"), "score")
