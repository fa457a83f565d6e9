"""What the operators of this subpackage share: tables in the shared folder and connected components."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, ``spark.checkpoint.dir``; one of our own only where the session names
    none and all tasks run in this process (tests)."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        where = "file://" + tempfile.mkdtemp(prefix="spark-shared-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


def new_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"


#: Rows and bytes of an Arrow batch of texts; the session's own limits (10 000 rows) hold many megabytes on both sides.
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": "2048", "spark.sql.execution.arrow.maxBytesPerBatch": "4194304"}


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Jobs started inside pass texts between JVM and Python in small batches; the session's settings return afterwards."""
    old = {k: spark.conf.get(k, None) for k in BATCH}
    try:
        for k, v in BATCH.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in old.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def stored(df: DataFrame, tag: str) -> DataFrame:
    """Writes ``df`` to the shared folder and reads it back: lineage ends there and lost executors lose nothing."""
    path = new_path(df.sparkSession, tag)
    with small_batches(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Deletes the files of a table that ``stored`` has written and that no later result reads."""
    for file in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(file)
        path.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def fold(column: str, n: int) -> Column:
    """crc32 of an id as text modulo ``n``: the fold that the contracts name. A null id is in no fold (null)."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % n


def in_fraction(column: Column, fraction: float) -> Column:
    """A deterministic sample of about ``fraction`` of the rows by a hash of ``column``."""
    return F.pmod(F.xxhash64(column), F.lit(1 << 30)) < F.lit(int(min(1.0, fraction) * (1 << 30)))


#: Edges that a task contracts at once.
CHUNK_EDGES = 500_000


def least_labels(x: np.ndarray, y: np.ndarray, n: int) -> np.ndarray:
    """The smallest node that each of the nodes 0 to n - 1 reaches over the edges ``x[i]``, ``y[i]``."""
    label = np.arange(n)
    while len(x):
        lx, ly = label[x], label[y]
        least = np.minimum(lx, ly)
        np.minimum.at(label, lx, least)
        np.minimum.at(label, ly, least)
        while not np.array_equal(up := label[label], label):
            label = up
        apart = label[x] != label[y]
        x, y = x[apart], y[apart]
    return label


def contracted(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges ``(node, smallest node it reaches)`` that connect what the edges from ``a`` to ``b`` connect.

    Edges that are among the given ones are left out where the node is in ``b`` only: they are told where it is in ``a``.
    """
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    label = least_labels(x, y, len(nodes))
    below = np.flatnonzero(label != np.arange(len(nodes)))
    known = np.unique(np.maximum(x, y) * len(nodes) + np.minimum(x, y))
    want = below * len(nodes) + label[below]
    place = np.minimum(np.searchsorted(known, want), max(0, len(known) - 1))
    fresh = known[place] != want if len(known) else np.ones(len(below), bool)
    own = np.zeros(len(nodes), bool)
    own[x] = True
    below = below[fresh | own[below]]
    return nodes[below], nodes[label[below]]


def _contract(batches: Iterator[pa.RecordBatch], chunk: int) -> Iterator[pa.RecordBatch]:
    """Contracts edges that come sorted by node, about ``chunk`` at a time; a node's edges are parted only where it alone
    has more."""

    def flush(a, b):
        return pa.RecordBatch.from_arrays([pa.array(x) for x in contracted(a, b)], ["a", "b"])

    held, size = [], 0
    for batch in batches:
        held.append([batch.column(i).to_numpy() for i in (0, 1)])
        size += batch.num_rows
        if size >= chunk:
            a, b = (np.concatenate([x[i] for x in held]) for i in (0, 1))
            while len(a) >= chunk:
                cut = int(np.searchsorted(a, a[chunk - 1]))  # in front of the node that the chunk would part
                cut = cut or chunk
                yield flush(a[:cut], b[:cut])
                a, b = a[cut:], b[cut:]
            held, size = [[a, b]], len(a)
    if size:
        yield flush(*(np.concatenate([x[i] for x in held]) for i in (0, 1)))


def components(edges: DataFrame, chunk: int = CHUNK_EDGES) -> DataFrame:
    """Connected components of ``edges(a long, b long)`` as ``(node, component)``, component the smallest node.

    Every round has two steps, and both keep what is connected connected. First both directions of all edges are dealt by
    node and each task contracts the edges that it holds, in chunks, to edges from each node to the smallest one that it
    reaches there. Then every edge's smaller end is replaced by that node's own smallest neighbour, if it has a smaller one.
    The rounds end when every node has one edge to a smaller node which has none itself; that is counted over all edges,
    so neither the size of chunks nor a node of very many edges, which is dealt to several tasks, can end them early.
    No group is held whole; ``chunk`` is 2 at least. The edges of a round are a table in the shared folder, which goes when the next one is written.
    Self loops and repeated edges are allowed; rows with a null end count for nothing; no edges give no rows.
    """
    e = stored(edges.where("a <> b").select(F.greatest("a", "b").cast("long").alias("a"), F.least("a", "b").cast("long").alias("b")).distinct(), "edges")
    before = None
    while True:
        both = e.select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("e")).select("e.*")
        dealt = both.hint("rebalance", F.col("a")).sortWithinPartitions("a").mapInArrow(lambda batches: _contract(batches, chunk), "a long, b long")
        star = stored(dealt.distinct(), "edges")
        discard(e)
        own = star.groupBy("a").agg(F.min("b").alias("up"), F.count(F.lit(1)).alias("n"))
        several, deep = Observation(), Observation()
        own = own.observe(several, F.count_if(F.col("n") > 1).alias("n")).select(F.col("a").alias("_node"), "up")
        jumped = star.join(own, F.col("b") == F.col("_node"), "left").observe(deep, F.count_if(F.col("up").isNotNull()).alias("n"), F.sum(F.xxhash64("a", "b") % 1_000_003).alias("sum"), F.count(F.lit(1)).alias("rows"))
        e = stored(jumped.select("a", F.coalesce("up", "b").alias("b")), "edges")
        if not (told := deep.get)["rows"] or not (told["n"] or several.get["n"]):  # without rows the join's other side isn't run
            discard(e)
            break
        if (state := (told["sum"], told["rows"])) == before:
            raise RuntimeError("a round of contractions changed nothing")
        before = state
        discard(star)
    return star.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(star.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
