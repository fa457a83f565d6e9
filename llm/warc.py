"""WARC archives with a two-level capture index.

*Archives.* Every task writes the records of its partition, each a gzip member, to files of its own and returns a
manifest row for each record; only manifest rows of committed tasks are kept (as a table in the shared folder), so a
repeated or lost task leaves at most an unused file. Equal payloads are found by digest: the page with the largest id
is a ``response``, the others are ``revisit`` records that name it.

*Index.* Captures are range-partitioned and sorted by reversed-host URL key. Every partition becomes a file of
compressed blocks and a sparse directory of each block's first and last key. The top level is one row a partition. A
lookup searches the top level, the directory and the block by bisection, reads that block's byte range, and then
the record's byte range in its archive.

Edge cases: a null html is an empty payload; a null URL has an empty key and the target ``about:blank``; control
characters and blanks in URLs are percent-encoded; rows that repeat an id and a payload are all responses if no larger
id has that payload, otherwise all revisits; rows with a null id are never referred to while any equal payload has an
id, and come back with a null id; other columns are ignored; an empty table gives an empty index and no rows.
"""

from __future__ import annotations

import base64
import bisect
import gzip
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from llm.common import new_path, stored

BLOCK_CAPTURES, ARCHIVE_BYTES, LEVEL, BATCH = 256, 256 << 20, 4, 512
DATE = "1970-01-01T00:00:00Z"
CAPTURE = "key binary, page_id long, file string, offset long, length long"
FOUND = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary"


def surt(url: str = "url") -> F.Column:
    """Reversed-host key: ``net,example,www)/path?query``; empty for a null URL."""
    u = F.coalesce(F.col(url).cast("string"), F.lit(""))
    host = F.lower(F.regexp_extract(u, r"(?s)^.*?://([^/?#]*)", 1))
    rest = F.regexp_extract(u, r"(?s)^.*?://[^/?#]*(.*)$", 1)
    key = F.when(u.contains("://"), F.concat(F.array_join(F.reverse(F.split(host, "\\.")), ","), F.lit(")"), rest)).otherwise(u)
    return F.regexp_replace(key, r"[\x00-\x20\x7f]", "%20")


def capture_key() -> F.Column:
    """The URL key and the page id, which tells captures of one URL apart."""
    return F.concat(surt(), F.lit(" "), F.coalesce(F.col("page_id").cast("string"), F.lit("-"))).cast("binary")


def _open(path: str):
    fs, at = pyarrow.fs.FileSystem.from_uri(path)
    return fs, at


class _Ranges:
    """Byte ranges of files, with the most recent files kept open."""

    def __init__(self, keep: int = 64) -> None:
        self.files: dict[str, object] = {}
        self.keep = keep

    def read(self, path: str, offset: int, length: int) -> bytes:
        f = self.files.pop(path, None)
        if f is None:
            fs, at = _open(path)
            f = fs.open_input_file(at)
            if len(self.files) >= self.keep:
                self.files.pop(next(iter(self.files))).close()
        self.files[path] = f
        f.seek(offset)
        return f.read(length)

    def whole(self, path: str) -> bytes:
        fs, at = _open(path)
        with fs.open_input_stream(at, compression=None) as f:
            return f.read()


def record_id(page_id: int | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}')}>"


def record(page_id: int | None, url: str | None, payload: bytes, digest: bytes, refers_to: int | None) -> bytes:
    """One WARC record; a revisit carries the HTTP header of the full payload and no payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    revisit = refers_to is not None
    block = http if revisit else http + payload
    uri = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url) if url else "about:blank"
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {record_id(page_id)}",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {uri}",
        f"WARC-Payload-Digest: sha1:{base64.b32encode(digest).decode()}",
    ]
    if revisit:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {record_id(refers_to)}", f"X-Refers-To-Page: {refers_to}"]
    if page_id is not None:
        lines.append(f"X-Page: {page_id}")
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(data: bytes) -> dict:
    """A record's fields. A response's size and digest are those of the payload that was read; a mismatch is an error."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
    http, _, payload = rest[: int(fields["Content-Length"])].partition(b"\r\n\r\n")
    said = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    length = int(re.search(rb"Content-Length: (\d+)", http)[1])
    revisit = fields["WARC-Type"] == "revisit"
    if not revisit and (base64.b32encode(hashlib.sha1(payload).digest()).decode() != said or len(payload) != length):
        raise ValueError(f"damaged record {fields['WARC-Record-ID']}")
    number = lambda k: int(fields[k]) if k in fields else None
    return {"page_id": number("X-Page"), "url": fields["WARC-Target-URI"], "record_type": fields["WARC-Type"], "refers_to": number("X-Refers-To-Page"), "payload_bytes": length, "payload_digest": said, "payload": None if revisit else payload}


def write_archives(pages: DataFrame, folder: str, least: int = 0) -> DataFrame:
    """Writes one record for each row of ``pages(page_id, url, html)`` and returns the captures (a stored table).

    Payloads of fewer than ``least`` bytes are never revisits.
    """
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    digests = pages.select("page_id", F.unhex(F.sha1(F.col("html").cast("binary"))).alias("digest"), F.octet_length("html").alias("n"))
    last = digests.where(F.col("n") >= least).groupBy("digest").agg(F.max("page_id").alias("original"), F.count(F.lit(1)).alias("copies")).where("copies > 1")
    revisits = digests.join(last, "digest").where((F.col("page_id") < F.col("original")) | (F.col("page_id").isNull() & F.col("original").isNotNull()))
    # an id may have rows with different payloads, so the digest belongs to the key
    revisits = stored(revisits.select("page_id", "digest", "original").distinct(), "revisits")
    known = pages.withColumn("digest", F.unhex(F.sha1(F.col("html").cast("binary"))))
    r = revisits.select(F.col("page_id").alias("of"), F.col("digest").alias("same"), "original")
    ready = known.join(r, F.col("page_id").eqNullSafe(F.col("of")) & (F.col("digest") == F.col("same")), "left").withColumn("key", capture_key())
    fs, at = _open(folder)
    fs.create_dir(at, recursive=True)

    def write(batches: Iterator[pa.RecordBatch]):
        out, path, offset = None, "", 0
        for whole in batches:
            for start in range(0, whole.num_rows, BATCH):
                b = whole.slice(start, BATCH)
                rows = []
                for page_id, url, html, digest, original, key in zip(*(b.column(c).to_pylist() for c in ("page_id", "url", "html", "digest", "original", "key")), strict=True):
                    if out is None or offset > ARCHIVE_BYTES:
                        if out is not None:
                            out.close()
                        path, offset = f"{folder}/{uuid.uuid4().hex}.warc.gz", 0
                        fs, at = _open(path)
                        out = fs.open_output_stream(at, compression=None)
                    data = gzip.compress(record(page_id, url, html.encode(), digest, original), LEVEL, mtime=0)
                    out.write(data)
                    rows.append((key, page_id, path, offset, len(data)))
                    offset += len(data)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.binary(), pa.int64(), pa.string(), pa.int64(), pa.int64()), strict=True)], ["key", "page_id", "file", "offset", "length"])
        if out is not None:
            out.close()

    return stored(ready.select("page_id", "url", "html", "digest", "original", "key").mapInArrow(write, CAPTURE), "captures")


def build_index(captures: DataFrame, folder: str) -> list[tuple[bytes, bytes, str, str]]:
    """Writes blocks and directories; returns the top level: first key, last key, block file, directory file."""
    fs, at = _open(folder)
    fs.create_dir(at, recursive=True)

    def write(batches: Iterator[pa.RecordBatch]):
        path = f"{folder}/{uuid.uuid4().hex}"
        out, offset, directory, held = None, 0, [], []

        def block() -> None:
            nonlocal out, offset, held
            if out is None:
                fs, at = _open(path + ".blocks")
                out = fs.open_output_stream(at, compression=None)
            data = zlib.compress(b"\n".join(b"\t".join(x) for x in held), 6)
            out.write(data)
            directory.append((held[0][0], held[-1][0], b"%d" % offset, b"%d" % len(data)))
            offset, held = offset + len(data), []

        for b in batches:
            for k, f, o, n in zip(*(b.column(c).to_pylist() for c in ("key", "file", "offset", "length")), strict=True):
                held.append((k, f.encode(), b"%d" % o, b"%d" % n))
                if len(held) >= BLOCK_CAPTURES:
                    block()
        if held:
            block()
        if out is not None:
            out.close()
            fs, at = _open(path + ".directory")
            with fs.open_output_stream(at, compression=None) as f:
                f.write(zlib.compress(b"\n".join(b"\t".join(x) for x in directory), 6))
            yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in ((directory[0][0], pa.binary()), (directory[-1][1], pa.binary()), (path + ".blocks", pa.string()), (path + ".directory", pa.string()))], ["first", "last", "blocks", "directory"])

    n = max(1, int(captures.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    parts = captures.repartitionByRange(n, "key").sortWithinPartitions("key").mapInArrow(write, "first binary, last binary, blocks string, directory string")
    return sorted((bytes(r[0]), bytes(r[1]), r[2], r[3]) for r in parts.collect())  # one row a partition


def lookup(keys: DataFrame, top: list[tuple[bytes, bytes, str, str]], with_payload: bool = True) -> DataFrame:
    """Records of all captures whose key is in ``keys(key binary)``."""
    spark = keys.sparkSession
    level = spark.sparkContext.broadcast(top)  # one row for each index partition

    def run(batches: Iterator[pa.RecordBatch]):
        top = level.value
        lasts = [x[1] for x in top]
        files, opened, directory, dir_lasts, block_at, block, block_keys = _Ranges(), None, [], [], None, [], []
        for whole in batches:
            for start in range(0, whole.num_rows, BATCH):
                rows = []
                for key in whole.column("key").slice(start, BATCH).to_pylist():
                    p = bisect.bisect_left(lasts, key)
                    if p == len(top) or top[p][0] > key:
                        continue
                    if opened != p:
                        opened, block_at = p, None
                        directory = [x.split(b"\t") for x in zlib.decompress(files.whole(top[p][3])).split(b"\n")]
                        dir_lasts = [x[1] for x in directory]
                    j = bisect.bisect_left(dir_lasts, key)
                    while j < len(directory) and directory[j][0] <= key:
                        if block_at != j:
                            block_at = j
                            block = [x.split(b"\t") for x in zlib.decompress(files.read(top[p][2], int(directory[j][2]), int(directory[j][3]))).split(b"\n")]
                            block_keys = [x[0] for x in block]
                        for x in block[bisect.bisect_left(block_keys, key) : bisect.bisect_right(block_keys, key)]:
                            rows.append(parse(gzip.decompress(files.read(x[1].decode(), int(x[2]), int(x[3])))))
                        j += 1
                if not with_payload:
                    for r in rows:
                        r["payload"] = None
                yield pa.RecordBatch.from_pylist(rows, pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("payload", pa.binary())]))

    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return keys.repartitionByRange(n, "key").sortWithinPartitions("key").mapInArrow(run, FOUND)


def round_trip(spark: SparkSession, pages: DataFrame, least: int = 0) -> DataFrame:
    """Writes all pages, indexes the archives and reads every page back through the index."""
    folder = new_path(spark, "warc")
    captures = write_archives(pages, folder, least)
    top = build_index(captures, new_path(spark, "index"))
    keys = pages.select(capture_key().alias("key")).distinct()
    return lookup(keys, top, with_payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url")
