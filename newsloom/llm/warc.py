"""WARC archives with payload de-duplication and a two-level capture index.

Method.  Every page becomes one gzip member of a WARC/1.1 archive: a response record, or a revisit record when an
equal payload has a smaller page id.  The capture index sorts the records by reversed-host URL key into compressed
blocks of BLOCK_LINES lines (level one) and keeps one directory row per block with its first and last key (level two).
A look-up binary-searches the directory, decompresses the blocks found, binary-searches their lines, and reads only
the byte range of each record.

Storage.  Spark has no sink for binary files, so an archive -- a complete .warc.gz of about ARCHIVE_BYTES -- is a row
of a Parquet table (archive, data).  That keeps Spark's task commit (a lost executor leaves no half archive) and works
on any store the session can reach; blocks and directory are Parquet tables too.

Scale.  The first page id of each payload is an aggregate with map-side combine over digests.  A bitmap of fixed size
(FILTER_BITS) marks the digests that occur more than once: a page whose bit is clear has a payload of its own and is
written where it is read; only the others are shuffled to meet the first id of their payload, hot payloads by broadcast
(see left_join_skewed).  A full bitmap would only mean that more pages take that way.  The index is range-partitioned by key and
position, so one URL with a third of all captures still spreads.

Edge cases.  Null html is an empty payload; null urls get a urn of the page id.  Rows with equal id and equal payload
get equal records.  A null page id is never the smallest; if all ids of a payload are null, all are responses.  Extra
columns are ignored; empty tables give empty archives.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from bisect import bisect_left
from urllib.parse import quote, unquote, urlsplit

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import field_type, left_join_skewed, stored

ARCHIVE_BYTES = 2 << 20
BLOCK_LINES = 3000
FILTER_BITS = 1 << 26
CAPTURED = "2024-01-01T00:00:00Z"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_UNSAFE = re.compile(r"[\x00-\x20\x7f]")


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id: str | None) -> str:
    return "<urn:page:" + ("null" if page_id is None else "id:" + quote(page_id, safe="")) + ">"


def page_of(urn: str | None) -> str | None:
    return unquote(urn[len("<urn:page:id:"):-1]) if urn and urn.startswith("<urn:page:id:") else None


def url_key(url: str) -> str:
    """Reversed-host key: http://www.example.com:80/a?b -> com,example)/a?b."""
    try:
        parts = urlsplit(url)
        host = (parts.hostname or "").removeprefix("www.")
        port = parts.port
    except ValueError:
        return _UNSAFE.sub(lambda m: quote(m.group()), url)
    if not host:
        return _UNSAFE.sub(lambda m: quote(m.group()), url)
    tail = (f":{port}" if port and port not in (80, 443) else "") + ")" + (parts.path or "/") + ("?" + parts.query if parts.query else "")
    return _UNSAFE.sub(lambda m: quote(m.group()), ",".join(reversed(host.split("."))) + tail)


def build_record(page_id: str | None, url: str | None, payload: bytes, digest: str, first: str | None, captured: str) -> bytes:
    """One gzip member; ``first`` is the page id of the response a revisit refers to, None for a response."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    body = http if first is not None else http + payload
    uri = _UNSAFE.sub(lambda m: quote(m.group()), url) if url else record_id(page_id)[1:-1]
    head = [
        "WARC/1.1", "WARC-Type: " + ("response" if first is None else "revisit"), f"WARC-Record-ID: {record_id(page_id)}",
        f"WARC-Date: {captured}", f"WARC-Target-URI: {uri}", f"WARC-Payload-Digest: sha1:{digest}",
        f"WARC-Block-Digest: sha1:{payload_digest(body)}", "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(body)}"]
    if first is not None:
        head += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: {record_id(first)}"]
    pack = zlib.compressobj(6, zlib.DEFLATED, 31)
    return pack.compress("\r\n".join(head).encode("utf-8") + b"\r\n\r\n" + body + b"\r\n\r\n") + pack.flush()


def parse_record(member: bytes) -> tuple[dict[str, str], bytes, int]:
    """(headers, payload, bytes of the full payload) of one gzip member; raises if a digest is wrong."""
    raw = zlib.decompress(member, 31)
    end = raw.index(b"\r\n\r\n")
    head = dict(line.split(": ", 1) for line in raw[:end].decode("utf-8").split("\r\n")[1:])
    body = raw[end + 4:end + 4 + int(head["Content-Length"])]
    http, payload = body.split(b"\r\n\r\n", 1)
    full = int(http.rsplit(b"Content-Length: ", 1)[1])
    if "sha1:" + payload_digest(body) != head["WARC-Block-Digest"]:
        raise ValueError(f"block digest of {head['WARC-Record-ID']} is wrong")
    if head["WARC-Type"] == "response" and "sha1:" + payload_digest(payload) != head["WARC-Payload-Digest"]:
        raise ValueError(f"payload digest of {head['WARC-Record-ID']} is wrong")
    return head, payload, full


def _place(digest: str) -> int:
    return int(digest[:12], 16) % FILTER_BITS


def _bit(digest: str, bitmap: dict[int, bytes]) -> bool:
    at = _place(digest)
    part = bitmap.get(at >> 16)
    return part is not None and bool(part[(at & 0xFFFF) >> 3] >> (at & 7) & 1)


def _bitmap(digests: DataFrame) -> dict[int, bytes]:
    """Slices of the bitmap that have a bit; at most FILTER_BITS / 8 bytes reach the driver."""

    def slices(rows: pd.DataFrame) -> pd.DataFrame:
        bits = np.zeros(1 << 16, np.uint8)
        bits[rows["at"].to_numpy() & 0xFFFF] = 1
        return pd.DataFrame({"slice": [int(rows["at"].iloc[0]) >> 16], "bits": [np.packbits(bits, bitorder="little").tobytes()]})

    at = F.pmod(F.conv(F.substring("digest", 1, 12), 16, 10).cast("long"), F.lit(FILTER_BITS))
    placed = digests.select(at.alias("at")).distinct().withColumn("slice", F.shiftright("at", 16))
    rows = placed.groupBy("slice").applyInPandas(slices, "slice long, bits binary").collect()
    return {r["slice"]: bytes(r["bits"]) for r in rows}


def archives(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
             min_bytes: int = 0, captured: str = CAPTURED) -> DataFrame:
    """(archive, data): complete .warc.gz archives of all pages; payloads under ``min_bytes`` are never revisits."""
    spark = pages.sparkSession
    src = pages.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"),
                       F.coalesce(F.col(html_col).cast("string"), F.lit("")).alias("html"))
    src = src.withColumn("digest", F.sha1("html"))
    large = src.where(F.octet_length("html") >= min_bytes).select("id", "digest")
    first = large.groupBy("digest").agg(F.min("id").alias("first"), F.count("*").alias("n"))
    first = stored(first.where("n > 1 and first is not null"), "payloads")
    total = first.agg(F.sum("n")).first()[0] or 0
    marked = spark.sparkContext.broadcast(_bitmap(first))

    def with_bit(value):
        def run(batches):
            for b in batches:
                yield b.filter(pa.array([_bit(d.as_py(), marked.value) == value for d in b.column(3)], pa.bool_()))
        return src.select("id", "url", "html", "digest").mapInArrow(run, src.schema)

    decided = left_join_skewed(with_bit(True), first, "digest", "n", total)
    revisit = F.col("first").isNotNull() & ~F.col("first").eqNullSafe(F.col("id")) & (F.octet_length("html") >= min_bytes)
    columns = [F.col("id").cast("string").alias("id"), "url"]
    rows = with_bit(False).select(*columns, "html", F.lit(None).cast("string").alias("first")).unionByName(
        decided.select(*columns, "html", F.when(revisit, F.col("first").cast("string")).alias("first")))

    def run(batches):
        task, count, held, size = TaskContext.get().partitionId(), 0, [], 0
        for b in batches:
            for i, u, h, f in zip(*b.columns):
                payload = h.as_py().encode("utf-8")
                held.append(build_record(i.as_py(), u.as_py(), payload, payload_digest(payload), f.as_py(), captured))
                size += len(held[-1])
                if size >= ARCHIVE_BYTES:
                    yield archive(task, count, held)
                    count, held, size = count + 1, [], 0
        if held:
            yield archive(task, count, held)

    def archive(task, count, records):
        return pa.RecordBatch.from_arrays([pa.array([f"pages-{task:06d}-{count:06d}.warc.gz"]),
                                           pa.array([b"".join(records)], pa.binary())], ["archive", "data"])

    return rows.mapInArrow(run, "archive string, data binary")


def capture_lines(stored_archives: DataFrame) -> DataFrame:
    """(k, archive, at, size): URL key and byte range of every record, read from the archives."""

    def run(batches):
        for b in batches:
            for name, data in zip(*b.columns):
                data = memoryview(data.as_py())
                key, at, size, pos = [], [], [], 0
                while pos < len(data):
                    member = zlib.decompressobj(31)
                    raw = member.decompress(data[pos:])
                    end = len(data) - len(member.unused_data)
                    head = raw[:raw.index(b"\r\n\r\n")].decode("utf-8")
                    key.append(url_key(re.search("\r\nWARC-Target-URI: (.*)", head)[1].rstrip("\r")))
                    at.append(pos)
                    size.append(end - pos)
                    pos = end
                yield pa.RecordBatch.from_arrays(
                    [pa.array(key, pa.string()), pa.array([name.as_py()] * len(key), pa.string()), pa.array(at, pa.int64()),
                     pa.array(size, pa.int64())], ["k", "archive", "at", "size"])

    return stored_archives.select("archive", "data").mapInArrow(run, "k string, archive string, at long, size long")


def index_blocks(lines: DataFrame) -> DataFrame:
    """(block, first_key, last_key, data): sorted lines 'key archive offset length' in compressed blocks."""
    ordered = lines.repartitionByRange("k", "archive", "at").sortWithinPartitions("k", "archive", "at")

    def run(batches):
        task, count, held = TaskContext.get().partitionId(), 0, []
        for b in batches:
            held += zip(*(c.to_pylist() for c in b.columns))
            while len(held) >= BLOCK_LINES:
                yield block(task, count, held[:BLOCK_LINES])
                count, held = count + 1, held[BLOCK_LINES:]
        if held:
            yield block(task, count, held)

    def block(task, count, rows):
        text = "\n".join(f"{k} {a} {o} {n}" for k, a, o, n in rows).encode("utf-8")
        return pa.RecordBatch.from_arrays(
            [pa.array([f"{task:06d}-{count:06d}"]), pa.array([rows[0][0]], pa.string()), pa.array([rows[-1][0]], pa.string()),
             pa.array([zlib.compress(text, 6)], pa.binary())], ["block", "first_key", "last_key", "data"])

    return ordered.mapInArrow(run, "block string, first_key string, last_key string, data binary")


def write_collection(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
                     min_bytes: int = 0, captured: str = CAPTURED) -> None:
    """Write archives, index blocks and the block directory below ``path``."""
    spark = pages.sparkSession
    archives(pages, id_col, url_col, html_col, min_bytes, captured).write.parquet(f"{path}/archives")
    index_blocks(capture_lines(spark.read.parquet(f"{path}/archives"))).write.parquet(f"{path}/blocks")
    spark.read.parquet(f"{path}/blocks").select("block", "first_key", "last_key").write.parquet(f"{path}/directory")


def _entries(blocks: DataFrame, keys: list[str] | None) -> DataFrame:
    """(archive, at, size) of the index lines; with ``keys`` (sorted) only those found by binary search."""

    def run(batches):
        for b in batches:
            for data in b.column(0):
                lines = zlib.decompress(data.as_py()).decode("utf-8").split("\n")
                if keys is not None:
                    names = [x.split(" ", 1)[0] for x in lines]
                    found = []
                    for k in keys[bisect_left(keys, names[0]):]:
                        if k > names[-1]:
                            break
                        i = bisect_left(names, k)
                        while i < len(names) and names[i] == k:
                            found.append(lines[i])
                            i += 1
                    lines = found
                part = [x.rsplit(" ", 3)[1:] for x in lines]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([p[0] for p in part], pa.string()), pa.array([int(p[1]) for p in part], pa.int64()),
                     pa.array([int(p[2]) for p in part], pa.int64())], ["archive", "at", "size"])

    return blocks.select("data").mapInArrow(run, "archive string, at long, size long")


def read_records(spark: SparkSession, path: str, urls: list[str] | None = None) -> DataFrame:
    """(page_id string, url, payload_bytes, payload_digest, record_type, refers_to string, payload) through the index.

    ``urls`` is a list held by the caller; None reads every indexed record.  Digests are verified while reading.
    """
    blocks, held = spark.read.parquet(f"{path}/blocks"), spark.read.parquet(f"{path}/archives")
    keys = None
    if urls is not None:
        keys = sorted({url_key(_UNSAFE.sub(lambda m: quote(m.group()), u)) for u in urls})

        def hits(batches):
            for b in batches:
                first, last = b.column(1).to_pylist(), b.column(2).to_pylist()
                near = [(i := bisect_left(keys, f)) < len(keys) and keys[i] <= x for f, x in zip(first, last)]
                yield b.select(["block"]).filter(pa.array(near, pa.bool_()))

        wanted = spark.read.parquet(f"{path}/directory").select("block", "first_key", "last_key").mapInArrow(hits, "block string")
        blocks = blocks.join(wanted, "block", "left_semi")
    ranges = _entries(blocks, keys).groupBy("archive").agg(F.collect_list(F.struct("at", "size")).alias("ranges"))

    def run(batches):
        for b in batches:
            for data, ranges in zip(*b.columns):
                data, rows = memoryview(data.as_py()), []
                for r in ranges.as_py():
                    head, payload, full = parse_record(data[r["at"]:r["at"] + r["size"]])
                    rows.append((page_of(head["WARC-Record-ID"]), head["WARC-Target-URI"], full,
                                 head["WARC-Payload-Digest"].removeprefix("sha1:"), head["WARC-Type"],
                                 page_of(head.get("WARC-Refers-To")), payload if head["WARC-Type"] == "response" else None))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*rows), types)] if rows else [pa.array([], t) for t in types], names)

    names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"]
    types = [pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.binary()]
    schema = T.StructType([T.StructField(n, {pa.int64(): T.LongType(), pa.binary(): T.BinaryType()}.get(t, T.StringType()))
                           for n, t in zip(names, types)])
    return held.join(ranges, "archive").select("data", "ranges").mapInArrow(run, schema)


def archive_round_trip(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url",
                       html_col: str = "html", min_bytes: int = 0) -> DataFrame:
    """Write the collection below ``path`` and read every record back; ids get their own type again."""
    write_collection(pages, path, id_col, url_col, html_col, min_bytes)
    kind = field_type(pages, id_col)
    back = read_records(pages.sparkSession, path).drop("payload")
    return back.withColumns({"page_id": F.col("page_id").cast(kind), "refers_to": F.col("refers_to").cast(kind)})
