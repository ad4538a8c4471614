"""WARC archives: gzip members written by tasks, and a splittable reader.

Writing: one record a page, each its own gzip member, in files of about ROLL bytes. Pages with equal payloads of at
least LEAST bytes share one response record, that of the smallest page_id; the others become revisit records that
refer to it and leave the payload out. The digests are joined with the few that occur more than once; the join's
hot keys can be split by adaptive execution, and pages are never gathered by payload. Shorter payloads, which are
all responses, have keys of their own, so that empty pages don't meet.

Reading: files are cut into byte ranges of SPLIT bytes, dealt over a number of tasks that grows with the bytes (each
range is a task of its own up to ALONE of them). A task scans its range for the gzip magic, takes a candidate
as a member only if it decodes to a WARC header, and reads each record that starts inside its range to its end, also
past the range. The check sum of the member, its length against Content-Length and the payload's digest are verified.
Files are reached through pyarrow's file systems (local, HDFS, S3, GCS), under the folder the session shares.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import prepare, scratch

LEAST, ROLL, SPLIT, BLOCK = 100, 32 << 20, 4 << 20, 1 << 18
#: Ranges up to which each has a task, and ranges of a task beyond.
ALONE, RANGES = 4096, 16
MAGIC = b"\x1f\x8b\x08"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Fixed: archives of the same pages are the same.
DATE = "2024-01-01T00:00:00Z"
PAGES = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool) -> bytes:
    """The record as one gzip member."""
    name = lambda i: f"<urn:page:{'' if i is None else i}>"
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {name(page_id)}", f"WARC-Date: {DATE}"]
    if url is not None:
        head.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url))
    head.append(f"WARC-Payload-Digest: sha256:{digest}")
    if revisit:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {name(refers_to)}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress("\r\n".join(head).encode() + block + b"\r\n\r\n") + packer.flush()


def with_records(pages: DataFrame) -> DataFrame:
    """page_id, url, payload, digest, first (the response's page_id, where a payload is shared), revisit."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html"), F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumn("digest", F.sha2("payload", 256))
    long_ = F.octet_length("payload") >= LEAST
    shared = rows.where(long_).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
    shared = shared.where("n > 1 and first is not null").select(F.col("digest").alias("shared"), "first")
    own = F.concat(F.lit("-"), F.xxhash64("page_id", "url", "digest").cast("string"))  # no digest begins so
    rows = rows.withColumn("shared", F.when(long_, F.col("digest")).otherwise(own)).join(shared, "shared", "left").drop("shared")
    return rows.withColumn("revisit", F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first")))


def write_archives(pages: DataFrame, folder: str) -> DataFrame:
    """Write the archives into `folder`; (path, bytes, records) of the files that count. A task that is run again
    writes files of its own, and only those of the attempt that Spark commits are listed."""
    prepare(pages.sparkSession)

    def run(batches):
        store, base = fs.FileSystem.from_uri(folder)
        store.create_dir(base, recursive=True)
        out, done, path, size, count = None, [], "", 0, 0
        for batch in batches:
            for page_id, url, payload, digest, first, revisit in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if out is None:
                    path, size, count = f"{base}/{uuid.uuid4().hex}.warc.gz", 0, 0
                    out = store.open_output_stream(path, compression=None)
                member = record(page_id, url, payload, digest, first, revisit)
                out.write(member)
                size, count = size + len(member), count + 1
                if size >= ROLL:
                    out.close()
                    done.append((path, size, count))
                    out = None
        if out is not None:
            out.close()
            done.append((path, size, count))
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*done, strict=True)], ["path", "bytes", "records"])

    rows = with_records(pages).select("page_id", "url", "payload", "digest", "first", "revisit")
    return rows.mapInArrow(run, "path string, bytes long, records long")


class Members:
    """The WARC records of one file that start in a byte range."""

    def __init__(self, source, start: int, end: int):
        self.source, self.start, self.end = source, start, end
        self.size = source.size()

    def read(self, at: int, n: int) -> bytes:
        self.source.seek(at)
        return self.source.read(min(n, self.size - at)) if at < self.size else b""

    def member(self, at: int, head: bytes) -> tuple[bytes, int] | None:
        """The member that starts at `at` and its end; None if no WARC record decodes there."""
        decoder = zlib.decompressobj(31)
        try:
            out, begun = [decoder.decompress(head)], at + len(head)
            known = out[0]
            while len(known) < 8 and not decoder.eof and (more := self.read(begun, BLOCK)):
                begun += len(more)
                out.append(decoder.decompress(more))
                known = b"".join(out)
            if not known.startswith(b"WARC/1."):
                return None
            while not decoder.eof:
                if not (more := self.read(begun, BLOCK)):
                    return None
                begun += len(more)
                out.append(decoder.decompress(more))
        except zlib.error:
            return None
        return b"".join(out), begun - len(decoder.unused_data)

    def __iter__(self):
        at = self.start
        while at < self.end:
            block = self.read(at, BLOCK + len(MAGIC) - 1)
            found = block.find(MAGIC)
            if found < 0 or at + found >= self.end:
                if len(block) < BLOCK:
                    return
                at += BLOCK
                continue
            got = self.member(at + found, block[found:])
            if got is None:
                at += found + 1
            else:
                yield got[0]
                at = got[1]


def parsed(data: bytes) -> tuple:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of a record; ValueError if it is damaged."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = [x.partition(": ") for x in head.decode().split("\r\n")[1:]]
    field = {k.lower(): v for k, _, v in lines}
    length = int(field["content-length"])
    if rest[length:] != b"\r\n\r\n":
        raise ValueError(f"record {field['warc-record-id']}: its length is not {length}")
    number = lambda v: int(v[10:-1]) if v and len(v) > 11 else None
    http, _, payload = rest[:length].partition(b"\r\n\r\n")
    digest, size = field["warc-payload-digest"].removeprefix("sha256:"), int(re.search(rb"Content-Length: (\d+)", http)[1])
    if field["warc-type"] == "response" and (len(payload) != size or hashlib.sha256(payload).hexdigest() != digest):
        raise ValueError(f"record {field['warc-record-id']}: its payload is damaged")
    return number(field["warc-record-id"]), size, digest, field["warc-type"], number(field.get("warc-refers-to"))


def read_archives(files: DataFrame, folder: str, split: int = SPLIT) -> DataFrame:
    """The records of files (path, bytes), read by byte ranges."""
    prepare(files.sparkSession)

    def run(batches):
        store, _ = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for path, start, end in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                with store.open_input_file(path) as source:
                    rows = [parsed(m) for m in Members(source, start, end)]
                kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True) if rows else [()] * 5, kinds, strict=True)], ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])

    starts = files.where("bytes > 0").select("path", "bytes", F.explode(F.sequence(F.lit(0), F.col("bytes") - 1, F.lit(split))).alias("start"))
    ranges = starts.select("path", "start", F.least(F.col("start") + split, F.col("bytes")).alias("end"))
    return ranges.repartition(tasks_of(files, split)).mapInArrow(run, PAGES)


def tasks_of(files: DataFrame, split: int = SPLIT) -> int:
    """The number of tasks that read the files: an explicit one, which adaptive execution doesn't merge."""
    ranges = files.agg(F.sum(F.ceil(F.col("bytes") / split))).first()[0] or 1
    return int(min(ranges, ALONE) + max(ranges - ALONE, 0) // RANGES)


def round_trip(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """One row a page as read back from the archives written for `pages` (page_id, url, html).

    Null html is empty, a null url has no header. Rows that repeat the smallest page_id of a shared payload are all
    responses; a null page_id is never the one referred to. An empty table writes no archive and gives no rows."""
    folder = scratch(spark, "warc")
    files = write_archives(pages, folder)
    listed = scratch(spark, "warc-files")
    files.write.parquet(listed)
    return read_archives(spark.read.schema("path string, bytes long, records long").parquet(listed), folder)
