"""WARC archives: a writer of one gzip member a record, and a splittable reader."""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagescore.llm.common import scratch, table, written

#: A new archive is begun when one has so many bytes; a reading task scans so many.
ARCHIVE_BYTES, SPLIT_BYTES = 1 << 30, 8 << 20
#: Ranges that a task reads one after another, where there are enough of them to keep all cores at work.
TASK_RANGES = 16
#: Payloads of fewer bytes are never revisits.
LEAST_REVISIT = 0

_MAGIC, _PROFILE = b"\x1f\x8b\x08", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_DATE = "2024-01-01T00:00:00Z"  # a fixed capture date: the table has none, and reruns agree
RECORD = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary"
MANIFEST = "path string, bytes long, records long"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """One record. A revisit keeps the HTTP head, with the length of the payload that it leaves out."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    body = head + (payload if refers_to is None else b"")
    fields = [
        "WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{'' if page is None else page}>", f"WARC-Date: {_DATE}",
        *([f"WARC-Target-URI: {re.sub(r'[\x00-\x20\x7f]', lambda m: f'%{ord(m[0]):02X}', url)}"] if url else []),
        *([f"WARC-Refers-To: <urn:page:{refers_to}>", f"WARC-Profile: {_PROFILE}"] if refers_to is not None else []),
        f"WARC-Payload-Digest: sha1:{digest(payload)}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(body)}",
    ]
    return "\r\n".join(fields).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def member(data: bytes) -> bytes:
    """A gzip member without a time, so that reruns agree."""
    pack = zlib.compressobj(6, zlib.DEFLATED, 31)
    return pack.compress(data) + pack.flush()


def first_copies(pages: DataFrame, page: str, payload: Column) -> DataFrame:
    """Add _first: the smallest page of those with an equal payload (null if all are null), where the payload has LEAST_REVISIT bytes."""
    hashed = pages.withColumn("_payload", F.coalesce(payload, F.lit(b""))).withColumn("_sha", F.sha1("_payload"))
    # only digests that several pages have are joined, from a table, so that one that very many have is split among tasks
    several = hashed.groupBy("_sha").agg(F.min(page).alias("_first"), F.count(F.lit(1)).alias("_n")).where("_n > 1").select(F.col("_sha").alias("_s"), F.col("_first"))
    joined = hashed.join(written(several, "copies"), F.col("_sha") == F.col("_s"), "left")
    return joined.withColumn("_first", F.when(F.length("_payload") >= LEAST_REVISIT, F.coalesce("_first", page))).drop("_s", "_sha")


def qualified(spark: SparkSession, folder: str) -> str:
    """The folder with its scheme, by the file system under which Spark reads it, as pyarrow.fs takes it: a path without one
    is then not the machine's own disk by chance."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    full = path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toUri()
    return f"{full.getScheme().replace('s3a', 's3')}://{full.getAuthority() or ''}{full.getPath()}"


def write_archives(pages: DataFrame, folder: str, page: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Write a record for every row, and return the manifest: path, bytes and records of each archive.

    The payload is the html in UTF-8, empty for null. Of equal payloads the one of the smallest page is a response and
    the others revisit it; rows that repeat the smallest page are responses too, and so is a null page if no other
    has its payload. An archive's name belongs to one attempt of a task, so that one that is lost or runs twice leaves
    files that the manifest doesn't name. Columns but these three are ignored.
    """
    folder = qualified(pages.sparkSession, folder)
    rows = first_copies(pages.select(F.col(page).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), F.encode(F.col(html), "utf-8").alias("html")), "page_id", F.col("html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = fs.FileSystem.from_uri(folder)
        store.create_dir(base, recursive=True)
        out, done, name, size, count = None, [], "", 0, 0
        for b in batches:
            for own, address, payload, first in zip(*(b.column(c).to_pylist() for c in ("page_id", "url", "_payload", "_first")), strict=True):
                if out is None:
                    name, size, count = f"{base}/{uuid.uuid4().hex}.warc.gz", 0, 0
                    out = store.open_output_stream(name, compression=None)
                packed = member(record(own, address, payload, None if first is None or first == own else first))
                out.write(packed)
                size, count = size + len(packed), count + 1
                if size >= ARCHIVE_BYTES:
                    out.close()
                    out = done.append((name, size, count))
        if out is not None:
            out.close()
            done.append((name, size, count))
        root = folder[: len(folder) - len(base)] if folder.endswith(base) else ""
        yield pa.RecordBatch.from_arrays([pa.array([root + d[0] for d in done], pa.string()), pa.array([d[1] for d in done], pa.int64()), pa.array([d[2] for d in done], pa.int64())], names=["path", "bytes", "records"])

    return written(rows.select("page_id", "url", "_payload", "_first").mapInArrow(run, MANIFEST), "warc-manifest")


def fields_of(data: bytes) -> tuple[dict[str, str], int] | None:
    """The fields of a whole record head at the start of data, by lower-cased name, and the head's length; None if it is none."""
    end = data.find(b"\r\n\r\n")
    if not data.startswith(b"WARC/1.") or end < 0:
        return None
    pairs = [line.partition(":") for line in data[:end].decode("utf-8", "replace").split("\r\n")[1:]]
    fields = {k.strip().lower(): v.strip() for k, sep, v in pairs if sep}
    known = {"warc-type", "warc-record-id", "content-length"} <= fields.keys() and fields["content-length"].isdigit()
    return (fields, end + 4) if known else None


def members(file, start: int, end: int, size: int) -> Iterator[tuple[dict[str, str], bytes]]:
    """Fields and block of each record whose member starts in [start, end).

    Every gzip magic number in the range is a candidate. It is a record if its first bytes decode to a record head, and
    if the member then decodes as a whole, with its checksum, to a block of the length that the head tells; the search
    goes on behind it. Other candidates are bytes that happen to look like one.
    """
    chunk = 1 << 20
    file.seek(start)
    data, at, base = file.read(min(end + 2, size) - start), 0, start
    while True:
        at = data.find(_MAGIC, at)
        if at < 0 or base + at >= end:
            return
        unpack, out, read_to, head = zlib.decompressobj(31), bytearray(), base + len(data), None
        feed, more = data[at : at + 4096], at + 4096
        try:
            while True:
                out += unpack.decompress(feed)
                if head is None and (len(out) >= 8 or unpack.eof):
                    if not out.startswith(b"WARC/1."):
                        break
                    head = fields_of(bytes(out)) if b"\r\n\r\n" in out else None
                if unpack.eof:
                    break
                if more < len(data):
                    feed, more = data[more : more + chunk], more + chunk
                else:  # the record goes on behind the range
                    file.seek(read_to)
                    feed = file.read(chunk)
                    read_to += len(feed)
                    if not feed:
                        break
        except zlib.error:
            at += 1
            continue
        if not unpack.eof or head is None or len(out) < head[1] + int(head[0]["content-length"]):
            at += 1
            continue
        fields, begin = head
        yield fields, bytes(out[begin : begin + int(fields["content-length"])])
        used = len(unpack.unused_data)
        behind = (base + min(more, len(data)) if read_to == base + len(data) else read_to) - used
        at = behind - base
        if behind >= end:
            return


def _page(urn: str | None) -> int | None:
    found = re.fullmatch(r"<urn:page:(-?\d+)>", urn or "")
    return int(found[1]) if found else None


def read_archives(manifest: DataFrame, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """A row for each record of the archives, each read by the one task in whose byte range it starts.

    payload is null for a revisit, whose payload_bytes and payload_digest are those of the payload that it leaves out.
    An empty manifest gives an empty result.
    """
    total = int(manifest.agg(F.sum(F.ceil(F.col("bytes") / split_bytes))).first()[0] or 1)
    tasks = max(min(total, 2 * manifest.sparkSession.sparkContext.defaultParallelism), -(-total // TASK_RANGES))
    splits = manifest.select("path", "bytes", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("bytes") - 1, F.lit(0)), F.lit(split_bytes).cast("long"))).alias("start"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["page_id", "url", "record_type", "refers_to", "payload_bytes", "payload_digest", "payload"]
        kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
        pack = lambda rows: pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names=names)
        rows, held = [], 0
        for b in batches:
            for path, size, start in zip(*(b.column(c).to_pylist() for c in ("path", "bytes", "start")), strict=True):
                store, name = fs.FileSystem.from_uri(path)
                with store.open_input_file(name) as file:
                    for fields, block in members(file, start, min(start + split_bytes, size), size):
                        head, _, payload = block.partition(b"\r\n\r\n")
                        length = int(re.search(rb"(?mi)^content-length:\s*(\d+)", head)[1])
                        revisit = fields["warc-type"] == "revisit"
                        if not revisit and (len(payload) != length or fields["warc-payload-digest"] != f"sha1:{digest(payload)}"):
                            raise ValueError(f"{path}: record {fields['warc-record-id']} doesn't hold the payload that its head tells")
                        rows.append((_page(fields["warc-record-id"]), fields.get("warc-target-uri"), fields["warc-type"], _page(fields.get("warc-refers-to")), length, fields["warc-payload-digest"].removeprefix("sha1:"), None if revisit else payload))
                        held += len(payload)
                        if len(rows) >= 2000 or held >= 1 << 24:
                            yield pack(rows)
                            rows, held = [], 0
        yield pack(rows)

    return splits.repartition(tasks).mapInArrow(run, RECORD)


def op7_warc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page, as it is read back from the archives."""
    manifest = write_archives(table(spark, sf_dir, "pages"), scratch(spark, "warc"))
    return read_archives(manifest).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP7_SQL = """
WITH h AS (SELECT page_id, coalesce(html, '') AS t, sha1(coalesce(html, '')) AS x FROM pages),
v AS (SELECT *, [CAST('0x' || substr(x, 5 * k + 1, 5) AS INTEGER) for k in range(8)] AS parts, min(page_id) OVER (PARTITION BY x) AS first FROM h)
SELECT page_id, CAST(strlen(t) AS BIGINT) AS payload_bytes,
  array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((parts[k // 4 + 1] >> (15 - 5 * (k % 4))) & 31) + 1, 1) for k in range(32)], '') AS payload_digest,
  CASE WHEN first <> page_id THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN first <> page_id THEN first END AS refers_to
FROM v
"""
