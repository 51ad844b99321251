"""Operator 9: WARC archives, one gzip member per record, and their reader.

``write_archives`` writes a response record per distinct payload and revisit
records for the other rows of equal payload.  ``read_archives`` reads each
archive once from front to end: it inflates in steps of ``CHUNK`` bytes, finds
the header end, frames the block by Content-Length, checks the payload digest
and expects every record to end with its own gzip member.

Defined cases: a null payload is an empty one; payloads under ``min_bytes``
are always responses; of equal payloads all rows with the largest id are
responses and the others refer to that id, so exact repeats of a row stay
equal; a null id counts as smaller than any other.  Only id, url and payload
columns are read.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import scratch_path
from .common import as_bytes, fresh_name, open_bytes, write_bytes

CHUNK = 1 << 16
DATE = "2000-01-01T00:00:00Z"      # fixed, so that reruns write equal archives
FIELDS = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _uri(page_id) -> str:
    return "urn:page:" + ("null" if page_id is None else str(page_id))


def record(page_id, url, payload: bytes, sha1: str, refers_to, is_response: bool) -> bytes:
    """One record as its own gzip member."""
    head = [b"WARC/1.1", b"WARC-Type: " + (b"response" if is_response else b"revisit"),
            f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{_uri(page_id)} {url}')}>".encode(),
            f"WARC-Date: {DATE}".encode(), f"X-Page-ID: {_uri(page_id)}".encode()]
    if url is not None:
        head.append(b"WARC-Target-URI: " + re.sub(r"[\r\n]", lambda m: f"%{ord(m[0]):02X}", url.replace("%", "%25")).encode())
    head += [f"WARC-Payload-Digest: sha1:{sha1}".encode(), f"X-Payload-Length: {len(payload)}".encode()]
    if not is_response:
        head += [b"WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
                 f"WARC-Refers-To: {_uri(refers_to)}".encode()]
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
    body = http + (payload if is_response else b"")
    head += [b"Content-Type: application/http;msgtype=response", f"Content-Length: {len(body)}".encode()]
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(b"\r\n".join(head) + b"\r\n\r\n" + body + b"\r\n\r\n") + z.flush()


def read_records(source, chunk: int = CHUNK):
    """Yield (headers, block) of every record of an archive, sequentially.
    Raises ValueError on a cut file, a bad frame or a wrong digest."""
    left, ended = b"", False
    while True:
        if not left:
            left = source.read(chunk)
            if not left:
                return
        inflate = zlib.decompressobj(31)
        data, need, head = bytearray(), None, None
        while not inflate.eof:
            if not left:
                left = source.read(chunk)
                ended = not left
                if ended:
                    raise ValueError("the archive ends inside a record")
            data += inflate.decompress(left)
            left = inflate.unused_data
            if head is None and (end := data.find(b"\r\n\r\n")) >= 0:
                lines = bytes(data[:end]).split(b"\r\n")
                if not lines[0].startswith(b"WARC/"):
                    raise ValueError("a record without a WARC header")
                head = {k.strip().lower().decode(): v.strip().decode() for k, _, v in (x.partition(b":") for x in lines[1:])}
                need = end + 4 + int(head["content-length"])
        if head is None or len(data) != need + 4 or data[need:] != b"\r\n\r\n":
            raise ValueError("a record does not fit its Content-Length")
        block = bytes(data[need - int(head["content-length"]):need])
        if head["warc-type"] == "response":
            payload = block[block.index(b"\r\n\r\n") + 4:]
            if head["warc-payload-digest"] != "sha1:" + digest(payload) or int(head["x-payload-length"]) != len(payload):
                raise ValueError("a payload does not match its digest")
        yield head, block


def _page_id(text: str):
    text = text.removeprefix("urn:page:")
    return None if text == "null" else int(text)


def write_archives(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html",
                   min_bytes: int = 0) -> DataFrame:
    """Manifest (path, records, bytes) of the archives written, one per task.

    Copies are found on (digest, id) alone, with the largest id per digest
    taken before the shuffle; payloads are shuffled once, by digest and id, so
    a payload that a third of all pages share is spread over all tasks."""
    spark = pages.sparkSession
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"),
                        F.coalesce(F.col(payload_col).cast("string"), F.lit("")).alias("payload"))
    rows = rows.withColumn("sha", F.sha1(F.encode("payload", "UTF-8")))
    # decided once per (digest, id); ids of one digest never meet in one task as rows
    seen = rows.select("sha", "page_id").distinct()
    top = seen.groupBy("sha").agg(F.max("page_id").alias("top"), F.count(F.lit(1)).alias("n")).where("n > 1")
    revisits = (seen.join(top.withColumnRenamed("sha", "sha_"), F.col("sha") == F.col("sha_"))
                .where(~F.col("page_id").eqNullSafe(F.col("top")))
                .select(F.col("sha").alias("sha_"), F.col("page_id").alias("id_"), "top"))
    rows = rows.join(revisits, (F.col("sha") == F.col("sha_")) & F.col("page_id").eqNullSafe(F.col("id_")), "left")
    rows = rows.select("page_id", "url", "payload", "sha", "top", F.col("sha_").isNotNull().alias("revisit"))
    folder = scratch_path(spark, "warc")

    def write(batches):
        counts = [0]

        def members():
            for b in batches:
                payloads = as_bytes(b.column(2))
                ids, urls, shas, tops, again = (b.column(i).to_pylist() for i in (0, 1, 3, 4, 5))
                for i, payload in enumerate(payloads):
                    sha = base64.b32encode(bytes.fromhex(shas[i])).decode()
                    counts[0] += 1
                    revisit = again[i] and len(payload) >= min_bytes
                    yield record(ids[i], urls[i], payload, sha, tops[i], not revisit)
        stream = members()
        first = next(stream, None)
        if first is not None:
            def parts():
                yield first
                yield from stream
            path, size = write_bytes(folder, fresh_name("archive", ".warc.gz"), parts())
            yield pa.RecordBatch.from_pydict({"path": [path], "records": [counts[0]], "bytes": [size]})
    at = scratch_path(spark, "warc-manifest")
    rows.mapInArrow(write, "path string, records long, bytes long").write.parquet(at)
    return spark.read.parquet(at)


def read_archives(manifest: DataFrame) -> DataFrame:
    """One row per record of all archives; a task reads whole archives."""
    n = max(1, manifest.count())

    def read(batches):
        for b in batches:
            for path in b.column(0).to_pylist():
                rows = []
                with open_bytes(path) as source:
                    for head, _ in read_records(source):
                        refers = head.get("warc-refers-to")
                        url = head.get("warc-target-uri")
                        if url is not None:
                            url = re.sub("%(0D|0A|25)", lambda m: chr(int(m[1], 16)), url)
                        rows.append((_page_id(head["x-page-id"]), url, int(head["x-payload-length"]),
                                     head["warc-payload-digest"].removeprefix("sha1:"), head["warc-type"],
                                     None if refers is None else _page_id(refers)))
                kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64())
                names = ("page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to")
                for i in range(0, len(rows), 10_000):
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows[i:i + 10_000]), kinds)], names)
    return manifest.select("path").repartition(n).mapInArrow(read, FIELDS)
