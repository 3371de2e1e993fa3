"""WARC archives: writing, reading, and revisit records for repeated payloads.

Headers (id, payload digest, length) are shuffled by payload digest to choose
the original of each group of equal payloads: the smallest id. Archives are then
written with fresh headers: the original is a ``response``, every other one a
``revisit`` without payload that refers to it. On reading, revisits are joined
to the responses that they refer to.

Each record is a gzip member of its own. A task writes files under names that
no other attempt uses and returns their paths; only files of attempts that
succeeded are in the manifest, so a lost executor leaves nothing that is read.

Defined results: a null payload is the empty payload. Payloads under
``min_bytes`` are always responses, and so are rows with a null id. Rows that
repeat the smallest id of their payload are all responses. A url that is null
becomes ``about:blank``; control characters in urls are percent-encoded. Extra
columns are left out. Payloads are bytes of any kind and length. In archives from
elsewhere, a revisit whose response isn't among them stays a revisit with the
same reference; records without an id are never referred to; a record that is cut
off or has no length raises an error.
"""

from __future__ import annotations

import gzip
import os
import uuid
import zlib
from urllib.parse import quote, urlparse

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import as_batch, shared_path, sliced, written

VERSION, PROFILE = b"WARC/1.1", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MIN_BYTES = 100
#: A file is closed once it has as many bytes.
FILE_BYTES = 256 << 20
_SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")


def _local(path: str) -> str | None:
    url = urlparse(path)
    return url.path if url.scheme in ("", "file") else None


def _open_new(path: str):
    if (local := _local(path)) is not None:
        os.makedirs(os.path.dirname(local), exist_ok=True)
        return open(local, "xb")
    system, inner = pyarrow.fs.FileSystem.from_uri(path)
    return system.open_output_stream(inner)


def _open(path: str):
    if (local := _local(path)) is not None:
        return open(local, "rb")
    system, inner = pyarrow.fs.FileSystem.from_uri(path)
    return system.open_input_stream(inner)


def record_id(page_id: int | None, digest: str) -> str:
    """The same for the same page and payload."""
    return f"<urn:uuid:{uuid.uuid5(_SPACE, f'{page_id} {digest}')}>"


def record(kind: str, page_id: int | None, url: str | None, digest: str, payload: bytes, refers_to: str | None, date: str) -> bytes:
    """One record, uncompressed; ``refers_to`` is the id of a record."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode() if kind == "response" else b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
    block = http + payload if kind == "response" else http
    fields = [("WARC-Type", kind), ("WARC-Record-ID", record_id(page_id, digest)), ("WARC-Date", date), ("WARC-Target-URI", quote(url, safe="".join(map(chr, range(33, 127)))) if url else "about:blank"), ("WARC-Payload-Digest", f"sha256:{digest}")]
    if page_id is not None:
        fields.append(("Page-ID", str(page_id)))
    if kind == "revisit":
        fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", refers_to)]
    fields += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    return b"\r\n".join([VERSION, *(f"{k}: {v}".encode() for k, v in fields), b"", block, b"", b""])


def member(data: bytes, level: int = 6) -> bytes:
    """``data`` as one gzip member."""
    packer = zlib.compressobj(level, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def records(stream):
    """(headers, block) of each record of a WARC stream, one at a time; the
    names of headers are lower-cased."""
    while line := stream.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"not a WARC record: {line[:40]!r}")
        headers: dict[str, str] = {}
        while (line := stream.readline().strip(b"\r\n")):
            name, _, value = line.partition(b":")
            headers[name.decode().lower()] = value.strip().decode()
        if "content-length" not in headers:
            raise ValueError("a record has no length")
        size = int(headers["content-length"])
        block = stream.read(size)
        if len(block) != size:
            raise ValueError("a record is cut off")
        yield headers, block


_MANIFEST = pa.schema([("path", pa.string()), ("n_records", pa.int64()), ("n_bytes", pa.int64())])


def _write(folder: str, date: str):
    def run(batches):
        out, path, count, size, done = None, "", 0, 0, []
        for batch in sliced(batches):
            for page_id, url, payload, digest, original, refers in zip(*(c.to_pylist() for c in batch.columns)):
                if out is None:
                    path, count, size = f"{folder}/{uuid.uuid4().hex}.warc.gz", 0, 0
                    out = _open_new(path)
                if refers is None and original is not None and page_id is not None and original != page_id:
                    refers = record_id(original, digest)
                data = member(record("response" if refers is None else "revisit", page_id, url, digest, payload, refers, date))
                out.write(data)
                count, size = count + 1, size + len(data)
                if size >= FILE_BYTES:
                    out.close()
                    done.append((path, count, size))
                    out = None
        if out is not None:
            out.close()
            done.append((path, count, size))
        if done:
            yield as_batch(_MANIFEST, *(list(x) for x in zip(*done)))

    return run


def originals(pages: DataFrame, min_bytes: int = MIN_BYTES) -> DataFrame:
    """digest, original: of payloads that repeat, the smallest id."""
    headers = pages.filter(F.octet_length("payload") >= min_bytes).select("page_id", "digest")
    return headers.groupBy("digest").agg(F.min("page_id").alias("original"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("digest", "original")


def write_archives(pages: DataFrame, folder: str, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_bytes: int = MIN_BYTES, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """Writes archives of ``pages`` under ``folder`` and returns the manifest
    (path, n_records, n_bytes), itself written beside them."""
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(html_col).cast("binary"), F.expr("cast('' as binary)")).alias("payload"))
    rows = rows.withColumn("digest", F.sha2("payload", 256))
    known = written(originals(rows, min_bytes), "originals")
    return _written_archives(rows.join(known, "digest", "left").withColumn("refers", F.lit(None).cast("string")), folder, date)


def _written_archives(planned: DataFrame, folder: str, date: str) -> DataFrame:
    rows = planned.select("page_id", "url", "payload", "digest", "original", "refers")
    return written(rows.mapInArrow(_write(folder, date), "path string, n_records long, n_bytes long"), "manifest")


_RECORDS = pa.schema([("record_type", pa.string()), ("record_id", pa.string()), ("page_id", pa.int64()), ("url", pa.string()), ("declared_digest", pa.string()), ("refers_to_id", pa.string()), ("payload", pa.binary())])


def _read(batches):
    for batch in batches:
        for path in batch.column(0).to_pylist():
            rows, size = [], 0
            with _open(path) as raw, gzip.GzipFile(fileobj=raw) as stream:
                for h, block in records(stream):
                    payload = block.partition(b"\r\n\r\n")[2] if "msgtype=response" in h.get("content-type", "") else block
                    page_id = h.get("page-id")
                    rows.append((h["warc-type"], h.get("warc-record-id"), None if page_id is None else int(page_id), h.get("warc-target-uri"), h.get("warc-payload-digest", "").partition(":")[2] or None, h.get("warc-refers-to"), payload if h["warc-type"] != "revisit" else None))
                    size += len(payload)
                    if size > 4 << 20 or len(rows) >= 1000:
                        yield as_batch(_RECORDS, *(list(x) for x in zip(*rows)))
                        rows, size = [], 0
            if rows:
                yield as_batch(_RECORDS, *(list(x) for x in zip(*rows)))


def read_archives(manifest: DataFrame) -> DataFrame:
    """One row for each record of the files in ``manifest`` (path, ...)."""
    paths = manifest.select("path")
    spread = paths.repartition(max(1, paths.sparkSession.sparkContext.defaultParallelism * 4), "path")
    return spread.mapInArrow(_read, "record_type string, record_id string, page_id long, url string, declared_digest string, refers_to_id string, payload binary")


def resolved(found: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of records:
    revisits get length, digest and id of the response that they refer to."""
    heads = written(found.select("record_type", "record_id", "page_id", "refers_to_id", "declared_digest", F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_digest")), "records")
    responses = heads.filter("record_type != 'revisit'")
    targets = responses.groupBy(F.col("record_id").alias("refers_to_id")).agg(F.min("page_id").alias("refers_to"), F.first("payload_bytes").alias("payload_bytes"), F.first("payload_digest").alias("payload_digest"))
    wanted = heads.filter("record_type = 'revisit'").select("page_id", "refers_to_id", "declared_digest", "record_type")
    known = written(targets.join(wanted.select("refers_to_id").distinct(), "refers_to_id", "left_semi"), "targets")
    revisits = wanted.join(known, "refers_to_id", "left").select("page_id", "payload_bytes", F.coalesce("payload_digest", "declared_digest").alias("payload_digest"), "record_type", "refers_to")
    return responses.select("page_id", "payload_bytes", "payload_digest", "record_type", F.lit(None).cast("long").alias("refers_to")).unionByName(revisits)


def dedupe_archives(manifest: DataFrame, folder: str, *, min_bytes: int = MIN_BYTES, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """Archives in, deduplicated archives out, with fresh headers.

    Originals are chosen anew from the headers of all records, revisits under the
    digest of their response. Payloads move only to a revisit that becomes an
    original; all others go straight from where they are read to where they are
    written. Revisits without their response are carried over.
    """
    found = read_archives(manifest)
    heads = written(found.select("record_type", "record_id", "page_id", "url", "refers_to_id", "declared_digest", F.octet_length("payload").alias("size"), F.sha2("payload", 256).alias("digest")), "heads")
    responses = heads.filter("record_type <> 'revisit'")
    targets = responses.filter("record_id IS NOT NULL").groupBy(F.col("record_id").alias("refers_to_id")).agg(F.min("digest").alias("digest"), F.min("size").alias("size"))
    revisits = written(heads.filter("record_type = 'revisit'").drop("digest", "size").join(targets, "refers_to_id", "left"), "revisits")
    known = responses.select("page_id", "digest", "size").unionByName(revisits.filter("digest IS NOT NULL").select("page_id", "digest", "size")).filter(F.col("size") >= min_bytes)
    known = written(known.groupBy("digest").agg(F.min("page_id").alias("original"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("digest", "original"), "originals")
    none, empty = F.lit(None).cast("string"), F.expr("cast('' as binary)")
    first = found.filter("record_type <> 'revisit'").withColumn("digest", F.sha2("payload", 256)).join(known, "digest", "left").withColumn("refers", none)
    back = revisits.filter("digest IS NOT NULL").join(known, "digest", "left")
    whole = F.coalesce(F.col("original") == F.col("page_id"), F.lit(True)) | F.col("page_id").isNull()
    wanted = back.filter(whole)
    bodies = found.filter("record_type <> 'revisit'").select(F.col("record_id").alias("refers_to_id"), "payload").join(wanted.select("refers_to_id").distinct(), "refers_to_id", "left_semi").dropDuplicates(["refers_to_id"])
    columns = ["page_id", "url", "payload", "digest", "original", "refers"]
    again = wanted.join(bodies, "refers_to_id").withColumn("refers", none)
    still = back.filter(~whole).withColumns({"payload": empty, "refers": none})
    lost = revisits.filter("digest IS NULL").select("page_id", "url", empty.alias("payload"), F.coalesce("declared_digest", F.lit("")).alias("digest"), F.lit(None).cast("long").alias("original"), F.coalesce("refers_to_id", F.lit("")).alias("refers"))
    planned = first.select(*columns).unionByName(again.select(*columns)).unionByName(still.select(*columns)).unionByName(lost.select(*columns))
    return _written_archives(planned, folder, date)


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    return resolved(read_archives(write_archives(pages, shared_path(spark, "warc"))))


OP3_SQL = """
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages
), o AS (
  SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS original FROM p
)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN original IS NULL OR page_id IS NULL OR original = page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN original <> page_id THEN original END AS refers_to
FROM o
"""
