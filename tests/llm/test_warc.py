import gzip
import io

import duckdb
import pandas as pd
from pyspark.sql import functions as F

from ordinate.llm import warc
from ordinate.llm.common import shared_path

LONG, OTHER = "é" * 80, "y" * 200 + "\r\n\r\nWARC/1.1\r\n"
ROWS = [(5, "http://a/\r\n x", LONG), (3, None, LONG), (9, "u", LONG), (4, "u", OTHER), (6, "u", "short"), (7, "u", "short"), (8, "u", ""), (10, None, None), (None, "n", LONG), (3, "again", LONG)]


def table(spark):
    return spark.createDataFrame(ROWS, "page_id long, url string, html string").withColumn("digest", F.lit("clash"))


def test_records(spark):
    found = warc.resolved(warc.read_archives(warc.write_archives(table(spark), shared_path(spark, "w")))).collect()
    kinds = sorted((str(r.page_id), r.record_type, r.refers_to, r.payload_bytes) for r in found)
    assert kinds == sorted([("5", "revisit", 3, 160), ("3", "response", None, 160), ("3", "response", None, 160), ("9", "revisit", 3, 160), ("4", "response", None, len(OTHER)), ("6", "response", None, 5), ("7", "response", None, 5), ("8", "response", None, 0), ("10", "response", None, 0), ("None", "response", None, 160)])
    import hashlib

    assert {r.payload_digest for r in found if r.page_id in (3, 5, 9)} == {hashlib.sha256(LONG.encode()).hexdigest()}


def test_archives_are_plain_warc(spark):
    manifest = warc.write_archives(table(spark).repartition(3), shared_path(spark, "w"))
    total = 0
    for r in manifest.collect():
        data = open(r.path.removeprefix("file://"), "rb").read()
        own = list(warc.records(gzip.GzipFile(fileobj=io.BytesIO(data))))
        assert len(own) == r.n_records and data.count(b"\x1f\x8b\x08") >= len(own)
        total += len(own)
        for headers, block in own:
            assert len(block) == int(headers["content-length"]) and "\n" not in headers["warc-target-uri"]
            assert (headers["warc-type"] == "revisit") == ("warc-refers-to" in headers)
    assert total == len(ROWS)


def test_deduplicating_archives(spark):
    single = warc.write_archives(table(spark).filter("page_id = 9"), shared_path(spark, "w")).unionByName(warc.write_archives(table(spark).filter("page_id <> 9"), shared_path(spark, "w")))
    again = warc.resolved(warc.read_archives(warc.dedupe_archives(single, shared_path(spark, "w")))).collect()
    assert sorted((r.page_id, r.refers_to) for r in again if r.record_type == "revisit") == [(5, 3), (9, 3)]
    assert len(again) == len(ROWS) - 1


def test_deduplicating_odd_archives(spark, tmp_path):
    """A payload that isn't UTF-8, records without ids, orphans, and a revisit that becomes the original."""
    latin = "\u00e9".encode("latin-1") * 150
    digest = __import__("hashlib").sha256(latin).hexdigest()
    first = [warc.record("response", i, "u", digest, latin, None, "1970-01-01T00:00:00Z") for i in (7, 8)]
    first.append(warc.record("revisit", 2, "u", digest, b"", warc.record_id(8, digest), "1970-01-01T00:00:00Z"))
    first.append(warc.record("revisit", 9, "u", "gone", b"", "<urn:uuid:gone>", "1970-01-01T00:00:00Z"))
    first += [b"\r\n".join(x for x in r.split(b"\r\n") if not x.startswith((b"WARC-Record-ID", b"Page-ID"))) for r in (warc.record("response", 1, "n", "x", b"one", None, "d"), warc.record("response", 1, "n", "x", b"two", None, "d"))]
    path = tmp_path / "a.warc.gz"
    path.write_bytes(b"".join(map(warc.member, first)))
    manifest = spark.createDataFrame([(f"file://{path}",)], "path string")
    rows = warc.read_archives(warc.dedupe_archives(manifest, shared_path(spark, "w"))).collect()
    found = {r.page_id: r for r in rows if r.page_id is not None}
    assert bytes(found[2].payload) == latin and found[2].record_type == "response"
    assert found[7].record_type == found[8].record_type == "revisit" and found[7].refers_to_id == found[2].record_id
    assert found[9].record_type == "revisit" and found[9].refers_to_id == "<urn:uuid:gone>"
    assert sorted(bytes(r.payload) for r in rows if r.page_id is None) == [b"one", b"two"] and len(rows) == 6


def test_records_cut_off_or_without_length():
    data = warc.record("response", 1, "u", "x", b"payload", None, "d")
    for broken in (data[:-12], b"\r\n".join(x for x in data.split(b"\r\n") if not (x.startswith(b"Content-Length: ") and x != b"Content-Length: 7"))):
        try:
            list(warc.records(io.BytesIO(broken)))
        except ValueError:
            continue
        raise AssertionError(broken)


def test_empty_table(spark):
    assert warc.resolved(warc.read_archives(warc.write_archives(table(spark).limit(0), shared_path(spark, "w")))).collect() == []


def test_query(spark, sf_dir):
    connection = duckdb.connect()
    connection.sql(f"CREATE VIEW pages AS SELECT * FROM '{sf_dir}/pages.parquet'")
    tidy = [df.sort_values("page_id").reset_index(drop=True) for df in (warc.op3_warc(spark, sf_dir).toPandas(), connection.sql(warc.OP3_SQL).df())]
    pd.testing.assert_frame_equal(*tidy, check_dtype=False)
