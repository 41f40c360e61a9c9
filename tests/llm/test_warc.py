"""Archives: SQL, ranges of any size, false magics, revisits."""

import gzip

import pytest
from oracle import connect, expected, found
from pyspark.sql import functions as F

from lattiq.llm import warc
from lattiq.llm.queries import ORACLE_SQL, QUERIES


def test_query_equals_sql(spark):
    sf = "/root/testdata/sf0.01"
    assert found(QUERIES["op6_warc"](spark, sf)) == expected(connect(sf), ORACLE_SQL["op6_warc"])


@pytest.mark.parametrize("range_bytes", [1, 97, 5000, 1 << 20])
def test_ranges_own_what_starts_inside(tmp_path, range_bytes):
    records = [warc.record(i, f"http://x/{i}", bytes([31, 139, 8]) * i + gzip.compress(b"WARC/ no"), None, "d") for i in range(12)]
    path = tmp_path / "a.warc.gz"
    junk = warc.MAGIC + b"\0junk" + gzip.compress(b"no record", compresslevel=0)
    path.write_bytes(junk + b"".join(records) + junk)
    size, got = path.stat().st_size, []
    for start in range(0, size, range_bytes):
        got += [int(warc.parse(raw)["fields"]["warc-record-id"].split(":")[-1][:-1]) for _, raw in warc.members(f"file://{path}", start, min(size, start + range_bytes))]
    assert got == list(range(12))


def test_odd_pages(spark, scratch):
    rows = [(1, "u", "<p>x"), (2, None, "<p>x"), (2, None, "<p>x"), (3, "a b", None), (4, "u", ""), (None, "u", "<p>x"), (None, None, "only"), (9, "u", "é" * 300_000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit("clash")).withColumn("refers_to", F.lit(1))
    manifest = warc.write_archives(pages, scratch)
    got = sorted((tuple(r) for r in warc.read_archives(manifest, keep_payload=True, range_bytes=777).select("page_id", "payload_bytes", "record_type", "refers_to").collect()), key=repr)
    assert got == sorted([(1, 4, "revisit", 2), (2, 4, "response", None), (2, 4, "response", None), (3, 0, "revisit", 4), (4, 0, "response", None), (None, 4, "revisit", 2), (None, 4, "response", None), (9, 600_000, "response", None)], key=repr)
    assert warc.read_archives(warc.write_archives(pages.limit(0), scratch.__class__(spark, "none"))).count() == 0


def test_ranges_are_dealt_by_the_bytes_of_archives(spark):
    """50 GB of archives: 6400 ranges, which are a few rows, are read by many tasks, each with a few of them."""
    manifest = spark.createDataFrame([(f"file:///none/{i}", 256 << 20, 1) for i in range(200)], "path string, bytes long, records long")
    asked = []
    of = warc.map_arrow
    try:
        warc.map_arrow = lambda df, fn, schema: asked.append(df) or of(df, fn, schema)
        warc.read_archives(manifest)
    finally:
        warc.map_arrow = of
    tasks = [r["count"] for r in asked[0].groupBy(F.spark_partition_id()).count().collect()]
    assert sum(tasks) == 6400 and len(tasks) >= 400 and max(tasks) <= 32
