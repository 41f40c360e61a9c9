"""Slices of batches, scratch tables, held-out rows."""

import zlib

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lattiq.llm import common


@pytest.mark.parametrize("limit", [1, 5, 1000])
def test_slices_hold_every_row_once(monkeypatch, limit):
    monkeypatch.setattr(common, "SLICE_CHARS", limit)
    texts = ["", None, "abc", "é" * 4, "x" * 50, "", "y"]
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(7)), "text": pa.array(texts, pa.string())})
    empty = batch.slice(0, 0)
    parts = list(common.slices(iter([batch.slice(1), empty, batch.slice(0, 1)]), "text"))
    assert [i for b, _ in parts for i in b.column(0).to_pylist()] == [1, 2, 3, 4, 5, 6, 0]
    assert [t for _, ts in parts for t in ts] == [t or "" for t in [*texts[1:], texts[0]]]
    assert all(len(ts) == 1 or sum(len(t.encode()) for t in ts) <= limit for _, ts in parts)


def test_held_out(spark):
    ids = [*range(50), None]
    df = spark.createDataFrame([(i,) for i in ids], "doc_id long")
    got = {r[0]: r[1] for r in df.select("doc_id", common.held_out(F.col("doc_id"))).collect()}
    assert got == {i: i is not None and zlib.crc32(str(i).encode()) % 3 == 1 for i in ids}


def test_scratch_tables(spark, scratch):
    df = scratch.cut(spark.range(10).withColumn("x", F.lit(None).cast("string")), "t")
    assert df.count() == 10 and df.columns == ["id", "x"]
    scratch.drop("t")
    fs = spark._jvm.org.apache.hadoop.fs.Path(scratch.path("t")).getFileSystem(spark._jsc.hadoopConfiguration())
    assert not fs.exists(spark._jvm.org.apache.hadoop.fs.Path(scratch.path("t")))


def test_missing_columns(spark):
    with pytest.raises(ValueError):
        common.check_columns(spark.range(1), "doc_id")
