"""What the operators of this subpackage share: scratch tables and Arrow batches."""

from __future__ import annotations

import atexit
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lattiq.checkpoints import ensure_folder
from lattiq.session import importable

#: Bytes of text of a slice of documents that a Python worker holds at a time.
SLICE_CHARS = 1_000_000

#: Bytes of an Arrow batch on its way to or from a Python worker; a single longer row is a batch of its own.
BATCH_BYTES = 8 << 20

#: Bytes of files that a reading task takes on, once there are more than tasks to fill the machine.
TASK_BYTES = 128 << 20

HOLD_OUT = 3


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (``spark.checkpoint.dir``); where that is unset, what ``ensure_folder`` sets."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        ensure_folder(spark)
        base = spark.sparkContext.getCheckpointDir()
    return base.rstrip("/")


class Scratch:
    """Tables that cut a plan's lineage, under the shared folder.

    An executor that is lost takes nothing with it: what was written is read
    again from the shared folder.  Tables go when ``drop`` is called or when
    the driver ends.
    """

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/lattiq-{label}-{uuid.uuid4().hex}"
        atexit.register(self._end)

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def cut(self, df: DataFrame, name: str) -> DataFrame:
        df.write.option("compression", "zstd").parquet(self.path(name))
        return self.read(name, df)

    def read(self, name: str, like: DataFrame) -> DataFrame:
        return self.spark.read.schema(like.schema).parquet(self.path(name))

    def drop(self, *names: str) -> None:
        for name in names:
            self._delete(self.path(name))

    def _delete(self, path: str) -> None:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)

    def _end(self) -> None:
        try:
            self._delete(self.root)
        except Exception:  # the JVM has ended already
            pass


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(doc_id: Column) -> Column:
    """crc32 of the id as text, mod 3, is 1: such rows are never learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % HOLD_OUT == 1, F.lit(False))


def parts(batches: Iterator[pa.RecordBatch], text: str, limit: int | None = None) -> Iterator[pa.RecordBatch]:
    """The non-empty batches in parts of about ``limit`` (SLICE_CHARS) bytes of text; a longer row is a part of its own."""
    limit = limit or SLICE_CHARS
    for batch in batches:
        if not batch.num_rows:
            continue
        column = batch.column(batch.schema.get_field_index(text))
        ends = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        start = 0
        while start < batch.num_rows:
            so_far = int(ends[start - 1]) if start else 0
            n = max(1, int(np.searchsorted(ends, so_far + limit, side="right")) - start)
            yield batch.slice(start, n)
            start += n


def slices(batches: Iterator[pa.RecordBatch], text: str) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """``parts`` with their texts (null: empty); only a part's texts become Python strings at a time."""
    for part in parts(batches, text):
        yield part, [t or "" for t in part.column(part.schema.get_field_index(text)).to_pylist()]


def dealt(df: DataFrame, n_rows: int, n_bytes: int) -> DataFrame:
    """``df``, whose rows name pieces of files, dealt out by the bytes of those files.

    A number of partitions that is given is not merged by adaptive execution,
    which sees only the few bytes of the rows themselves.
    """
    n = max(2 * df.sparkSession.sparkContext.defaultParallelism, -(-n_bytes // TASK_BYTES))
    return df.repartition(max(1, min(n_rows, n)))


def map_arrow(df: DataFrame, fn: Callable, schema: str) -> DataFrame:
    """``df.mapInArrow`` in batches of bounded bytes: rows alone bound nothing where texts are long.

    Workers are used again by later tasks, so each gives back what Arrow holds when its task ends.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from fn(batches)
        finally:
            pa.default_memory_pool().release_unused()

    importable(df.sparkSession)
    for key in ("maxBytesPerBatch", "maxBytesPerOutputBatch"):
        df.sparkSession.conf.set(f"spark.sql.execution.arrow.{key}", str(BATCH_BYTES))
    return df.mapInArrow(run, schema)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """These names, lengthened until none is a column of ``df`` (whose names may differ in case alone)."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        out.append(name)
    return out


def check_columns(df: DataFrame, *names: str) -> DataFrame:
    """df with these columns alone, so that others never clash with an operator's own."""
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df.select(*names)
