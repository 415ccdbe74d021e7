"""What the operators share: the shared scratch folder, table cuts and row-wise Arrow helpers."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Lower-cases A-Z only, as the contracts ask; Spark's lower() also changes other letters.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession) -> str:
    """A new folder under the session's spark.checkpoint.dir, which all executors share.

    Only a session on one machine may go without that setting; it gets a folder of its own.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.match(r"local(\[|$)", spark.conf.get("spark.master", "")):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="spark-scratch-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Write df to the shared folder and read it back: its lineage ends there, so a lost executor costs no recomputation."""
    spark, path = df.sparkSession, scratch(df.sparkSession)
    with shuffles_removed(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def cut_bucketed(df: DataFrame, key: str) -> DataFrame:
    """cut(), dealt by key into as many buckets as there are shuffle partitions: later joins on key leave these rows where they are."""
    spark, name = df.sparkSession, f"cut_{uuid.uuid4().hex}"
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    with shuffles_removed(spark):
        df.write.format("parquet").bucketBy(n, key).option("path", scratch(spark)).saveAsTable(name)
    table = spark.table(name)
    spark.sql(f"DROP TABLE {name}")  # the name only: the files are the table's own
    return table


def discard(df: DataFrame) -> None:
    """Remove the files of a table that cut() has written and nothing reads any more."""
    files = df.inputFiles()
    if files:
        df.sparkSession.createDataFrame([], df.schema).write.mode("overwrite").parquet(files[0].rpartition("/")[0])


#: While a table is written: shuffle files go when the query that made them ends, and few rows stand in an Arrow batch, of which a task holds two or three.
_WRITING = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.execution.arrow.maxRecordsPerBatch": "1000"}


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """What is written needs its shuffle files no more, and little memory."""
    before = {key: spark.conf.get(key) for key in _WRITING}
    for key, value in _WRITING.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)


def ascii_lower(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def map_batches(
    df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str, text: str = "text", most_bytes: int = 1 << 20
) -> DataFrame:
    """mapInArrow over slices of at most most_bytes of text (a longer text is a slice of its own), so memory is bounded."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text, most_bytes):
                out = fn(part)
                if out.num_rows:
                    yield out

    return df.mapInArrow(run, schema)


def slices(batch: pa.RecordBatch, text: str, most_bytes: int) -> Iterator[pa.RecordBatch]:
    import numpy as np
    import pyarrow.compute as pc

    if not batch.num_rows:
        return
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    first, base = 0, 0
    while first < batch.num_rows:
        last = max(first + 1, int(np.searchsorted(ends, base + most_bytes, "right")))
        yield batch.slice(first, last - first)
        base, first = int(ends[last - 1]), last
