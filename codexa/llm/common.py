"""What several operators share: settled tables, bounded Arrow batches, document keys."""

from __future__ import annotations

import functools
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text handed to a kernel at once, in bytes; a longer single text goes alone.
BATCH_BYTES = 4_000_000


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or the context's checkpoint folder.

    A session in one process may do without; elsewhere a folder of one machine would lose rows, so none is made up.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        named = spark.sparkContext.getCheckpointDir()
    if not named:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir names no folder that driver and executors share")
        named = "file://" + tempfile.mkdtemp(prefix="codexa-")
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


#: Rows and bytes of an Arrow batch; Spark's defaults hold tens of MB of text twice, in the JVM and in Python.
ARROW = {"spark.sql.execution.arrow.maxRecordsPerBatch": "1000", "spark.sql.execution.arrow.maxBytesPerBatch": "2000000"}
#: Parquet's vectored reads take a column of a row group (100 MB and more of text) in one piece; Java then keeps a buffer of
#: that size outside the heap for each of its reading threads, for good. Plain reads take 8 MB at a time, on the heap.
#: They still hold a row group's column, and a writer holds a row group; so these are written in 16 MB, not 128.
PARQUET = {"parquet.hadoop.vectored.io.enabled": "false", "parquet.block.size": "16000000"}


def bounded(df: DataFrame) -> DataFrame:
    """The table; its session's Arrow batches, Parquet reads and row groups are made smaller where the user has not set their size."""
    conf = df.sparkSession.conf
    own = conf.getAll
    for key, value in (ARROW | PARQUET).items():
        if key not in own:
            conf.set(key, value)
    return df


def release() -> None:
    """Give memory that Arrow holds in reserve back to the system."""
    pa.default_memory_pool().release_unused()


def settle(df: DataFrame) -> DataFrame:
    """Write a table to the shared folder and reread it: computed once, lineage cut, safe when executors go.

    The file system deletes the folder when the driver's process ends; until then any table built on it can be read again.
    """
    spark = bounded(df).sparkSession
    path = f"{shared_dir(spark)}/settled-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(folder)
    return spark.read.schema(df.schema).parquet(path)


def pieces(batches: Iterator[pa.RecordBatch], column: str, limit: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches cut so that a column holds about `limit` bytes at most; a single longer value stays whole."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        begin, held = 0, 0
        for i, size in enumerate(sizes.tolist()):
            if i > begin and held + size > limit:
                yield batch.slice(begin, i - begin)
                begin, held = i, 0
            held += size
        if begin < batch.num_rows:
            yield batch.slice(begin)


def as_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of each text; null counts as empty."""
    return pc.fill_null(column.cast(pa.large_binary()), b"").to_pylist()


def text_key(text: str = "text") -> Column:
    """Tells apart rows that share a doc_id (or have none); equal doc_id and text are one document."""
    return F.xxhash64(F.col(text))


def part(function, **fixed):
    """A mapInArrow function with its parameters bound."""
    return functools.partial(function, **fixed)
