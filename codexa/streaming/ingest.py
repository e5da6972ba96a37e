"""Books as they arrive: a file stream through the same parser, each file once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from codexa.sources.reader import parse_books


def stream_books(spark: SparkSession, folder: str, files_per_batch: int = 100, **options) -> DataFrame:
    """A streaming table of parsed files; append mode, no state, so no watermark is needed."""
    files = (
        spark.readStream.format("binaryFile")
        .schema("path string, modificationTime timestamp, length long, content binary")
        .option("maxFilesPerTrigger", files_per_batch)
        .option("recursiveFileLookup", "true")
        .load(folder)
    )
    return parse_books(files.select("path", "content"), **options)


def ingest(parsed: DataFrame, target: str, checkpoint: str) -> StreamingQuery:
    """Write what has arrived to Parquet and stop; run again for what is new."""
    return parsed.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
