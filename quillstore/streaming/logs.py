"""Streams of puts and links into the store."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType


def table_stream(spark: SparkSession, base: str, table: str, schema: StructType, files: int = 8) -> DataFrame:
    """The files of a Parquet table as a stream, `files` at a time; the table is a folder of files or one file."""
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files)
    return reader.option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", False).parquet(f"{base}/{table}.parquet*")


def deduplicated(stream: DataFrame, key: str, at: str, lateness: str) -> DataFrame:
    """Each key once, as long as its repeated deliveries come within `lateness` of each other; state older than that is dropped."""
    return stream.withWatermark(at, lateness).dropDuplicatesWithinWatermark([key])


def append_stream(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Write all that is there to the log at `path` and stop; a later run goes on where this one ended."""
    return stream.writeStream.format("parquet").option("checkpointLocation", checkpoint).option("path", path).trigger(availableNow=True).start()


def windowed_counts(stream: DataFrame, at: str, width: str, by: str, lateness: str) -> DataFrame:
    """window_start, `by`, n: rows per tumbling window; rows later than `lateness` don't count."""
    counts = stream.withWatermark(at, lateness).groupBy(F.window(at, width), by).agg(F.count(F.lit(1)).alias("n"))
    return counts.select(F.col("window.start").alias("window_start"), by, "n")


def upserted(stream: DataFrame, path: str, checkpoint: str, write) -> StreamingQuery:
    """Hand each micro-batch to `write(batch, path, batch_id)`; the id makes a repeated batch replace itself."""
    return stream.writeStream.foreachBatch(lambda batch, batch_id: write(batch, path, batch_id)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def replace_batch(batch: DataFrame, path: str, batch_id: int) -> None:
    """A micro-batch as a partition of its own, overwritten if it comes again."""
    batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")
