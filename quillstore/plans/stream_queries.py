"""Queries that run the streaming forms over the given tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstore.sources.tables import read_table, shared_folder
from quillstore.streaming import logs


#: How much later than newer ones puts and events may come; state older than that is dropped.
PUT_LATENESS, EVENT_LATENESS = "60 days", "2 days"


def _places(spark: SparkSession) -> tuple[str, str]:
    folder = f"{shared_folder(spark)}/quillstore-stream-{uuid.uuid4().hex}"
    return f"{folder}/log", f"{folder}/checkpoint"


def stream_page_log(spark: SparkSession, base: str) -> DataFrame:
    """The puts of the page table through a stream, repeated deliveries once."""
    schema = read_table(spark, base, "pages").schema
    puts = logs.table_stream(spark, base, "pages", schema).select("id", "slug", "created_at")
    path, checkpoint = _places(spark)
    logs.append_stream(logs.deduplicated(puts, "id", "created_at", PUT_LATENESS), path, checkpoint).awaitTermination()
    return spark.read.parquet(path).select("id", "slug", F.unix_micros("created_at").alias("created_us"))


def stream_event_windows(spark: SparkSession, base: str) -> DataFrame:
    """Events per day and type, kept up to date by micro-batches; the last state of each window counts."""
    schema = read_table(spark, base, "events").schema
    events = logs.table_stream(spark, base, "events", schema).select("event_type", F.col("ts").cast("timestamp").alias("ts"))
    path, checkpoint = _places(spark)
    counts = logs.windowed_counts(events, "ts", "1 day", "event_type", EVENT_LATENESS)
    query = counts.writeStream.outputMode("update").foreachBatch(lambda batch, n: logs.replace_batch(batch, path, n)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    states = spark.read.schema("window_start timestamp, event_type string, n bigint, batch int").option("basePath", path).parquet(path)
    last = states.groupBy("window_start", "event_type").agg(F.max_by("n", "batch").alias("n"))
    return last.select(F.unix_micros("window_start").alias("window_us"), "event_type", "n")


QUERIES = {"stream_page_log": stream_page_log, "stream_event_windows": stream_event_windows}
SQL = {
    "stream_page_log": "SELECT DISTINCT id, slug, epoch_us(created_at) AS created_us FROM pages",
    "stream_event_windows": "SELECT epoch_us(date_trunc('day', ts)) AS window_us, event_type, count(*) AS n FROM events GROUP BY ALL",
}
