"""Incremental runs with Structured Streaming: new files, change batches, review states."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def watch_folder(spark: SparkSession, root: str, pipeline: Callable[[DataFrame, int], None], checkpoint: str, every: str | None = None) -> StreamingQuery:
    """Runs the pipeline on each batch of new or changed files; without ``every`` it ends when all are done."""
    stream = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length bigint, content binary").option("recursiveFileLookup", "true").load(root)
    files = stream.select(F.col("path").alias("relpath"), "length", F.sha2("content", 256).alias("sha256"), "content")
    writer = files.writeStream.foreachBatch(pipeline).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def event_stream(spark: SparkSession, folder: str, schema, per_trigger: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(folder)


def debounced(events: DataFrame, gap: str = "30 minutes", late: str = "1 day", key: str = "user_id", ts: str = "ts") -> DataFrame:
    """Change batches per key: events closer than the gap fall into one session; later than the watermark they are dropped."""
    return events.withWatermark(ts, late).groupBy(key, F.session_window(ts, gap)).agg(F.count("*").alias("n")).select(key, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def deletions(before: DataFrame, now: DataFrame, key: str = "relpath") -> DataFrame:
    """What a file source can't see: paths that are gone since the last snapshot."""
    return before.join(now.select(key), key, "left_anti")


def to_table(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """An append-only, exactly-once Parquet sink of all there is."""
    return stream.writeStream.format("parquet").outputMode(mode).option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
