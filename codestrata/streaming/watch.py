"""Streams: changed files, incremental indexing and telemetry, with Structured Streaming."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from codestrata import schemas
from codestrata.functions.text import content_hash

#: How long file events gather before they are handled.
DEBOUNCE = "300 milliseconds"


def watched(path: Column, output: str) -> Column:
    """Whether an event's path is outside the output folder and has no hidden part."""
    bare, own = F.regexp_replace(path, r"^[a-z0-9]+:/+", "/"), re.sub(r"^[a-z0-9]+:/+", "/", output).rstrip("/")
    return ~bare.startswith(own + "/") & (bare != own) & ~bare.rlike(r"(?:^|/)\.[^/]+")


def file_events(spark: SparkSession, root: str, output: str) -> DataFrame:
    """A stream of (path, content, mtime) of the source files that appear below a folder; content is null where it isn't UTF-8."""
    glob = "*.{" + ",".join(sorted(schemas.LANGUAGE_BY_EXTENSION)) + "}"
    read = spark.readStream.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", True)
    events = read.schema("path string, modificationTime timestamp, length bigint, content binary").load(root)
    return events.where(watched(F.col("path"), output)).select("path", F.when(F.expr("is_valid_utf8(content)"), F.decode("content", "UTF-8")).alias("content"), F.col("modificationTime").alias("mtime"))


def newest_of_batch(batch: DataFrame) -> DataFrame:
    """One row per path of a micro-batch: the newest."""
    order = Window.partitionBy("path").orderBy(F.desc("mtime"), F.desc(content_hash("content")))
    return batch.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def watch(events: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str, once: bool = False, debounce: str = DEBOUNCE) -> StreamingQuery:
    """Runs ``handle`` on each debounced batch of changed files; ``once`` handles what is there and ends.

    A batch that fails is tried again from the checkpoint when the query is started anew.
    """

    def batch(df: DataFrame, number: int) -> None:
        handle(newest_of_batch(df), number)

    writer = events.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=debounce)).start()


def telemetry_stream(spark: SparkSession, folder: str) -> DataFrame:
    return spark.readStream.schema(schemas.TELEMETRY).json(folder)


def session_totals(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """Running (session_id, tool_name, call_count, total_tokens_out) of a stream of telemetry."""
    grouped = events.withWatermark("timestamp", late).groupBy("session_id", "tool_name")
    return grouped.agg(F.count("*").alias("call_count"), F.sum("tokens_out").alias("total_tokens_out"))


def windowed_counts(events: DataFrame, time: str, key: str, length: str, late: str = "10 minutes") -> DataFrame:
    """(start, key, n): events in tumbling windows; state is dropped once the watermark has passed a window."""
    grouped = events.withWatermark(time, late).groupBy(F.window(time, length).alias("w"), key)
    return grouped.agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), key, "n")


def session_windows(events: DataFrame, time: str, key: str, gap: str, late: str = "10 minutes") -> DataFrame:
    """(start, end, key, n): events of a key with no pause of ``gap`` between them; state is dropped once the watermark has passed a session."""
    grouped = events.withWatermark(time, late).groupBy(F.session_window(time, gap).alias("w"), key)
    return grouped.agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), key, "n")


def collected(stream: DataFrame, checkpoint: str, keys: list[str]) -> DataFrame:
    """What a stream's available input comes to: the last row of each key, from a table in the shared folder.

    Each micro-batch appends its updated rows with its number, so the driver holds none of them and a batch that is repeated does no harm.
    """
    target = f"{checkpoint}/rows"

    def append(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{target}/batch={number}")

    stream.writeStream.foreachBatch(append).outputMode("update").option("checkpointLocation", f"{checkpoint}/state").trigger(availableNow=True).start().awaitTermination()
    columns = [c for c in stream.columns if c not in keys]
    rows = stream.sparkSession.read.option("basePath", target).schema(", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in stream.schema.fields) + ", batch bigint").parquet(target)
    last = F.max_by(F.struct(*columns), "batch").alias("_last")
    return rows.groupBy(*keys).agg(last).select(*keys, *(F.col(f"_last.{c}").alias(c) for c in columns))
