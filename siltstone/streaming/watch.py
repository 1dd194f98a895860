"""Watching for changes as a stream: bursts of events, and work that follows each burst.

A burst is a session: events of one key that are less than ``gap`` apart
collapse to one row when nothing followed for that long. Event time and a
watermark decide, so that late events within ``late`` still count and state is
dropped afterwards. While work for a micro-batch runs, further events wait for
the next one; none is lost.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

#: Paths that are not watched: hidden ones and what tools write.
IGNORED = r"(?:^|/)(?:\.|node_modules/|dist/|build/)"


def file_stream(spark: SparkSession, folder: str, like: DataFrame, glob: str = "*.parquet", files_per_batch: int | None = None) -> DataFrame:
    """Files of a folder as a stream, with the columns of ``like``; files added later come in later batches."""
    reader = spark.readStream.schema(like.schema).option("pathGlobFilter", glob)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(folder)


def watched(changes: DataFrame, path: str = "path") -> DataFrame:
    """Changes of files that count."""
    return changes.where(F.col(path).isNotNull() & ~F.col(path).rlike(IGNORED))


def bursts(events: DataFrame, key: str, time: str = "ts", gap: str = "500 milliseconds", late: str = "0 seconds") -> DataFrame:
    """(key, start, end, events): one row per burst of a key; on a stream in append mode once it is over."""
    session = F.session_window(time, gap)
    found = events.where(F.col(time).isNotNull()).withWatermark(time, late).groupBy(key, session.alias("w")).agg(F.count("*").alias("events"))
    return found.select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "events")


def run_available(stream: DataFrame, checkpoint: str, sink: str) -> None:
    """Process what is there and stop; rows are appended to the Parquet folder ``sink``."""
    stream.writeStream.outputMode("append").trigger(availableNow=True).option("checkpointLocation", checkpoint).format("parquet").option("path", sink).start().awaitTermination()


def rebuild_on_change(stream: DataFrame, work: Callable[[DataFrame, int], None], checkpoint: str, interval: str = "500 milliseconds") -> StreamingQuery:
    """Call ``work(rows, batch number)`` for the changes of every micro-batch, at most one at a time; the caller stops the query."""
    return stream.writeStream.foreachBatch(work).trigger(processingTime=interval).option("checkpointLocation", checkpoint).start()
