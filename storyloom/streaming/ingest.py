"""Streaming ingestion: feed files that land in a folder become typed, partitioned rows, once each."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars
from ..operators import store
from ..sources import feeds


def _parsed(lines: DataFrame, feed: str) -> DataFrame:
    split = feeds.columns_of(lines)
    rows = feeds.parse_documents(split, ("file_ts", "line_no")) if feed == "documents" else feeds.parse_rows(split, feed, ("file_ts", "line_no"))
    return rows


def _stamped(files: DataFrame) -> DataFrame:
    lines = files.mapInArrow(feeds._unzipped, "path string, line_no long, line string")
    return lines.withColumn("file_ts", F.regexp_extract("path", r"(\d{14})\.", 1).try_cast("long"))


def start_ingest(spark: SparkSession, folder: str, feed: str, target: str, checkpoint: str):
    """Start a query that takes what is new in ``folder`` and ends (AvailableNow). Its checkpoint is the watermark: a file is taken once, also
    after a failure. Mentions and documents are written per file stamp with dynamic overwrite, so a replayed batch changes nothing;
    events are inserted if their id is not yet there (first write wins)."""
    files = spark.readStream.format("binaryFile").option("pathGlobFilter", f"*{feeds.FEEDS[feed]}").schema("path string, modificationTime timestamp, length long, content binary").load(folder)

    def write(batch: DataFrame, batch_id: int) -> None:
        rows = _parsed(_stamped(batch.select("path", "content")), feed)
        if feed == "events":
            table = store.Snapshots(spark, target)
            if table.exists():
                table.write(store.insert_ignore(table.read(), rows, "global_event_id", ["file_ts", "line_no"]))
            else:
                table.write(store.insert_ignore(rows.limit(0), rows, "global_event_id", ["file_ts", "line_no"]))
        else:
            rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("file_ts").parquet(target)

    return files.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, width: str = "1 hour", late: str = "36 hours") -> DataFrame:
    """(window_start, event_root_code, events) over event time (date_added), on a batch or a stream; rows later than ``late`` are dropped by a
    stream."""
    stamped = events.withColumn("at", scalars.stamp("date_added")).filter("at is not null")
    w = stamped.withWatermark("at", late) if events.isStreaming else stamped
    return w.groupBy(F.window("at", width).alias("w"), "event_root_code").agg(F.count("*").alias("events")).select(F.col("w.start").alias("window_start"), "event_root_code", "events")


def next_since(runs: DataFrame, default: int) -> int:
    """Where an incremental run begins: one after the watermark of the latest completed incremental run, else of the latest completed
    bootstrap, else ``default``. ``runs`` is the run log (type, status, watermark)."""
    done = runs.filter("status = 'completed' and watermark is not null").groupBy("type").agg(F.max("watermark").alias("w"))
    found = {r.type: r.w for r in done.collect()}
    for kind in ("incremental", "bootstrap"):
        if kind in found:
            return found[kind] + 1
    return default


def should_bootstrap(events: DataFrame, runs: DataFrame) -> bool:
    """Only if there is no event and no completed bootstrap."""
    return events.limit(1).count() == 0 and runs.filter("type = 'bootstrap' and status = 'completed'").limit(1).count() == 0
