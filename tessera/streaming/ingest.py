"""Structured Streaming: changed files into the index, and windowed counts with late data."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tessera.operators.incremental import last_writer, upsert


def windowed_counts(events: DataFrame, late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Events per window and type. On a stream, rows later than ``late`` behind the newest are dropped by the watermark."""
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    counted = rows.groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return counted.select(F.col("window.start").alias("window_start"), "event_type", "n", "total")


def stream_windowed_counts(events: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Keep the windowed counts of a stream as a table: every micro-batch that changes them writes all of them anew."""

    def write(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(out)

    counts = windowed_counts(events)
    return counts.writeStream.outputMode("complete").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def ingest_files(stream: DataFrame, index_path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Keep a table of the latest row per path up to date from a stream of file rows (``path, indexed_at, id`` and more).

    Each micro-batch writes a new version of the table beside the old one and then names it, so a batch that is run
    again after a failure gives the same result and readers never see half a version.
    """

    def write(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        latest = last_writer(batch.where("path is not null"), "path", F.struct(F.col("indexed_at"), F.col("id")).desc())
        current = current_index(spark, index_path, before=epoch)
        merged = upsert(current, latest, ["path"]) if current is not None else latest
        merged.write.mode("overwrite").parquet(f"{index_path}/version={epoch:010d}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def current_index(spark, index_path: str, before: int | None = None) -> DataFrame | None:
    """The newest complete version of the table (older than ``before``), or nothing."""
    jvm = spark._jvm
    root = jvm.org.apache.hadoop.fs.Path(index_path)
    fs = root.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    if not fs.exists(root):
        return None
    done = [int(s.getPath().getName().split("=")[1]) for s in fs.listStatus(root) if fs.exists(jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS"))]
    done = [v for v in done if before is None or v < before]
    return spark.read.parquet(f"{index_path}/version={max(done):010d}") if done else None
