"""Streams of changes into a snapshot store, and running counts over them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from graphloom.sources.store import CHANGES, SnapshotStore


def read_changes(spark, path: str, max_files: int = 100) -> DataFrame:
    """A stream of change sets that arrive as Parquet files."""
    return spark.readStream.schema(CHANGES).option("maxFilesPerTrigger", max_files).parquet(path)


def fold_into(changes: DataFrame, store: SnapshotStore, checkpoint: str, now: str | None = None) -> StreamingQuery:
    """Fold each batch of a stream into the store as one snapshot.

    A batch that is run again after a failure sets the same payloads, so it
    changes only times; updates of rows that aren't there are left out, as a
    batch may have removed them in its first run.
    """

    def fold(batch: DataFrame, batch_id: int) -> None:
        stamp = now or str(batch.sparkSession.sql("select current_timestamp()").first()[0])
        store.apply(batch, stamp, missing="skip")

    return changes.writeStream.foreachBatch(fold).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, time_col: str, by: list[str], length: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Numbers of rows in each tumbling window, for rows at most `late` behind; the same for tables and streams."""
    seen = events.withWatermark(time_col, late) if events.isStreaming else events
    counted = seen.groupBy(F.window(time_col, length).alias("w"), *by).agg(F.count("*").alias("n"))
    return counted.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *by, "n")
