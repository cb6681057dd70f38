"""Restartable processing of folders: each file is handled once, whatever was done before."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def process_new_files(spark: SparkSession, source: str, schema: str, sink: str, checkpoint: str, transform: Callable[[DataFrame], DataFrame] | None = None, files_per_batch: int = 1000) -> None:
    """Runs `transform` over the Parquet files that came into `source` since the last call and appends the rows to `sink`.

    A structured stream with trigger availableNow: the checkpoint remembers the
    files that were read, and a batch is written under its number, so that one
    repeated after a failure replaces its own rows.
    """

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{sink}/batch={number}")

    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(source)
    rows = transform(stream) if transform else stream
    rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def newest_runs(detections: DataFrame, image: str = "image", run: str = "run") -> DataFrame:
    """The rows of each image's newest run, where detections were made more than once."""
    last = detections.groupBy(image).agg(F.max(run).alias("_last"))
    return detections.join(last, image).where(F.col(run) == F.col("_last")).drop("_last")


def windowed_counts(events: DataFrame, time: str, key: str, window: str, late: str) -> DataFrame:
    """Counts and sums of `value` by tumbling window and key, with a watermark; works on streams and tables alike."""
    return events.withWatermark(time, late).groupBy(F.window(time, window), key).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
