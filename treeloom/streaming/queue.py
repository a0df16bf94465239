"""A file queue as a stream: rows that arrive are processed once, in batches.

The checkpoint records what is done, so a restart goes on where the last run
stopped. Keys already written within the watermark are dropped.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def read_queue(spark: SparkSession, path: str, schema: StructType, files_a_batch: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_batch).parquet(path)


def drain(stream: DataFrame, work: Callable[[DataFrame], DataFrame], out: str, checkpoint: str, key: str | None = None, time: str | None = None, delay: str = "1 hour") -> None:
    """Apply ``work`` to all that waits in the queue and append the results as Parquet, then stop."""
    if key and time:
        stream = stream.withWatermark(time, delay).dropDuplicatesWithinWatermark([key])
    work(stream).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def windowed_counts(stream: DataFrame, time: str, by: str, width: str = "1 day", delay: str | None = None) -> DataFrame:
    """Rows of each window and value of ``by``, in whatever order they come; the state holds a row for each of these.

    With ``delay``, windows leave the state that long after the latest time
    seen, and rows that come later than that are lost: for queues without end.
    """
    timed = stream if delay is None else stream.withWatermark(time, delay)
    return timed.groupBy(F.window(time, width).alias("w"), by).agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), by, "n", "total")


def collect_windows(counts: DataFrame, out: str, checkpoint: str) -> None:
    """Write all windows that change in a batch as Parquet, with the batch's number; the last one of a window holds. A batch that is run again replaces its own rows."""

    def write(rows: DataFrame, number: int) -> None:
        rows.write.mode("overwrite").parquet(f"{out}/batch={number}")

    counts.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
