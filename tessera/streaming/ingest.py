"""Accumulating ingest of test cases as a stream: an optional wrapper around the batch merge."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery


def accumulate(cases: DataFrame, target: str, checkpoint: str, key: str = "id") -> StreamingQuery:
    """Appends the cases of a stream whose id was not seen before, and stops when the source is read.

    Ids seen so far are the stream's state; the checkpoint makes a restart go on where it was."""
    return cases.dropDuplicates([key]).writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, time: str, kind: str, length: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Events of each kind in each window; a watermark bounds the state."""
    from pyspark.sql import functions as F

    return events.withWatermark(time, late).groupBy(F.window(time, length), kind).agg(F.count(F.lit(1)).alias("n"))
