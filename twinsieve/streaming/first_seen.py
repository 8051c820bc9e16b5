"""Streams of digests: keep the first arrival of each, save progress as it comes."""

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

# Fixed value: how often progress is saved.
SAVE_EVERY = "300 seconds"


def first_seen(stream: DataFrame, *, event_time: str | None = None, within: str | None = None):
    """Drop all arrivals of a digest but the first.

    Exact over the whole stream, with state for every distinct digest. Given
    `event_time` and `within`, state older than that is let go: a repeat later than
    `within` after the first may pass.
    """
    known = stream.filter(stream.md5.isNotNull())
    if within is None:
        return known.dropDuplicates(["md5"])
    return known.withWatermark(event_time, within).dropDuplicatesWithinWatermark(["md5"])


def save_stream(
    stream: DataFrame, out: str, checkpoint: str, *, every: str | None = SAVE_EVERY
) -> StreamingQuery:
    """Append `stream` to a Parquet table, one commit per trigger.

    After a failure the query picks up at the last commit, so at most one interval
    of digests is computed again. `every=None` takes what is there and stops.
    """
    writer = (
        stream.writeStream.format("parquet")
        .option("path", out)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
    )
    trigger = {"availableNow": True} if every is None else {"processingTime": every}
    return writer.trigger(**trigger).start()
