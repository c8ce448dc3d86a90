"""Events an hour, each counted once however often it was delivered."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from changelens.sources.sinks import BatchOutput

COUNTS = "repo STRING, event STRING, hour TIMESTAMP, n_events LONG"


def event_counts(deliveries: DataFrame, delay: str = "2 hours") -> DataFrame:
    """``(repo, event, hour, n_events)`` of a stream ``(event_id, ts, repo, event)`` with repeated and late deliveries.

    An hour is counted once it is over by ``delay`` against the latest event seen, and is final then. Deliveries that
    are later than that are dropped. An id is remembered for ``delay`` past its time, which is as long as a
    repetition of it can still be in time, so state does not grow with the stream.
    """
    once = deliveries.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["event_id"])
    counted = once.groupBy("repo", "event", F.window("ts", "1 hour").alias("_hour")).agg(F.count("*").alias("n_events"))
    return counted.select("repo", "event", F.col("_hour.start").alias("hour"), "n_events")


def start_counts(deliveries: DataFrame, output: BatchOutput, checkpoint: str, delay: str = "2 hours", **trigger) -> StreamingQuery:
    """Publish the hours that each micro-batch closes."""
    writer = event_counts(deliveries, delay).writeStream.outputMode("append").foreachBatch(output.publish)
    return writer.option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
