"""Change streams (I1, I2, I11): bursts of file events become change sets, and each change set an analysis."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.incremental import change_set

EVENTS = "uri string, deleted boolean, seq long, ts timestamp"


def bursts(events: DataFrame, gap: str = "150 milliseconds", late: str = "1 minute") -> DataFrame:
    """Event-time debounce: (burst, uri, deleted) with the last event of each uri in a burst of events; for streams in
    append mode a burst is given once the watermark has passed it."""
    return events.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("burst"), "uri").agg(F.max_by("deleted", "seq").alias("deleted"))


def on_changes(events: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str, trigger: str = "150 milliseconds") -> StreamingQuery:
    """Calls ``handle`` with the change set (uri, deleted) of every micro-batch; the trigger interval debounces."""

    def batch(df: DataFrame, number: int) -> None:
        changes = change_set(df, "uri", ["seq"], "deleted")
        if not changes.isEmpty():
            handle(changes.orderBy("uri"), number)

    return events.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(processingTime=trigger).start()
