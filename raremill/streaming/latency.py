"""How long a message takes from its send to its prediction.

Sends and predictions meet by uuid within a bounded time, as tables or as streams. Both streams carry
a watermark, so that state is dropped once no partner can come any more; what has found none
by then is reported, and so are messages without a send.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

MATCHED, UNPREDICTED, UNSENT = "matched", "unpredicted", "unsent"


def send_latency(
    sends: DataFrame,
    predictions: DataFrame,
    within: str = "10 minutes",
    lateness: str = "1 minute",
    sent_col: str = "sent_at",
    predicted_col: str = "predicted_at",
) -> DataFrame:
    """(uuid, sent_at, predicted_at, latency_ms, status) of every send and every prediction.

    ``matched`` pairs lie at most ``within`` apart, the prediction not before its send; each send of a
    repeated uuid meets each of its predictions. A send without any is ``unpredicted``, a prediction
    without any ``unsent``. A null uuid or a null time meets nothing. On streams, rows without a
    partner come out once both watermarks have passed them, and rows more than ``lateness`` behind
    are dropped (``dropped_late`` counts them).
    """
    left = sends.select(F.col("uuid").alias("sent_uuid"), F.col(sent_col).cast("timestamp").alias("sent_at"))
    right = predictions.select(
        F.col("uuid").alias("predicted_uuid"), F.col(predicted_col).cast("timestamp").alias("predicted_at")
    )
    if left.isStreaming:
        left, right = left.withWatermark("sent_at", lateness), right.withWatermark("predicted_at", lateness)
    near = F.expr(
        f"sent_uuid = predicted_uuid and predicted_at >= sent_at and predicted_at <= sent_at + interval {within}"
    )
    met = left.join(right, near, "full_outer")
    status = (
        F.when(F.col("sent_at").isNotNull() & F.col("predicted_at").isNotNull(), MATCHED)
        .when(F.col("predicted_uuid").isNull() & F.col("predicted_at").isNull(), UNPREDICTED).otherwise(UNSENT)
    )
    return met.select(
        F.coalesce("sent_uuid", "predicted_uuid").alias("uuid"),
        "sent_at",
        "predicted_at",
        ((F.unix_micros("predicted_at") - F.unix_micros("sent_at")) / 1000).cast("long").alias("latency_ms"),
        status.alias("status"),
    )


def store_latency(
    rows: DataFrame, path: str, checkpoint: str, every: str = "10 seconds", available_now: bool = False
) -> StreamingQuery:
    """Append the rows of a streamed ``send_latency`` to Parquet, each once."""
    writer = rows.writeStream.format("parquet").outputMode("append")
    writer = writer.option("path", path).option("checkpointLocation", checkpoint)
    trigger = {"availableNow": True} if available_now else {"processingTime": every}
    return writer.trigger(**trigger).start()


def latency_report(rows: DataFrame, seconds: int = 3600) -> DataFrame:
    """Per window of the send (of the prediction, where there is no send): rows of each status, and
    least, mean and largest latency of the matched."""
    at = F.window(F.coalesce("sent_at", "predicted_at"), f"{seconds} seconds")
    is_ = lambda status: F.count_if(F.col("status") == status)
    return rows.groupBy(at.alias("w")).agg(
        is_(MATCHED).alias(MATCHED),
        is_(UNPREDICTED).alias(UNPREDICTED),
        is_(UNSENT).alias(UNSENT),
        F.min("latency_ms").alias("least_ms"),
        (F.sum("latency_ms") / F.count("latency_ms")).alias("mean_ms"),
        F.max("latency_ms").alias("largest_ms"),
    ).select(F.col("w.start").alias("window_start"), MATCHED, UNPREDICTED, UNSENT, "least_ms", "mean_ms", "largest_ms")


def dropped_late(query: StreamingQuery) -> int:
    """Rows that came behind the watermark, by the progress that the query still remembers."""
    return sum(
        operator["numRowsDroppedByWatermark"]
        for progress in query.recentProgress
        for operator in progress["stateOperators"]
    )
