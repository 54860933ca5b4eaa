"""Throughput of a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from raremill.operators.throughput import throughput
from raremill.sinks.files import write_table


def throughput_stream(
    events: DataFrame,
    time_col: str,
    path: str,
    checkpoint: str,
    seconds: int = 5,
    lateness: str = "10 seconds",
    available_now: bool = False,
) -> StreamingQuery:
    """Store each window once it can no longer change. State is one count per open
    window; rows later than ``lateness`` are not counted."""
    writer = (
        throughput(events, time_col, seconds, watermark=lateness)
        .writeStream.outputMode("append")
        .format("parquet")
        .option("checkpointLocation", checkpoint)
        .option("path", path)
    )
    if available_now:
        return writer.trigger(availableNow=True).start()
    return writer.start()


def throughput_updates(
    events: DataFrame,
    time_col: str,
    path: str,
    checkpoint: str,
    seconds: int = 5,
    lateness: str = "10 seconds",
    available_now: bool = False,
) -> StreamingQuery:
    """Store each window whenever it changes, the last open one too: one folder per
    micro-batch, which a batch that is run again replaces. ``latest_windows`` reads them."""

    def store(batch: DataFrame, batch_id: int) -> None:
        write_table(batch, f"{path}/batch_id={batch_id}")

    counted = throughput(events, time_col, seconds, watermark=lateness)
    writer = counted.writeStream.outputMode("update").option("checkpointLocation", checkpoint)
    writer = writer.foreachBatch(store)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def latest_windows(spark: SparkSession, path: str) -> DataFrame:
    """The last state of each window that ``throughput_updates`` stored."""
    stored = spark.read.parquet(path)
    names = [n for n in stored.columns if n not in ("batch_id", "window_start")]
    last = F.max_by(F.struct(*names), F.col("batch_id").cast("long"))
    return stored.groupBy("window_start").agg(last.alias("s")).select("window_start", "s.*")


def throughput_with_late(
    events: DataFrame,
    time_col: str,
    path: str,
    checkpoint: str,
    seconds: int = 5,
    lateness: int = 10,
    every: str = "10 seconds",
    available_now: bool = False,
) -> StreamingQuery:
    """Count windows and keep the rows that come too late for theirs.

    A window is closed once a row ``lateness`` seconds past its end has been seen in an earlier micro-batch. Rows of
    closed windows go to the side table ``late`` as they are and are counted apart, so that a reader can
    have windows as they closed or as they are (``windows_with_late``). A batch that is run again replaces what it
    wrote: its counts, its late rows and its latest time, from which later batches take what is closed."""
    size = F.expr(f"interval {seconds} seconds")

    def store(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        marks = spark.read.schema("latest timestamp, batch_id long").parquet(f"{path}/marks") if batch_id else None
        latest = marks.where(F.col("batch_id") < batch_id).agg(F.max("latest")).first()[0] if batch_id else None
        start = F.window(F.col(time_col), f"{seconds} seconds")["start"]
        closed = F.lit(False)
        if latest is not None:
            closed = start + size <= F.lit(latest) - F.expr(f"interval {lateness} seconds")
        rows = batch.where(F.col(time_col).isNotNull()).withColumn("window_start", start).withColumn("_late", closed)
        rows = rows.persist()  # read three times
        try:
            counts = rows.groupBy("window_start").agg(
                F.count_if(~F.col("_late")).alias("on_time"), F.count_if("_late").alias("late")
            )
            write_table(counts, f"{path}/counts/batch_id={batch_id}")
            write_table(rows.where("_late").drop("_late"), f"{path}/late/batch_id={batch_id}")
            write_table(rows.agg(F.max(time_col).cast("timestamp").alias("latest")), f"{path}/marks/batch_id={batch_id}")
        finally:
            rows.unpersist()

    writer = events.writeStream.option("checkpointLocation", checkpoint).foreachBatch(store)
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=every)).start()


def windows_with_late(spark: SparkSession, path: str, seconds: int = 5, corrected: bool = True) -> DataFrame:
    """(window_start, n, tps, rate, late): all windows, with their late rows or, if not ``corrected``, as
    they were when they closed; ``late`` counts the rows that came afterwards."""
    schema = "window_start timestamp, on_time long, late long, batch_id long"
    stored = spark.read.schema(schema).parquet(f"{path}/counts")
    sums = stored.groupBy("window_start").agg(F.sum("on_time").alias("on_time"), F.sum("late").alias("late"))
    n = F.col("on_time") + F.col("late") if corrected else F.col("on_time")
    counted = sums.select("window_start", n.alias("n"), "late").where("n > 0")
    return counted.select(
        "window_start",
        "n",
        F.floor(F.col("n") / seconds).cast("long").alias("tps"),
        (F.col("n") / F.lit(float(seconds))).alias("rate"),
        "late",
    )


def late_rows(spark: SparkSession, path: str) -> DataFrame:
    """The rows that came after their window was closed, with the micro-batch that brought them."""
    return spark.read.parquet(f"{path}/late")
