"""Counts per fixed time window."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def throughput(
    df: DataFrame, time_col: str, seconds: int = 5, watermark: str | None = None
) -> DataFrame:
    """(window_start, n, tps, rate) per window that holds a row.

    ``tps`` is the whole number of rows per second, ``rate`` the exact one. Works
    on batches and streams; a stream needs a ``timestamp`` column and a watermark.
    """
    if watermark:
        df = df.withWatermark(time_col, watermark)
    window = F.window(time_col, f"{seconds} seconds")
    counted = df.groupBy(window.alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return counted.select(
        F.col("w.start").alias("window_start"),
        "n",
        F.floor(F.col("n") / seconds).cast("long").alias("tps"),
        (F.col("n") / F.lit(float(seconds))).alias("rate"),
    )
