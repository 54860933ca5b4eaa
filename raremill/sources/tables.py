"""Parquet tables and the labelled transaction view built from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from raremill.functions.times import second_of_day
from raremill.schema import AMOUNT, COMPONENTS, ID, LABEL, SECONDS


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def stream_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The same as a stream. The stream source takes a single file only through a
    glob; this one matches a file or a directory of that name."""
    schema = table(spark, folder, name).schema
    return spark.readStream.schema(schema).parquet(f"{folder}/{{{name}}}.parquet")


def transactions(spark: SparkSession, folder: str, extra: tuple[str, ...] = ()) -> DataFrame:
    """Labelled transactions: an event joined to the vector its id selects.

    Errors above 150 are the rare class. ``extra`` keeps further event columns.
    """
    events = table(spark, folder, "events")
    vectors = table(spark, folder, "embeddings")
    n_vectors = vectors.select(F.count(F.lit(1))).scalar()
    keyed = events.select("event_id", "ts", "event_type", "value", *extra).withColumn(
        "vid", F.col("event_id") % n_vectors
    )
    joined = keyed.join(vectors.select("vec_id", "embedding"), keyed.vid == vectors.vec_id)
    shift = "if(event_type = 'error', 1.0D, 0.0D)"
    parts = [f"cast(embedding[{i}] as double)" for i in range(len(COMPONENTS))]
    parts[0] += f" + {shift}"
    return joined.select(
        F.col("event_id").alias(ID),
        second_of_day(F.col("ts")).alias(SECONDS),
        *[F.expr(f"{part} as {name}") for part, name in zip(parts, COMPONENTS, strict=True)],
        F.col("value").alias(AMOUNT),
        F.expr(f"cast(event_type = 'error' and value > 150 as int) as {LABEL}"),
        *[F.col(c) for c in dict.fromkeys(extra)],
    )
