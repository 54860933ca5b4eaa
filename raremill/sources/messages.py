"""Keyed binary messages as streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

FILE_SCHEMA = "key string, value binary, id bigint, time bigint"


def topic_list(topics: str | list[str]) -> list[str]:
    """Topics of a comma list, each once."""
    names = topics.split(",") if isinstance(topics, str) else topics
    return list(dict.fromkeys(name.strip() for name in names if name.strip()))


def kafka_options(brokers: str, topics: str | list[str], max_per_trigger: int | None = None) -> dict:
    options = {
        "kafka.bootstrap.servers": brokers,
        "subscribe": ",".join(topic_list(topics)),
        "startingOffsets": "earliest",
        "failOnDataLoss": "false",
    }
    if max_per_trigger:
        options["maxOffsetsPerTrigger"] = str(max_per_trigger)
    return options


def kafka_messages(
    spark: SparkSession,
    brokers: str,
    topics: str | list[str],
    max_per_trigger: int | None = None,
) -> DataFrame:
    """A Kafka stream (key as text, value, topic, partition, offset, timestamp), from
    the earliest offset. Needs the Kafka connector on the class path."""
    reader = spark.readStream.format("kafka").options(**kafka_options(brokers, topics, max_per_trigger))
    return reader.load().selectExpr(
        "cast(key as string) as key", "value", "topic", "partition", "offset", "timestamp"
    )


def file_messages(
    spark: SparkSession, path: str, max_files: int | None = None
) -> DataFrame:
    """Messages published as Parquet, as a stream."""
    reader = spark.readStream.schema(FILE_SCHEMA)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.parquet(path)
