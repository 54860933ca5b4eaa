"""Publish a transaction table as keyed binary messages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from raremill.functions.codec import encode
from raremill.functions.hashing import keyed_uuid
from raremill.functions.times import now_millis
from raremill.operators.sampling import replicate
from raremill.schema import ID


def keyed_sends(
    df: DataFrame, cycles: int = 1, producers: int = 1, key: str = ID, seed: int = 1, row_key: str | None = None
) -> DataFrame:
    """Every row ``cycles * producers`` times, each send with its own ``uuid`` and
    ``cycle`` number. The uuid follows from row, cycle and seed: a retried task
    sends the same one, and the send log agrees with the messages. Use a new seed
    for each run. Where ids are missing or repeated, ``row_key`` names a column that tells rows
    apart, such as the number of ``sources.numbered``."""
    sends = replicate(df, cycles * producers, "cycle").withColumn("id", F.col(key))
    return sends.withColumn("uuid", keyed_uuid("send", seed, F.col(row_key or key), F.col("cycle")))


def messages(sends: DataFrame, with_seconds: bool = False, connector: bool = False) -> DataFrame:
    """(key, value, id, time): the uuid, the encoded row, its id and the send time."""
    return sends.select(
        F.col("uuid").alias("key"),
        encode(with_seconds, connector=connector).alias("value"),
        "id",
        now_millis().alias("time"),
    )


def send_log(sent: DataFrame) -> DataFrame:
    return sent.select(F.col("key").alias("uuid"), "id", "time")


def to_files(sent: DataFrame, path: str, mode: str = "append") -> None:
    sent.write.mode(mode).parquet(path)


def to_kafka(sent: DataFrame, brokers: str, topic: str) -> None:
    """Needs the Kafka connector on the class path."""
    sent.select("key", "value").write.format("kafka").option(
        "kafka.bootstrap.servers", brokers
    ).option("topic", topic).save()
