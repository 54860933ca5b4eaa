"""Decode keyed messages, score them with a saved model and store predictions."""

from __future__ import annotations

from pyspark.ml import Model
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.tuning import CrossValidatorModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from raremill.functions.codec import decode
from raremill.operators.projection import predictions_only, stamped
from raremill.schema import feature_cols
from raremill.sinks.files import CSV_OPTIONS, write_table


def load_model(path: str) -> CrossValidatorModel:
    return CrossValidatorModel.load(path)


def decode_messages(
    messages: DataFrame,
    with_seconds: bool = False,
    uuid_from_key: bool = False,
    keep: tuple[str, ...] = (),
    permissive: bool = False,
    connector: bool = False,
) -> DataFrame:
    """Transactions of a message table or stream.

    ``uuid_from_key`` takes the uuid from the message key instead of the record.
    ``keep`` passes source columns through, such as topic, partition and offset.
    """
    row = decode(F.col("value"), with_seconds, permissive=permissive, connector=connector)
    source = [F.col(c) for c in dict.fromkeys([*keep, *(["key"] if uuid_from_key else [])])]
    rows = messages.select(*source, row.alias("rows"))
    if permissive:
        rows = rows.where(F.col("rows").isNotNull())
    rows = rows.select(*source, "rows.*")
    if uuid_from_key:
        rows = rows.withColumn("uuid", F.col("key"))
        rows = rows if "key" in keep else rows.drop("key")
    return rows


def sent_once(messages: DataFrame, within: str = "10 minutes", key: str = "key", time_col: str = "time") -> DataFrame:
    """Each message once, however often it is sent within ``within``: the first of equal keys to come.
    ``time_col`` is a time stamp or milliseconds. Messages without a key are told apart by their bytes.
    A stream keeps a key until the watermark has passed it; later repeats are messages of their own."""
    at = F.col(time_col)
    if dict(messages.dtypes)[time_col] == "bigint":
        at = F.timestamp_millis(at)
    own = F.coalesce(F.col(key), F.concat(F.lit("bytes:"), F.sha2("value", 256)))
    marked = messages.withColumns({"_own": own, "_at": at})
    if not messages.isStreaming:
        # the first of a table, not any
        first = F.min_by(F.struct(*[F.col(c) for c in messages.columns]), "_at").alias("m")
        return marked.groupBy("_own").agg(first).select("m.*")
    return marked.withWatermark("_at", within).dropDuplicatesWithinWatermark(["_own"]).drop("_own", "_at")


def score(
    transactions: DataFrame,
    model: Model,
    with_seconds: bool = False,
    incoming: Column | None = None,
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """The seven prediction columns for a table or a stream, and those in ``keep``."""
    assembler = VectorAssembler(inputCols=feature_cols(with_seconds), outputCol="features")
    scored = stamped(model.transform(assembler.transform(transactions)), incoming)
    return predictions_only(scored, keep)


def score_stream(
    transactions: DataFrame,
    model: Model,
    path: str,
    checkpoint: str,
    with_seconds: bool = False,
    fmt: str = "csv",
    every: str = "0 seconds",
    available_now: bool = False,
) -> StreamingQuery:
    """Append predictions through the file sink, each row once. Runs as fast as it
    can by default, or over what is available and then stops."""
    writer = (
        score(transactions, model, with_seconds)
        .writeStream.format(fmt)
        .options(**(CSV_OPTIONS if fmt == "csv" else {}))
        .option("checkpointLocation", checkpoint)
        .option("path", path)
    )
    return _start(writer, every, available_now)


def score_batches(
    transactions: DataFrame,
    model: Model,
    path: str,
    checkpoint: str,
    with_seconds: bool = False,
    fmt: str = "csv",
    every: str = "1 second",
    available_now: bool = False,
) -> StreamingQuery:
    """Score at a fixed interval, one folder per micro-batch. A batch that is run
    again after a failure replaces its folder, so no row is stored twice."""

    def store(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()  # asked for a row and scored, decoded once
        try:
            if not batch.isEmpty():
                write_table(score(batch, model, with_seconds), f"{path}/batch_id={batch_id}", fmt)
        finally:
            batch.unpersist()

    writer = transactions.writeStream.option("checkpointLocation", checkpoint).foreachBatch(store)
    return _start(writer, every, available_now)


def batch_interval(quantity: int, unit: str = "s") -> str:
    """An interval of ``quantity`` milliseconds (``ms``) or seconds."""
    return f"{quantity if unit == 'ms' else quantity * 1000} milliseconds"


def _start(writer, every: str, available_now: bool) -> StreamingQuery:
    trigger = {"availableNow": True} if available_now else {"processingTime": every}
    return writer.trigger(**trigger).start()
