"""Which offsets each batch of a stream has stored, and what is missing or there twice.

Offsets become ranges (topic, partition, batch, first, last), one row per unbroken run, so that the
ledger has a few rows per batch however many messages there are. Ranges of all batches are merged as
intervals: stretches that no batch covers are gaps, stretches of several batches overlaps.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from raremill.sinks.files import write_table

SOURCE = ["topic", "partition"]
#: Offsets whose runs are found together; runs over the edges are joined afterwards.
STRETCH = 1 << 20


def merge_intervals(df: DataFrame, keys: list[str], first: str = "first", last: str = "last") -> DataFrame:
    """(keys, first, last): the least number of intervals that cover the same whole numbers.
    Neighbouring and overlapping ones become one; those that end before they begin are left out."""
    order = Window.partitionBy(*keys).orderBy(first, last)
    so_far = F.max(last).over(order.rowsBetween(Window.unboundedPreceding, -1))
    new = (so_far.isNull() | (F.col(first) > so_far + 1)).cast("int")
    marked = df.where(F.col(first) <= F.col(last)).select(*keys, first, last, new.alias("_new"))
    numbered = marked.withColumn("_run", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(*keys, "_run").agg(F.min(first).alias(first), F.max(last).alias(last)).drop("_run")


def offset_ranges(messages: DataFrame, batch: str | Column = "batch") -> DataFrame:
    """(topic, partition, batch, first, last) of the offsets in a table of messages; repeated messages
    of one batch count once, those without an offset not at all."""
    batch = F.col(batch) if isinstance(batch, str) else batch
    rows = messages.where("offset is not null").select(*SOURCE, batch.alias("batch"), "offset")
    rows = rows.withColumn("_stretch", F.floor(F.col("offset") / STRETCH))
    keys = [*SOURCE, "batch", "_stretch"]
    order = Window.partitionBy(*keys).orderBy("offset")
    # equal along a run of neighbours; repeated offsets rank alike
    run = F.col("offset") - F.dense_rank().over(order)
    runs = rows.withColumn("_run", run).groupBy(*keys, "_run").agg(
        F.min("offset").alias("first"), F.max("offset").alias("last")
    )
    return merge_intervals(runs, [*SOURCE, "batch"])


def record_offsets(
    messages: DataFrame, path: str, checkpoint: str, every: str = "10 seconds", available_now: bool = False
) -> StreamingQuery:
    """Keep the ledger of a stream of messages: the ranges of each micro-batch in a folder of its own,
    which the batch replaces if it is run again."""

    def store(rows: DataFrame, batch_id: int) -> None:
        found = offset_ranges(rows, F.lit(batch_id).cast("long"))
        write_table(found.drop("batch"), f"{path}/batch={batch_id}")

    writer = messages.writeStream.option("checkpointLocation", checkpoint).foreachBatch(store)
    trigger = {"availableNow": True} if available_now else {"processingTime": every}
    return writer.trigger(**trigger).start()


def read_ledger(spark, path: str) -> DataFrame:
    schema = "topic string, partition int, first long, last long, batch long"
    return spark.read.schema(schema).parquet(path).select(*SOURCE, "batch", "first", "last")


def audit(ranges: DataFrame) -> DataFrame:
    """(topic, partition, kind, first, last, batches): every stretch that no batch (``gap``) or more than one
    (``overlap``) covers, with the batches that meet there: all that cover an overlap, those that end
    before a gap or begin after it. Offsets before the first and after the last are not judged."""
    steps = ranges.select(*SOURCE, F.col("first").alias("at"), F.lit(1).alias("step")).unionAll(
        ranges.select(*SOURCE, (F.col("last") + 1).alias("at"), F.lit(-1).alias("step"))
    )
    steps = steps.groupBy(*SOURCE, "at").agg(F.sum("step").alias("step"))
    order = Window.partitionBy(*SOURCE).orderBy("at")
    depth = F.sum("step").over(order.rowsBetween(Window.unboundedPreceding, 0))
    stretches = steps.select(*SOURCE, "at", depth.alias("depth"), (F.lead("at").over(order) - 1).alias("until"))
    kind = F.when(F.col("depth") == 0, "gap").otherwise("overlap")
    found = stretches.where("depth <> 1 and until is not null").select(
        *SOURCE, kind.alias("kind"), F.col("at").alias("first"), F.col("until").alias("last")
    )
    # a range that covers a point of an overlap covers all of it; a gap has a range on either side
    points = F.when(F.col("kind") == "gap", F.array(F.col("first") - 1, F.col("last") + 1)).otherwise(F.array("first"))
    asked = found.withColumn("_at", F.explode(points)).withColumn("_stretch", F.floor(F.col("_at") / STRETCH))
    seen = ranges.select(
        *SOURCE, "batch", F.col("first").alias("_first"), F.col("last").alias("_last"), _stretches("first", "last")
    )
    met = asked.join(seen, [*SOURCE, "_stretch"]).where("_at between _first and _last")
    return met.groupBy(*SOURCE, "kind", "first", "last").agg(F.array_sort(F.collect_set("batch")).alias("batches"))


def _stretches(first: str, last: str) -> Column:
    """One row for each stretch that a range touches, so that ranges are joined by key."""
    cut = F.sequence(F.floor(F.col(first) / STRETCH), F.floor(F.col(last) / STRETCH))
    return F.explode(cut).alias("_stretch")


def coverage(planned: DataFrame, stored: DataFrame) -> DataFrame:
    """(topic, partition, batch, first, last, held, lost): for each planned range of a batch, such as those of a
    send log, how many of its offsets are stored by whatever batch, and how many are lost."""
    whole = merge_intervals(stored, SOURCE).select(*SOURCE, F.col("first").alias("_first"), F.col("last").alias("_last"))
    here = F.col("_stretch") * STRETCH
    left = planned.select(*SOURCE, "batch", "first", "last", _stretches("first", "last"))
    right = whole.select("*", _stretches("_first", "_last"))
    met = left.join(right, [*SOURCE, "_stretch"], "left")
    low, high = F.greatest("first", "_first", here), F.least("last", "_last", here + STRETCH - 1)
    held = F.when(F.col("_first").isNotNull(), F.greatest(F.lit(0), high - low + 1)).otherwise(0)
    found = met.groupBy(*SOURCE, "batch", "first", "last").agg(F.sum(held).cast("long").alias("held"))
    return found.withColumn("lost", F.col("last") - F.col("first") + 1 - F.col("held"))
