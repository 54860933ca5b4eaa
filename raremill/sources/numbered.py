"""Rows of files with numbers of their own.

The number of a row follows from its place: files in the order of their paths, rows in the
order in which a file holds them. It depends neither on how Spark cuts files into tasks nor on
what the rows say, so that rows whose ids are missing, unreadable or repeated still have a
key for splits, folds, draws and messages. Counts per piece of a file and their running totals,
one short row per piece, give each piece its first number; the rows themselves are not shuffled
unless that list outgrows Spark's limit for broadcasts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from raremill.session import cut_lineage

NUMBER = "number"
_LINES = "file string, block long, place long, value string"


def with_starts(counts: DataFrame, order: list[str], size: str = "n", start: str = "start") -> DataFrame:
    """``counts`` with the total of ``size`` over all rows before each in ``order`` (unique). Ranges of
    the order are summed apart: no task sees all rows, only one total per range meets."""
    dealt = cut_lineage(counts.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()))
    so_far = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = dealt.groupBy("_range").agg(F.sum(size).alias("_total"))
    ranges = ranges.select("_range", F.coalesce(F.sum("_total").over(so_far), F.lit(0)).alias("_before"))
    earlier = Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    inside = F.coalesce(F.sum(size).over(earlier), F.lit(0))
    # one row per partition of a shuffle
    met = dealt.join(F.broadcast(ranges), "_range")
    return met.withColumn(start, F.col("_before") + inside).drop("_range", "_before")


def _placed(lines: DataFrame) -> DataFrame:
    """Lines with their place in their piece of a file. A task reads a piece from its first line
    to its last, so counting along it gives the same places whenever it runs."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, seen = None, 0
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            files = batch.column(0).dictionary_encode()
            codes, blocks = files.indices.to_numpy(), batch.column(1).to_numpy()
            new = np.r_[True, (codes[1:] != codes[:-1]) | (blocks[1:] != blocks[:-1])]
            at = np.arange(n)
            place = at - np.maximum.accumulate(np.where(new, at, 0))
            names = files.dictionary
            if last == (names[int(codes[0])].as_py(), int(blocks[0])):
                place[: int(np.argmax(new[1:])) + 1 if new[1:].any() else n] += seen
            last, seen = (names[int(codes[-1])].as_py(), int(blocks[-1])), int(place[-1]) + 1
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(place, pa.int64()), batch.column(2)],
                ["file", "block", "place", "value"],
            )

    return lines.select("file", "block", "value").mapInArrow(task, _LINES)


def numbered_lines(spark: SparkSession, path: str, header: bool = False) -> DataFrame:
    """(number, file, line, value) of every line, blank ones too; ``line`` counts from 0 in its file.
    With ``header`` the first line of each file is left out, and its number with it."""
    lines = spark.read.text(path).select(
        "value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block")
    )
    counts = lines.groupBy("file", "block").agg(F.count(F.lit(1)).alias("n"))
    starts = with_starts(counts, ["file", "block"])
    in_file = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = starts.withColumn("first", F.coalesce(F.sum("n").over(in_file), F.lit(0))).drop("n")
    found = _placed(lines).join(starts, ["file", "block"]).select(
        (F.col("start") + F.col("place")).alias(NUMBER), "file", (F.col("first") + F.col("place")).alias("line"), "value"
    )
    return found.where("line > 0") if header else found


def numbered_rows(df: DataFrame, name: str = NUMBER) -> DataFrame:
    """``df``, as read from Parquet files, with the number of each row."""
    placed = df.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_row"))
    counts = placed.groupBy("_file").agg(F.count(F.lit(1)).alias("n"))
    starts = with_starts(counts, ["_file"]).select("_file", "start")
    met = placed.join(starts, "_file")
    return met.select(*df.columns, (F.col("start") + F.col("_row")).alias(name))
