"""Token ids in ORC files (operator 2).

Documents are range-partitioned and sorted by id, encoded in Arrow tasks and written as
ORC: integer run-length encoding for ids and offsets, row indexes every ``index_stride``
rows and a Bloom filter on the document id. Stripes are read in parallel; a lookup by id
prunes files, stripes and row groups by their metadata. A manifest beside the files holds
the first token offset of each shard, so that a reader gets global offsets by one small join.

Null or empty texts have only the end id. Rows with a null id come first. Rows that repeat
an id keep a row each, ordered by text. Extra columns are ignored. An empty table gives
empty files with the same schema.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from raremill.llm.bpe import Encoder
from raremill.llm.tasks import int_lists, map_rows

FILE_SCHEMA = "doc_id long, shard int, shard_start long, n_tokens int, ids array<int>"
MANIFEST_SCHEMA = "shard int, n_docs long, n_tokens long, min_doc_id long, max_doc_id long, base long"


def write_tokens(
    docs: DataFrame,
    path: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    vocabulary: str | None = None,
    end_id: int = 0,
    stripe_mb: int = 64,
    index_stride: int = 10_000,
) -> None:
    """Write ``path``/tokens and ``path``/manifest."""

    def make():
        from pyspark import TaskContext

        encoder, shard = Encoder(vocabulary), TaskContext.get().partitionId()
        start = 0

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            nonlocal start
            texts = [t or "" for t in batch.column(1).to_pylist()]
            flat, counts = encoder.encode(texts)
            flat = np.insert(flat, np.cumsum(counts), end_id)
            counts = counts + 1
            starts = start + np.cumsum(counts) - counts
            start += int(counts.sum())
            return pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(np.full(len(counts), shard, np.int32)),
                    pa.array(starts),
                    pa.array(counts, pa.int32()),
                    int_lists(flat, counts),
                ],
                ["doc_id", "shard", "shard_start", "n_tokens", "ids"],
            )

        return step

    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    ordered = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    (
        map_rows(ordered, make, FILE_SCHEMA, 1024)
        .write.option("compression", "zstd")
        .option("orc.bloom.filter.columns", "doc_id")
        .option("orc.bloom.filter.fpp", "0.01")
        .option("orc.create.index", "true")
        .option("orc.row.index.stride", str(index_stride))
        .option("orc.stripe.size", str(stripe_mb << 20))
        .orc(f"{path}/tokens")
    )
    # one row per file, so this window is as small as the list of files
    shards = _files(spark, path).groupBy("shard").agg(
        F.count(F.lit(1)).alias("n_docs"),
        F.sum("n_tokens").cast("long").alias("n_tokens"),
        F.min("doc_id").alias("min_doc_id"),
        F.max("doc_id").alias("max_doc_id"),
    )
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    base = F.coalesce(F.sum("n_tokens").over(before), F.lit(0)).cast("long")
    shards.withColumn("base", base).write.orc(f"{path}/manifest")


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(FILE_SCHEMA).orc(f"{path}/tokens")


def _with_start(spark: SparkSession, path: str, files: DataFrame) -> DataFrame:
    manifest = spark.read.schema(MANIFEST_SCHEMA).orc(f"{path}/manifest")
    bases = manifest.select(F.col("shard").alias("_shard"), "base")
    return files.join(bases, files["shard"] == bases["_shard"]).withColumn(
        "start", F.col("base") + F.col("shard_start")
    )


def read_tokens(spark: SparkSession, path: str, where: Column | None = None) -> DataFrame:
    """Documents with their ids and global offsets; ``where`` on doc_id reaches the ORC
    row indexes and Bloom filters."""
    files = _files(spark, path)
    found = _with_start(spark, path, files if where is None else files.where(where))
    return found.select("doc_id", "start", "n_tokens", "ids")


def read_digests(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens and the CRC-32 of the stored ids as little-endian 32-bit integers."""

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            lists = batch.column(3)
            offsets = lists.offsets.to_numpy()
            raw = memoryview(np.ascontiguousarray(lists.values.to_numpy(), "<u4")).cast("B")
            sums = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(offsets, offsets[1:])]
            sizes = np.diff(offsets).astype(np.int64)
            return pa.RecordBatch.from_arrays(
                [*(batch.column(k) for k in range(3)), pa.array(sizes), pa.array(sums, pa.int64())],
                ["doc_id", "shard", "shard_start", "n_tokens", "ids_crc32"],
            )

        return step

    files = _files(spark, path).select("doc_id", "shard", "shard_start", "ids")
    schema = "doc_id long, shard int, shard_start long, n_tokens long, ids_crc32 long"
    found = _with_start(spark, path, map_rows(files, make, schema))
    return found.select("doc_id", "start", "n_tokens", "ids_crc32")
