"""Tables, logs and models on shared storage.

Outputs are directories of part files; nothing is merged into one file, which
would pass a whole table through one task. All readers here take directories.
"""

from __future__ import annotations

from pyspark.ml.util import MLWritable
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from raremill.sources import delimited


# the default format keeps milliseconds only
CSV_OPTIONS = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"}
# a compressed file is read by one task, so it has a limit
GZIP_OPTIONS = {"compression": "gzip", "zlib.compress.level": "BEST_SPEED", "maxRecordsPerFile": 250_000}


def write_table(
    df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite", header: bool = False, gzip: bool = False
) -> None:
    """``gzip`` is for text: half the bytes or less. All readers here tell by the files' names."""
    writer = df.write.mode(mode)
    if fmt == "csv":
        writer = writer.options(header=header, **CSV_OPTIONS)
    if gzip:
        writer = writer.options(**GZIP_OPTIONS)
    writer.format(fmt).save(path)


def write_judged(judged: DataFrame, path: str) -> dict[str, int]:
    """Store judged rows in one pass, kept and rejected ones in folders of their own, and return
    the counts of the stored rows: ``lines``, ``kept`` and each reason, from the column of reasons alone.

    An ``Observation`` would count on the way, but a session that has had one can no longer apply
    fitted models: Spark 4.1 then tries to send the session's observation manager along with them."""
    fate = F.when(F.col("reason").isNull(), "kept").otherwise("rejected")
    judged.withColumn("fate", fate).write.mode("overwrite").partitionBy("fate").parquet(path)
    stored = judged.sparkSession.read.schema("reason string, fate string").parquet(path)
    kept = F.count_if(F.col("fate") == "kept").alias("kept")
    reasons = [F.count_if(F.col("reason") == r).alias(r) for r in delimited.REASONS]
    return stored.agg(F.count(F.lit(1)).alias("lines"), kept, *reasons).first().asDict()


def read_judged(spark: SparkSession, path: str, schema: T.StructType) -> tuple[DataFrame, DataFrame]:
    """The kept rows of ``write_judged``, and the rejected lines with reason and column."""
    text = [T.StructField(n, T.StringType()) for n in ("reason", "column", "rejected", "fate")]
    loose = [T.StructField(f.name, f.dataType) for f in schema]
    stored = spark.read.schema(T.StructType([*text[:3], *loose, text[3]])).parquet(path)
    kept = stored.where("fate = 'kept'").select(*schema.names)
    return kept, stored.where("fate = 'rejected'").select("reason", "column", F.col("rejected").alias("line"))


def append_log(rows: DataFrame, path: str, fmt: str = "parquet", gzip: bool = False) -> None:
    """Append rows to a typed log, which is created if it does not exist."""
    write_table(rows, path, fmt, "append", gzip=gzip)


def append_row(spark: SparkSession, row: dict, schema: T.StructType, path: str) -> None:
    append_log(spark.createDataFrame([tuple(row[n] for n in schema.names)], schema), path)


def save_model(model: MLWritable, path: str) -> None:
    model.write().overwrite().save(path)


def copy_run_tables(
    spark: SparkSession, source: str, target: str, with_id: bool = True, fmt: str = "csv", with_seconds: bool = False,
    gzip: bool = False,
) -> None:
    """Copy a run's test partition (overwriting) and its two logs (appending), each
    to its own target, in the format they have. A sweep stores Parquet; text tables end in
    ``.csv``; their copies may be compressed."""
    end = ".csv" if fmt == "csv" else ""
    test = delimited.read_test_partition(spark, f"{source}/test_partition{end}", with_seconds, with_id, fmt)
    write_table(test, f"{target}/test_partition{end}", fmt, gzip=gzip)
    runs = delimited.read_run_log(spark, f"{source}/tuning_log{end}", fmt)
    append_log(runs, f"{target}/tuning_log{end}", fmt, gzip)
    submodels = delimited.read_submodel_log(spark, f"{source}/submodel_log{end}", fmt)
    if fmt == "csv":
        # the parameter list holds commas that must not be quoted
        line = F.concat_ws(",", *[F.coalesce(F.col(n).cast("string"), F.lit("")) for n in submodels.columns])
        submodels, fmt = submodels.select(line.alias("value")), "text"
    append_log(submodels, f"{target}/submodel_log{end}", fmt, gzip)
