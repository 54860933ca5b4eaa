"""Metrics of a prediction stream while it runs.

The stream's state is a count per score bin, label and prediction: at most four rows per bin, however
long it runs. The counts are exact. The areas under the curves are not known from bins, but lie between two
bounds: whatever the order inside a bin, no point of the curve leaves the bin's corner points.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from raremill.operators.metrics import with_ratios
from raremill.sinks.files import write_table

KEYS = ["bin", "label", "predicted"]


def score_tallies(
    predictions: DataFrame,
    low: float,
    high: float,
    bins: int = 1024,
    score: str = "score",
    label: str = "label",
    predicted: str = "prediction",
) -> DataFrame:
    """(bin, label, predicted, n) of a table or a stream. Bins are equally wide from ``low`` to ``high``;
    scores beyond are in the outermost. Rows without a score (null, NaN), label or prediction do
    not count."""
    at = F.floor((F.col(score) - low) / (high - low) * bins)
    rows = predictions.where(F.col(score).isNotNull() & ~F.isnan(F.col(score).cast("double"))).select(
        F.least(F.greatest(at, F.lit(0)), F.lit(bins - 1)).cast("int").alias("bin"),
        F.col(label).cast("int").alias("label"),
        F.col(predicted).cast("int").alias("predicted"),
    )
    return rows.where("label in (0, 1) and predicted in (0, 1)").groupBy(*KEYS).agg(F.count(F.lit(1)).alias("n"))


def store_tallies(
    tallies: DataFrame, path: str, checkpoint: str, every: str = "10 seconds", available_now: bool = False
) -> StreamingQuery:
    """Store the counts that each micro-batch changed; a batch that is run again replaces its folder."""

    def store(batch: DataFrame, batch_id: int) -> None:
        write_table(batch, f"{path}/batch_id={batch_id}")

    writer = tallies.writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(store)
    trigger = {"availableNow": True} if available_now else {"processingTime": every}
    return writer.trigger(**trigger).start()


def latest_tallies(spark: SparkSession, path: str) -> DataFrame:
    stored = spark.read.schema("bin int, label int, predicted int, n long, batch_id long").parquet(path)
    return stored.groupBy(*KEYS).agg(F.max_by("n", "batch_id").alias("n"))


def running_report(tallies: DataFrame) -> DataFrame:
    """One row: exact counts and ratios, and bounds (``_low``, ``_high``) of the areas that
    ``metrics.curve_areas`` finds for the scores themselves; null without rows of both classes."""
    of = lambda actual, guess: F.coalesce(
        F.sum(F.when((F.col("label") == actual) & (F.col("predicted") == guess), F.col("n"))), F.lit(0)
    )
    counts = tallies.agg(of(0, 0).alias("tn"), of(0, 1).alias("fp"), of(1, 0).alias("fn"), of(1, 1).alias("tp"))
    sums = tallies.groupBy("bin").agg(
        *[F.coalesce(F.sum(F.when(F.col("label") == v, F.col("n"))), F.lit(0)).cast("double").alias(c)
          for v, c in ((1, "p"), (0, "q"))]
    )
    # one row per bin
    above = Window.orderBy(F.desc("bin")).rowsBetween(Window.unboundedPreceding, -1)
    curve = sums.select("p", "q", *[F.coalesce(F.sum(c).over(above), F.lit(0.0)).alias(f"{c}0") for c in ("p", "q")])
    p, q, p0, q0 = (F.col(c) for c in ("p", "q", "p0", "q0"))
    # a negative lies below the positives of the bins above it, and below those of its own bin or not
    roc_low, roc_high = F.sum(q * p0), F.sum(q * (p0 + p))
    # inside a bin precision is least after all of its negatives, and largest after all of its positives
    pr_low = F.sum(F.when(p0 > 0, p * p0 / (p0 + q0 + q)).otherwise(0.0))
    pr_high = F.sum(F.when(p > 0, p * (p0 + p) / (p0 + p + q0)).otherwise(0.0))
    area = F.sum("p") * F.sum("q")
    bounds = curve.agg(
        F.try_divide(roc_low, area).alias("areaUnderROC_low"),
        F.try_divide(roc_high, area).alias("areaUnderROC_high"),
        F.try_divide(pr_low, F.sum("p")).alias("areaUnderPR_low"),
        F.try_divide(pr_high, F.sum("p")).alias("areaUnderPR_high"),
    )
    row = bounds.select(F.struct(*bounds.columns)).scalar()
    ratios = with_ratios(counts)
    return ratios.withColumn("_bounds", row).select(*ratios.columns, "_bounds.*")
