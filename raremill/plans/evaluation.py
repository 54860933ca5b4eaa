"""Metrics over stored predictions, appended to a log."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from raremill.operators.metrics import evaluation
from raremill.schema import METRIC_NAMES
from raremill.session import cut_lineage
from raremill.sinks.files import append_log
from raremill.sources.delimited import read_predictions


def evaluate_predictions(predictions: DataFrame) -> DataFrame:
    """One row of metrics in log order, and the false-positive rate."""
    row = evaluation(predictions, "predictedLabel", "label", "prediction")
    return row.select(*[F.col(n).cast("double").alias(n) for n in [*METRIC_NAMES, "fpr"]])


def evaluate_folder(
    spark: SparkSession, path: str, log: str | None = None, fmt: str = "csv"
) -> DataFrame:
    """Evaluate a folder of prediction files; with ``log`` append the row there.
    Files of another format than ``fmt`` raise."""
    row = evaluate_predictions(read_predictions(spark, path, fmt))
    if log:
        row = cut_lineage(row)
        append_log(row, log)
    return row
