"""Row shapes: label first, feature subsets, predictions and label indexes."""

from __future__ import annotations

from pyspark.ml.feature import IndexToString, StringIndexer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from raremill.functions.times import now_millis
from raremill.functions.vectors import feature_array
from raremill.schema import LABEL, PREDICTIONS, feature_cols


def label_first(df: DataFrame, with_seconds: bool = False, label: str = LABEL) -> DataFrame:
    return df.select(label, *feature_cols(with_seconds))


def keyed_vectors(
    df: DataFrame, features: list[str], label: str, key: str, first: int | None = None
) -> DataFrame:
    """(id, label, features): the first ``first`` features by name, keyed by the
    row's own id rather than by its place in a partition."""
    return df.select(
        F.col(key).alias("id"),
        F.col(label).cast("double").alias("label"),
        feature_array(features, first).alias("features"),
    )


def minority_vectors(
    df: DataFrame, features: list[str], label: str, key: str, first: int | None = None
) -> DataFrame:
    return keyed_vectors(df.where(F.col(label) == 1), features, label, key, first)


def label_indexer(column: str, output: str = "label") -> StringIndexer:
    """Alphabetical order, so that an index does not depend on class frequencies."""
    return StringIndexer(inputCol=column, outputCol=output, stringOrderType="alphabetAsc")


def label_names(labels: list[str], column: str = "prediction") -> IndexToString:
    return IndexToString(inputCol=column, outputCol="predictedLabel", labels=labels)


def stamped(df: DataFrame, incoming: Column | None = None) -> DataFrame:
    """Add the arrival time in milliseconds and the time of prediction. Both are
    constant within a batch; ``incoming`` takes the arrival from the source."""
    return df.withColumns(
        {
            "incoming_time": now_millis() if incoming is None else incoming,
            "prediction_time": F.current_timestamp(),
        }
    )


def predictions_only(df: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """The seven columns of a prediction row, with their types."""
    typed = [F.col(f.name).cast(f.dataType).alias(f.name) for f in PREDICTIONS]
    return df.select(*typed, *keep)
