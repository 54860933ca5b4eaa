"""Confusion counts, ratios and exact areas under the ROC and PR curves."""

from __future__ import annotations

import math

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from raremill.session import cut_lineage

_ROWS_PER_BUCKET = 1 << 20
_MAX_BUCKETS = 4096


def _cells(label: Column, predicted: Column, weight: Column | None = None) -> dict[str, Column]:
    pairs = {"tn": (0, 0), "fp": (0, 1), "fn": (1, 0), "tp": (1, 1)}
    cells = {}
    for name, (actual, guess) in pairs.items():
        hit = (label == actual) & (predicted == guess)
        if weight is None:
            count = F.count_if(hit)
        else:
            count = F.coalesce(F.sum(F.when(hit, weight)), F.lit(0))
        cells[name] = count.alias(name)
    return cells


def confusion(df: DataFrame, predicted: str = "prediction", label: str = "label") -> DataFrame:
    """One row tn, fp, fn, tp in one pass; a class that does not occur counts zero."""
    return df.agg(*_cells(F.col(label), F.col(predicted)).values())


def confusion_by(
    df: DataFrame, by: list[str], predicted: str = "prediction", label: str = "label"
) -> DataFrame:
    """The same per group, reduced map-side."""
    return df.groupBy(*by).agg(*_cells(F.col(label), F.col(predicted)).values())


def confusion_of_each(
    df: DataFrame, predictions: dict[float, Column], name: str, label: str = "label"
) -> DataFrame:
    """Counts of several predictions over the same rows in one pass: a row
    (ordinal, name, tn, fp, fn, tp) for each."""
    rows = [
        F.struct(
            F.lit(i).alias("ordinal"),
            F.lit(value).alias(name),
            *_cells(F.col(label), predicted).values(),
        )
        for i, (value, predicted) in enumerate(predictions.items())
    ]
    return df.agg(F.array(*rows).alias("rows")).select(F.inline("rows"))


def with_ratios(counts: DataFrame) -> DataFrame:
    """Add accuracy, precision, sensitivity, true specificity and the false-positive
    rate to confusion counts; null where the denominator is zero."""
    tn, fp, fn, tp = (F.col(c).cast("double") for c in ("tn", "fp", "fn", "tp"))
    return counts.select(
        *counts.columns,
        F.try_divide(tp + tn, tp + tn + fp + fn).alias("accuracy"),
        F.try_divide(tp, tp + fp).alias("precision"),
        F.try_divide(tp, tp + fn).alias("sensitivity"),
        F.try_divide(tn, tn + fp).alias("specificity"),
        F.try_divide(fp, fp + tn).alias("fpr"),
    )


def curve_areas(df: DataFrame, score: str = "prediction", label: str = "label") -> DataFrame:
    """One row (areaUnderROC, areaUnderPR), exact, with tied scores as one point.

    ``df`` is read once and reduced to a row per distinct score before anything is
    ordered, so a score shared by a third of all rows costs one row. The running
    totals are taken within score ranges of bounded size and started from the
    totals of the ranges above; those are at most 4096 rows.
    """
    tallies = df.groupBy(
        F.col(score).cast("double").alias("score"), F.col(label).cast("double").alias("label")
    ).agg(F.count(F.lit(1)).alias("n"))
    return _areas(_ranged(cut_lineage(_points(tallies))))


def _points(tallies: DataFrame) -> DataFrame:
    """(score, pos, neg) of the rows that have a score and a label."""
    valid = tallies.where(F.col("score").isNotNull() & F.col("label").isin(0, 1))
    return valid.groupBy("score").agg(
        *[
            F.coalesce(F.sum(F.when(F.col("label") == value, F.col("n"))), F.lit(0)).alias(name)
            for name, value in (("pos", 1), ("neg", 0))
        ]
    )


def _ranged(points: DataFrame) -> DataFrame:
    """Add ``bucket``, increasing with the score, by quantiles of the scores."""
    buckets = min(_MAX_BUCKETS, math.ceil(points.count() / _ROWS_PER_BUCKET))
    if buckets <= 1:
        return points.withColumn("bucket", F.lit(0))
    shares = [i / buckets for i in range(1, buckets)]
    edges = sorted(set(points.approxQuantile("score", shares, 0.2 / buckets)))
    splits = [-float("inf"), *[e for e in edges if abs(e) < float("inf")], float("inf")]
    # NaN sorts above every number, and "keep" gives it the bucket above all others
    ranger = Bucketizer(splits=splits, inputCol="score", outputCol="bucket", handleInvalid="keep")
    return ranger.transform(points)


def _areas(points: DataFrame) -> DataFrame:
    totals = points.groupBy("bucket").agg(
        F.sum("pos").alias("bucket_pos"), F.sum("neg").alias("bucket_neg")
    )
    # at most one row per bucket: a window over all of them is small
    falling = Window.orderBy(F.desc("bucket"))
    above = falling.rowsBetween(Window.unboundedPreceding, -1)
    whole = falling.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    starts = totals.select(
        "bucket",
        F.coalesce(F.sum("bucket_pos").over(above), F.lit(0)).alias("pos_above"),
        F.coalesce(F.sum("bucket_neg").over(above), F.lit(0)).alias("neg_above"),
        F.sum("bucket_pos").over(whole).cast("double").alias("all_pos"),
        F.sum("bucket_neg").over(whole).cast("double").alias("all_neg"),
    )
    order = Window.partitionBy("bucket").orderBy(F.desc("score"))
    so_far = order.rowsBetween(Window.unboundedPreceding, 0)
    curve = points.join(F.broadcast(starts), "bucket").select(
        *["pos", "neg", "all_pos", "all_neg"],
        (F.col("pos_above") + F.sum("pos").over(so_far)).cast("double").alias("tp"),
        (F.col("neg_above") + F.sum("neg").over(so_far)).cast("double").alias("fp"),
    )
    tp, fp, pos, neg = (F.col(c) for c in ("tp", "fp", "pos", "neg"))
    before_tp, before_fp = tp - pos, fp - neg
    precision = tp / (tp + fp)
    # the curve's first point repeats its own precision
    before = F.coalesce(F.try_divide(before_tp, before_tp + before_fp), precision)
    roc = F.sum(neg * (tp + before_tp) / 2)
    pr = F.sum(pos * (precision + before) / 2)
    return curve.agg(
        F.try_divide(roc, F.max("all_pos") * F.max("all_neg")).alias("areaUnderROC"),
        F.try_divide(pr, F.max("all_pos")).alias("areaUnderPR"),
    )


def evaluation(
    df: DataFrame,
    predicted: str = "prediction",
    label: str = "label",
    score: str | None = None,
) -> DataFrame:
    """Counts, ratios and areas of a prediction table as one row.

    The curve score defaults to the hard prediction. ``df`` is read once and
    reduced to a row per distinct (prediction, label, score).
    """
    tallies = cut_lineage(
        df.groupBy(
            F.col(predicted).alias("predicted"),
            F.col(label).cast("double").alias("label"),
            F.col(score or predicted).cast("double").alias("score"),
        ).agg(F.count(F.lit(1)).alias("n"))
    )
    ratios = with_ratios(
        tallies.agg(*_cells(F.col("label"), F.col("predicted"), F.col("n")).values())
    )
    areas = _areas(_ranged(_points(tallies)))
    row = areas.select(F.struct(*areas.columns)).scalar()
    return ratios.withColumn("_areas", row).select(*ratios.columns, "_areas.*")


def best_of(df: DataFrame, metric: str, order: str) -> DataFrame:
    """The row with the largest metric; among equals the first by ``order``."""
    best = F.max_by(F.struct(*df.columns), F.struct(F.col(metric), -F.col(order)))
    return df.agg(best.alias("best")).select("best.*")
