import pytest
from pyspark.ml.evaluation import BinaryClassificationEvaluator, MulticlassClassificationEvaluator
from pyspark.sql import functions as F

from raremill.operators import metrics
from raremill.operators.throughput import throughput


def frame(spark, pairs):
    return spark.createDataFrame(pairs, "label double, prediction double")


def graded(spark, n, levels):
    return spark.range(n).select(
        (F.abs(F.hash("id")) % 10 < 3).cast("double").alias("label"),
        (F.abs(F.hash(F.col("id") + 7)) % levels).cast("double").alias("score"),
        (F.abs(F.hash(F.col("id") + 7)) % levels > levels // 2).cast("double").alias("prediction"),
    )


def spark_area(df, metric, score):
    return BinaryClassificationEvaluator(rawPredictionCol=score, metricName=metric, numBins=0).evaluate(df)


@pytest.mark.parametrize("levels", [2, 10, 100000])
@pytest.mark.parametrize("rows_per_bucket", [1 << 20, 40, 1])
def test_areas_equal_the_library_evaluators(spark, monkeypatch, levels, rows_per_bucket):
    monkeypatch.setattr(metrics, "_ROWS_PER_BUCKET", rows_per_bucket)
    df = graded(spark, 1000, levels)
    row = metrics.curve_areas(df, "score").first()
    for name in ("areaUnderROC", "areaUnderPR"):
        assert row[name] == pytest.approx(spark_area(df, name, "score"), abs=1e-12)


def test_areas_leave_out_rows_without_label_or_score(spark):
    df = graded(spark, 200, 10)
    extra = spark.createDataFrame([(None, 1.0, 1.0), (1.0, None, 0.0)], df.schema)
    assert metrics.curve_areas(df.unionByName(extra), "score").first() == metrics.curve_areas(df, "score").first()


def test_nan_is_the_highest_score(spark, monkeypatch):
    rows = [(1.0, float("nan")), (0.0, float("inf")), (1.0, 1.0), (0.0, 0.5), (1.0, -float("inf"))] * 5
    df = spark.createDataFrame(rows, "label double, score double")
    whole = metrics.curve_areas(df, "score").first()
    monkeypatch.setattr(metrics, "_ROWS_PER_BUCKET", 1)
    assert tuple(metrics.curve_areas(df, "score").first()) == pytest.approx(tuple(whole))


@pytest.mark.parametrize("pairs", [[(1.0, 1.0)] * 3, [(0.0, 0.0)] * 3, []])
def test_one_class_or_none(spark, pairs):
    row = metrics.evaluation(frame(spark, pairs)).first().asDict()
    n = len(pairs)
    positive = bool(pairs) and pairs[0][0] == 1.0
    assert (row["tp"], row["tn"], row["fp"], row["fn"]) == ((n, 0, 0, 0) if positive else (0, n, 0, 0))
    assert row["areaUnderROC"] is None
    assert row["fpr"] is None if positive or not pairs else row["fpr"] == 0.0


def test_counts_and_ratios(spark):
    df = frame(spark, [(0.0, 0.0)] * 5 + [(0.0, 1.0)] * 2 + [(1.0, 0.0)] * 1 + [(1.0, 1.0)] * 4)
    row = metrics.evaluation(df).first()
    assert (row.tn, row.fp, row.fn, row.tp) == (5, 2, 1, 4)
    assert row.precision == 4 / 6 and row.sensitivity == 4 / 5
    assert row.specificity == 5 / 7 and row.fpr == 2 / 7
    library = MulticlassClassificationEvaluator(metricName="accuracy").evaluate(df)
    assert row.accuracy == library
    for name in ("areaUnderROC", "areaUnderPR"):
        assert row[name] == pytest.approx(spark_area(df, name, "prediction"), abs=1e-12)


def test_counts_per_group_and_per_rule(spark):
    df = graded(spark, 300, 10)
    tried = {t: (F.col("score") > t).cast("double") for t in (2.0, 5.0, 8.0)}
    got = metrics.confusion_of_each(df, tried, "threshold").orderBy("ordinal").collect()
    long = df.withColumn("threshold", F.explode(F.array(*[F.lit(t) for t in tried])))
    long = long.withColumn("prediction", (F.col("score") > F.col("threshold")).cast("double"))
    want = metrics.confusion_by(long, ["threshold"]).orderBy("threshold").collect()
    assert [tuple(r)[1:] for r in got] == [tuple(r) for r in want]


def test_best_keeps_the_earlier_of_equals(spark):
    df = spark.createDataFrame([(0, 0.5), (2, 0.9), (1, 0.9), (3, 0.1)], "ordinal int, metric double")
    assert tuple(metrics.best_of(df, "metric", "ordinal").first()) == (1, 0.9)


def test_throughput_windows(spark):
    times = spark.sql("select timestamp_seconds(v) t from values (0), (1), (4.999), (5), (17) as x(v)")
    got = sorted((r.window_start.second, r.n, r.tps, r.rate) for r in throughput(times, "t").collect())
    assert got == [(0, 3, 0, 0.6), (5, 1, 0, 0.2), (15, 1, 0, 0.2)]
