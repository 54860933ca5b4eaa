"""Rejected lines, late rows and running metrics."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from raremill.operators import metrics
from raremill.schema import AMOUNT, txn_schema
from raremill.sinks import files
from raremill.sources import delimited
from raremill.streaming import evaluation as running
from raremill.streaming import windows

SMALL = T.StructType([
    T.StructField("id", T.LongType()), T.StructField("x", T.DoubleType()), T.StructField("k", T.IntegerType(), False),
])
LINES = {
    "1,0.5,2": None, "1,,2": None, ",,2": None, '"1",0.5,2': None,
    "1,0.5": ("few_fields", None), "": "blank", "  ": "blank", "1,0.5,2,3": ("many_fields", None),
    "a,0.5,2": ("bad_value", "id"), "1,b,c": ("bad_value", "x"), "1,2,": ("missing_value", "k"),
    "1,2,3.5": ("bad_value", "k"), "id,x,k": ("bad_value", "id"), "1,2,3,,": ("many_fields", None), '1,"2,3': ("malformed", None), "1": ("few_fields", None), '"1,5",2,3': ("bad_value", "id"),
}


def test_reasons(spark, tmp_path):
    rows = [(k, line) for k, line in enumerate(list(LINES) * 2)]
    df = spark.createDataFrame([*rows, (99, None)], "n long, value string")
    judged = delimited.judged_rows(df, SMALL, keep=("n",))
    got = {}
    for r in judged.collect():
        line = rows[r.n][1]
        got[line] = (r.reason, r.column) if r.reason else None
        assert r.rejected == (line if r.reason else None)
    assert got == {k: v for k, v in LINES.items() if v != "blank"}
    strict = sorted(tuple(r) for r in delimited.strict_rows(df, SMALL, keep=("n",)).collect())
    assert sorted((r.n, r.id, r.x, r.k) for r in judged.where("reason is null").collect()) == strict

    counts = files.write_judged(judged, str(tmp_path / "j"))
    want = Counter(v[0] if v else "kept" for v in LINES.values() if v != "blank")
    assert {k: v for k, v in counts.items() if v} == {"lines": 2 * sum(want.values()), **{k: 2 * v for k, v in want.items()}}
    kept, rejected = files.read_judged(spark, str(tmp_path / "j"), SMALL)
    assert kept.count() == counts["kept"] and kept.columns == SMALL.names
    assert kept.count() + rejected.count() == counts["lines"]
    assert Counter(r.line for r in rejected.collect()) == Counter({k: 2 for k, v in LINES.items() if v and v != "blank"})


def test_nothing_to_reject(spark, tmp_path):
    none = spark.createDataFrame([], "value string")
    counts = files.write_judged(delimited.judged_rows(none, txn_schema()), str(tmp_path / "j"))
    assert not any(counts.values())
    kept, rejected = files.read_judged(spark, str(tmp_path / "j"), txn_schema())
    assert kept.count() == rejected.count() == 0 and AMOUNT in kept.columns


def test_late_rows_correct_closed_windows(spark, tmp_path):
    """Rows of closed windows are kept aside and counted afterwards; others are on time, however late."""
    parts = [[0, 1, 6], [30, 4, None], [2, 21, 31], [100], [1, 95]]
    path, state, source = (str(tmp_path / n) for n in ("w", "s", "e"))
    seen, late, latest = Counter(), Counter(), None
    for part in parts:
        rows = spark.createDataFrame([(x, str(x)) for x in part], "s long, name string")
        rows = rows.select(F.timestamp_seconds("s").alias("at"), "name")
        rows.write.mode("append").parquet(source)
        stream = spark.readStream.schema(rows.schema).parquet(source)
        windows.throughput_with_late(stream, "at", path, state, 5, 10, available_now=True).awaitTermination()
        for x in part:
            if x is not None:
                start = x // 5 * 5
                closed = latest is not None and start + 5 <= latest - 10
                (late if closed else seen)[start] += 1
        latest = max([x for x in part if x is not None] + ([latest] if latest is not None else []))
    assert late == {0: 2}
    of = lambda df: {int(r.window_start.timestamp()): r.n for r in df.collect()}
    assert of(windows.windows_with_late(spark, path, corrected=False)) == dict(seen)
    assert of(windows.windows_with_late(spark, path)) == dict(seen + late)
    assert sorted(r.name for r in windows.late_rows(spark, path).collect()) == ["1", "2"]


@pytest.mark.parametrize("seed", range(5))
def test_areas_lie_within_their_bounds(spark, seed):
    draw = random.Random(seed)
    rows = []
    for _ in range(draw.choice([3, 50, 400])):
        label = int(draw.random() < 0.3)
        score = round(draw.gauss(0.55 if label else 0.45, 0.2), draw.choice([1, 3]))
        rows.append((score, label, int(score > 0.5)))
    rows += [(None, 1, 1), (float("nan"), 1, 1), (0.5, None, 0), (1e300, 1, 1), (-1e300, 0, 0)]
    df = spark.createDataFrame(rows, "score double, label int, prediction int")
    valid = df.where("score is not null and not isnan(score) and label is not null")
    exact, counts = metrics.curve_areas(valid, "score").first(), metrics.confusion(valid).first()
    width = []
    for bins in (1, 8, 2000):
        r = running.running_report(running.score_tallies(df, 0.0, 1.0, bins)).first()
        assert (r.tn, r.fp, r.fn, r.tp) == tuple(counts)
        assert r.areaUnderROC_low - 1e-12 <= exact.areaUnderROC <= r.areaUnderROC_high + 1e-12
        assert r.areaUnderPR_low - 1e-12 <= exact.areaUnderPR <= r.areaUnderPR_high + 1e-12
        width.append(r.areaUnderROC_high - r.areaUnderROC_low)
    assert width == sorted(width, reverse=True)


def test_one_class_has_no_areas(spark):
    df = spark.createDataFrame([(0.1, 0, 0)], "score double, label int, prediction int")
    r = running.running_report(running.score_tallies(df, 0.0, 1.0)).first()
    assert r.tn == 1 and r.areaUnderROC_low is None and r.areaUnderPR_high is None
    assert running.running_report(running.score_tallies(df.where("false"), 0.0, 1.0)).first().tn == 0
