import pytest
from pyspark.sql import functions as F

from raremill.operators.smote import smote, synthetic_rows

FEATURES = ["a", "b", "c"]


@pytest.fixture(scope="module")
def frame(spark):
    return spark.range(300).select(
        F.col("id"),
        (F.sin(F.col("id") * 12.9898) * 10).alias("a"),
        (F.cos(F.col("id") * 78.233) * 5).alias("b"),
        (F.col("id") % 97).cast("int").alias("c"),
        (F.col("id") % 10 == 0).cast("int").alias("Class"),
    )


def points(frame):
    return {r.id: (r.a, r.b, float(r.c)) for r in frame.where("Class = 1").collect()}


@pytest.mark.parametrize("rate,expected", [(0.5, 15), (1, 30), (1.5, 45), (3, 90)])
def test_count_and_position(frame, rate, expected):
    rows = synthetic_rows(frame, FEATURES, "Class", "id", rate).collect()
    where = points(frame)
    assert len(rows) == expected
    assert len({(r.seed_id, r.copy) for r in rows}) == expected
    for r in rows:
        assert r.Class == 1 and r.seed_id != r.nn_id
        for value, x, y in zip((r.a, r.b, r.c), where[r.seed_id], where[r.nn_id]):
            slack = 0.5 if isinstance(value, int) else 1e-12
            assert min(x, y) - slack <= value <= max(x, y) + slack
        assert isinstance(r.c, int)


def test_extrapolation_moves_away(frame):
    where = points(frame)
    for r in synthetic_rows(frame, FEATURES, "Class", "id", 1, mode="extrapolate").collect():
        x, y = where[r.seed_id][0], where[r.nn_id][0]
        assert (r.a - x) * (y - x) <= 0


def test_result_ignores_partitioning_and_blocking(frame):
    one = synthetic_rows(frame, FEATURES, "Class", "id", 2).collect()
    other = synthetic_rows(frame.repartition(5), FEATURES, "Class", "id", 2, block_rows=8).collect()
    assert sorted(one) == sorted(other)
    third = synthetic_rows(frame, FEATURES, "Class", "id", 2, seed=9).collect()
    assert sorted(one) != sorted(third)


def test_union_keeps_the_originals(frame):
    out = smote(frame, FEATURES, "Class", "id", 2)
    assert out.columns == ["Class", *FEATURES]
    assert out.where("Class = 0").count() == 270 and out.where("Class = 1").count() == 90
    original = frame.select("Class", *FEATURES)
    assert original.exceptAll(out).count() == 0


def test_rate_zero_adds_nothing(frame):
    assert smote(frame, FEATURES, "Class", "id", 0).count() == 300


@pytest.mark.parametrize("m,expected", [(0, 0), (1, 0), (2, 6), (5, 15)])
def test_small_minorities(frame, m, expected):
    few = frame.withColumn("Class", (F.col("id") < m).cast("int"))
    assert synthetic_rows(few, FEATURES, "Class", "id", 3, k=5).count() == expected


def test_copies_of_one_point_stay_there(frame):
    same = frame.withColumns({"a": F.lit(1.5), "b": F.lit(2.5), "c": F.lit(3)})
    rows = synthetic_rows(same, FEATURES, "Class", "id", 2).collect()
    assert len(rows) == 60 and {(r.a, r.b, r.c) for r in rows} == {(1.5, 2.5, 3)}
    assert all(r.nn_id in {0, 10, 20, 30, 40, 50} and r.nn_id != r.seed_id for r in rows)


def test_rows_with_missing_features_are_kept_but_not_used(frame):
    holes = frame.withColumn("a", F.when(F.col("id") != 10, F.col("a")))
    rows = synthetic_rows(holes, FEATURES, "Class", "id", 1).collect()
    assert len(rows) == 29 and all(10 not in (r.seed_id, r.nn_id) for r in rows)
    assert smote(holes, FEATURES, "Class", "id", 1).count() == 329


def test_unknown_mode(frame):
    with pytest.raises(ValueError):
        synthetic_rows(frame, FEATURES, "Class", "id", 1, mode="sideways")


def test_rows_of_one_key_stay_apart(spark):
    from raremill.operators.smote import synthetic_rows

    rows = [(i % 4 if i % 5 else None, float(i), float(i % 3), 1) for i in range(20)] + [(99, 0.0, 0.0, 0)]
    rows += [rows[0]] * 3
    got = {}
    for parts in (1, 5):
        df = spark.createDataFrame(rows, "id long, a double, b double, y int").repartition(parts)
        made = synthetic_rows(df, ["a", "b"], "y", "id", 3).collect()
        assert len(made) == 3 * 23
        got[parts] = sorted((r.seed_id is not None, r.seed_id or 0, r.a, r.b) for r in made)
        assert {r.seed_id for r in made} <= {None, 0, 1, 2, 3}
    assert got[1] == got[5]
