import pytest
from pyspark.sql import functions as F

from raremill.functions.hashing import hash_uniform, keyed_uuid
from raremill.operators import sampling


@pytest.fixture(scope="module")
def frame(spark):
    return spark.range(2000).select(
        F.col("id"), (F.col("id") % 50 == 0).cast("int").alias("Class")
    ).repartition(7)


def ids(df):
    return sorted(r.id for r in df.select("id").collect())


def test_uniform_is_in_range_and_keyed(spark, frame):
    row = frame.select(hash_uniform("x", 1, F.col("id")).alias("u")).agg(
        F.min("u"), F.max("u"), F.avg("u"), F.count_distinct("u")
    ).first()
    assert 0 <= row[0] < row[1] < 1 and abs(row[2] - 0.5) < 0.05 and row[3] > 1990
    same = frame.select(hash_uniform("x", 1, F.col("id")) == hash_uniform("x", 2, F.col("id")))
    assert not any(r[0] for r in same.collect())


def test_uuid_shape(frame):
    seen = [r[0] for r in frame.select(keyed_uuid("a", 1, F.col("id"))).collect()]
    assert len(set(seen)) == 2000 and {len(u) for u in seen} == {36}


@pytest.mark.parametrize("share", [0.0, 0.3, 0.7, 1.0])
def test_split_is_a_partition_of_the_rows(frame, share):
    train, test = sampling.train_test_split(frame, share, "id")
    a, b = ids(train), ids(test)
    assert sorted(a + b) == list(range(2000)) and not set(a) & set(b)
    assert abs(len(a) / 2000 - share) < 0.05


def test_split_ignores_partitioning(frame):
    one, _ = sampling.train_test_split(frame, 0.7, "id")
    other, _ = sampling.train_test_split(frame.repartition(3, "Class"), 0.7, "id")
    assert ids(one) == ids(other)


@pytest.mark.parametrize("ratio", [0.0, 1.0])
def test_undersampling_ends_are_no_ops(frame, ratio):
    assert sampling.undersample(frame, ratio, "Class", "id").count() == 2000


def test_undersampling_keeps_every_positive(frame):
    kept = sampling.undersample(frame, 0.3, "Class", "id")
    counts = {r.Class: r.n for r in sampling.class_counts(kept, "Class").collect()}
    assert counts[1] == 40 and abs(counts[0] / 1960 - 0.3) < 0.05
    assert set(ids(kept)) <= set(range(2000))
    other = sampling.undersample(frame, 0.3, "Class", "id", seed=2)
    assert ids(kept) != ids(other)


def test_undersampling_filter_reaches_the_source(spark, frame, tmp_path):
    frame.write.parquet(str(tmp_path / "t"))
    kept = sampling.undersample(spark.read.parquet(str(tmp_path / "t")), 0.3, "Class", "id")
    plan = spark._jvm.PythonSQLUtils.explainString(kept._jdf.queryExecution(), "formatted")
    assert "Exchange" not in plan
    pushed = next(text for text in plan.splitlines() if "PushedFilters" in text)
    assert "In(Class, [0,1])" in pushed


@pytest.mark.parametrize("size", [0, 1, 7, 1000, 1999, 2000, 3000])
def test_exact_size(frame, size):
    got = ids(sampling.hash_ranked(frame, size, "id", "s"))
    assert len(got) == min(size, 2000) == len(set(got))
    smaller = set(ids(sampling.hash_ranked(frame, size // 2, "id", "s")))
    assert smaller <= set(got)


@pytest.mark.parametrize("rate,expected", [(0.1, 200), (0.5, 1000), (1, 2000), (1.5, 3000), (3, 6000)])
def test_sample_copies(frame, rate, expected):
    rows = [(r.id, r.copy) for r in sampling.sample_copies(frame, rate, "id").collect()]
    assert len(rows) == len(set(rows)) == expected
    assert {c for _, c in rows} == set(range(1, int(-(-rate // 1)) + 1))


def test_replicate_numbers_copies(frame):
    rows = sampling.replicate(frame.limit(3), 4).groupBy("id").agg(F.sort_array(F.collect_list("copy")).alias("c"))
    assert [r.c for r in rows.collect()] == [[1, 2, 3, 4]] * 3


def test_folds(frame):
    sizes = frame.groupBy(sampling.fold_column("id", 5).alias("f")).count().collect()
    assert {r.f for r in sizes} == set(range(5)) and all(300 < r["count"] < 500 for r in sizes)
