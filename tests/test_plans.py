"""What the plans must look like, whatever the data size."""

import pytest
from pyspark.sql import functions as F

from raremill.functions.vectors import all_finite
from raremill.operators import knn, sampling
from raremill.operators.smote import pick_neighbours
from raremill.schema import ID
from raremill.sinks import publish
from raremill.sources.tables import transactions


def formatted(spark, df):
    return spark._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")


def executed(df):
    df.write.format("noop").mode("overwrite").save()
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]


@pytest.fixture
def session_conf(spark):
    changed = {}

    def change(**conf):
        for key, value in conf.items():
            key = key.replace("__", ".")
            changed.setdefault(key, spark.conf.get(key, None))
            spark.conf.set(key, value)

    yield change
    for key, value in changed.items():
        spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def test_rare_rows_are_selected_in_the_scan(spark, tmp_path):
    df = spark.range(100).select("id", F.rand(1).alias("a"), (F.col("id") % 9 == 0).cast("int").alias("Class"), F.lit("x").alias("unused"))
    df.write.parquet(str(tmp_path / "t"))
    rare = spark.read.parquet(str(tmp_path / "t")).where((F.col("Class") == 1) & all_finite(["a"])).select("id", F.array("a"))
    plan = formatted(spark, rare)
    assert "EqualTo(Class,1)" in plan and "unused" not in plan and "[codegen id" in plan


def test_sampling_needs_no_shuffle(spark, folder):
    txn = spark.range(1000).withColumn("Class", (F.col("id") % 7 == 0).cast("int"))
    for df in (
        *sampling.train_test_split(txn, 0.7, "id"),
        sampling.undersample(txn, 0.3, "Class", "id"),
        sampling.replicate(txn, 3),
        publish.keyed_sends(txn, cycles=2, key="id"),
    ):
        assert "Exchange" not in formatted(spark, df)


def test_unneeded_columns_are_not_read(spark, folder):
    plan = formatted(spark, transactions(spark, folder).select(ID, "Amount"))
    schemas = [text for text in plan.splitlines() if "ReadSchema" in text]
    assert any("struct<event_id:bigint,value:double>" in s for s in schemas)
    assert not any("embedding:array" in s or "props" in s for s in schemas)


def test_copies_are_limited_before_the_shuffle(spark):
    rows = spark.range(50).select("id", F.array(F.col("id") % 2 * 1.0).alias("features"), F.lit(True).alias("is_seed"))
    folded = knn._fold_copies(rows.withColumn("h", F.xxhash64("features")), 3, True)
    plan = folded._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2 and plan.count("Exchange hashpartitioning") == 1


def test_a_hot_group_of_copies_is_split(spark, session_conf):
    """A third of the rows are copies of one; the join that lists their neighbours
    runs on several tasks for that one key."""
    session_conf(
        spark__sql__autoBroadcastJoinThreshold="-1",
        spark__sql__adaptive__autoBroadcastJoinThreshold="-1",
        spark__sql__adaptive__skewJoin__skewedPartitionThresholdInBytes="200KB",
        spark__sql__adaptive__skewJoin__skewedPartitionFactor="2",
        spark__sql__adaptive__advisoryPartitionSizeInBytes="64KB",
        spark__sql__shuffle__partitions="16",
    )
    n = 30000
    value = F.when(F.col("id") % 3 == 0, F.lit(1.0)).otherwise(F.xxhash64("id") % 100000 / 100.0)
    rows = spark.range(0, n, 1, 8).select(
        "id", F.array(value, value * 2, *[F.xxhash64("id", F.lit(i)) % 2 * 0.0 for i in range(9)]).alias("features")
    )
    lists = knn.neighbour_lists(rows, 3)
    plan = executed(lists)
    assert "skew=true" in plan
    hot = lists.where("id % 3 = 0").select("id", F.col("neighbours.id").alias("nn")).limit(50).collect()
    for r in hot:
        assert r.nn == [i for i in (0, 3, 6, 9) if i != r.id][:3]
    assert lists.count() == n


def test_picking_a_neighbour_hashes_once(spark):
    lists = spark.createDataFrame(
        [(1, 1, [(0.5, 2, False), (0.7, 3, True)])],
        "id long, copy int, neighbours array<struct<dist:double,id:long,copy:boolean>>",
    )
    far = pick_neighbours(lists, "id").where(~F.col("same")).select("id", "nn_id", "dist", "rank")
    assert far._jdf.queryExecution().optimizedPlan().toString().count("md5") == 1
