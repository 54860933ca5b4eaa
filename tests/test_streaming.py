import pytest
from pyspark.ml.tuning import CrossValidatorModel
from pyspark.sql import functions as F

from raremill.operators.sampling import train_test_split
from raremill.operators.throughput import throughput
from raremill.plans import tuning
from raremill.plans.evaluation import evaluate_folder
from raremill.schema import ID, LABEL, PREDICTIONS
from raremill.sinks import files, publish
from raremill.sources import delimited, messages
from raremill.sources.tables import stream_table, table, transactions
from raremill.streaming import scoring, windows


@pytest.fixture(scope="module")
def model(spark, folder, tmp_path_factory):
    """A small cross-validated forest, saved and loaded again."""
    txn = transactions(spark, folder)
    ready = tuning.assemble(tuning.rebalance(txn, 3, 0.5)).select(LABEL, "features")
    grid = tuning.ForestGrid(num_trees=[3], max_depth=[3])
    path = str(tmp_path_factory.mktemp("model") / "m")
    files.save_model(tuning.cross_validate(ready, grid, folds=2), path)
    loaded = scoring.load_model(path)
    assert isinstance(loaded, CrossValidatorModel)
    return loaded


@pytest.fixture(scope="module")
def published(spark, folder, tmp_path_factory):
    """All transactions as messages in several files."""
    path = str(tmp_path_factory.mktemp("messages") / "m")
    sends = publish.keyed_sends(transactions(spark, folder))
    publish.to_files(publish.messages(sends.repartition(4)), path)
    return path


def key(r):
    return (r.uuid, r.id, r.prediction, r.predictedLabel, r.label)


def batch_scores(spark, published, model):
    rows = scoring.decode_messages(spark.read.schema(messages.FILE_SCHEMA).parquet(published))
    return sorted(key(r) for r in scoring.score(rows, model).collect())


def test_stream_equals_batch_and_restart_adds_nothing(spark, published, model, tmp_path):
    want = batch_scores(spark, published, model)
    out, state = str(tmp_path / "predictions"), str(tmp_path / "state")
    for _ in range(2):
        stream = scoring.decode_messages(messages.file_messages(spark, published, max_files=1))
        scoring.score_stream(stream, model, out, state, available_now=True).awaitTermination()
    rows = delimited.read_predictions(spark, out).collect()
    assert sorted(key(r) for r in rows) == want and len(want) == 1000
    assert all(r.incoming_time and r.prediction_time for r in rows)
    assert len({r.prediction_time for r in rows}) > 1  # stamped per batch

    report = evaluate_folder(spark, out, str(tmp_path / "log")).first()
    assert report.tp + report.fp + report.fn + report.tn == 1000
    evaluate_folder(spark, out, str(tmp_path / "log"))
    assert spark.read.parquet(str(tmp_path / "log")).count() == 2


def test_batches_replace_their_folder_when_run_again(spark, published, model, tmp_path):
    out = str(tmp_path / "predictions")
    want = batch_scores(spark, published, model)
    for state in ("a", "b"):  # a lost checkpoint replays every batch
        stream = scoring.decode_messages(messages.file_messages(spark, published, max_files=1))
        scoring.score_batches(
            stream, model, out, str(tmp_path / state), fmt="parquet", available_now=True
        ).awaitTermination()
        rows = spark.read.parquet(out)
        assert set(PREDICTIONS.names) <= set(rows.columns)
        assert sorted(key(r) for r in rows.collect()) == want
        assert rows.select("batch_id").distinct().count() > 1


def test_an_empty_batch_writes_nothing(spark, published, model, tmp_path):
    nothing = messages.file_messages(spark, published).where("id < 0")
    stream = scoring.decode_messages(nothing)
    scoring.score_batches(
        stream, model, str(tmp_path / "p"), str(tmp_path / "s"), available_now=True
    ).awaitTermination()
    assert not (tmp_path / "p").exists()


def test_uuid_from_the_key_and_lineage(spark, published):
    df = spark.read.schema(messages.FILE_SCHEMA).parquet(published).withColumn("offset", F.lit(5))
    changed = df.withColumn("key", F.concat(F.lit("k"), "key"))
    rows = scoring.decode_messages(changed, uuid_from_key=True, keep=("offset",))
    first = rows.first()
    assert first.uuid.startswith("k") and first.offset == 5 and "key" not in rows.columns


def test_malformed_messages_can_be_skipped(spark, published):
    df = spark.read.schema(messages.FILE_SCHEMA).parquet(published)
    bad = df.limit(3).withColumn("value", F.lit(b"junk"))
    mixed = df.unionByName(bad)
    assert scoring.decode_messages(mixed, permissive=True).count() == 1000
    with pytest.raises(Exception, match="malformed"):
        scoring.decode_messages(mixed).select(F.sum("V1")).collect()


def test_sends_are_numbered_and_logged(spark, folder):
    txn = transactions(spark, folder)
    sends = publish.keyed_sends(txn, cycles=2, producers=3)
    assert sends.count() == 6000 == sends.select("uuid").distinct().count()
    again = publish.keyed_sends(txn.repartition(3), cycles=2, producers=3)
    assert sends.select("uuid").exceptAll(again.select("uuid")).count() == 0
    other = publish.keyed_sends(txn, seed=2).select("uuid")
    assert other.intersect(sends.select("uuid")).count() == 0
    log = publish.send_log(publish.messages(sends))
    assert log.columns == ["uuid", "id", "time"] and log.where("time > 1.6e12").count() == 6000


def test_stream_windows_equal_batch_windows(spark, folder, tmp_path):
    events = stream_table(spark, folder, "events").select(F.col("ts").cast("timestamp").alias("ts"))
    windows.throughput_stream(
        events, "ts", str(tmp_path / "w"), str(tmp_path / "s"), available_now=True
    ).awaitTermination()
    got = sorted(tuple(r) for r in spark.read.parquet(str(tmp_path / "w")).collect())
    batch = table(spark, folder, "events").select(F.col("ts").cast("timestamp").alias("ts"))
    closed = batch.agg(F.date_trunc("millisecond", F.max("ts")) - F.expr("interval 10 seconds")).first()[0]
    every = throughput(batch, "ts").collect()
    want = sorted(tuple(r) for r in every if (closed - r.window_start).total_seconds() >= 5)
    assert got == want and len(got) > 900


def test_intervals():
    assert scoring.batch_interval(250, "ms") == "250 milliseconds"
    assert scoring.batch_interval(3) == "3000 milliseconds"


def test_held_out_rows_are_scored_once(spark, folder, model):
    _, test = train_test_split(transactions(spark, folder), 0.7, ID)
    scored = scoring.score(publish.keyed_sends(test), model, keep=("cycle",))
    assert scored.columns == [*PREDICTIONS.names, "cycle"]
    assert scored.count() == test.count()
