import datetime as dt

import pytest
from pyspark.sql import functions as F

from raremill import schema
from raremill.functions.times import run_stamp, second_of_day
from raremill.operators import projection
from raremill.sinks import files
from raremill.sources import delimited, messages


def line(i, with_seconds=False, label=0):
    numbers = [str(i)] + (["3600"] if with_seconds else []) + [f"{i}.{j}" for j in range(1, 30)]
    return ",".join([*numbers, str(label)])


def write(path, lines):
    path.write_text("\n".join(lines) + "\n")
    return str(path)


@pytest.mark.parametrize("with_seconds", [False, True])
def test_strict_scan(spark, tmp_path, with_seconds):
    header = ",".join(schema.txn_schema(with_seconds).names)
    bad = [line(9, with_seconds) + ",1", "1,2,3", line(8, with_seconds).replace("8.5", "x"), ""]
    no_label = line(7, with_seconds)[:-1]
    holes = line(6, with_seconds).replace("6.4", "")
    lines = [header, line(1, with_seconds), *bad, no_label, holes, line(2, with_seconds, 1)]
    df = delimited.read_transactions(spark, write(tmp_path / "t.csv", lines), with_seconds)
    assert df.columns == schema.txn_schema(with_seconds).names
    rows = {r.ID: r for r in df.collect()}
    assert sorted(rows) == [1, 2, 6]
    assert rows[6].V4 is None and rows[2].Class == 1 and rows[1].Amount == 1.29
    # the count does not depend on the columns asked for
    assert df.count() == 3 == df.select("ID").count() == df.select("Class").distinct().count() + 1


def test_quoted_fields(spark, tmp_path):
    text = line(1)[:-1] + '"1"'
    df = delimited.read_transactions(spark, write(tmp_path / "t.csv", [text]))
    assert [r.Class for r in df.collect()] == [1]


@pytest.mark.parametrize("with_seconds", [False, True])
def test_lenient_scan(spark, tmp_path, with_seconds):
    header = ' "any", header'
    odd = "x" + line(3, with_seconds)[1:].replace("3.29", " 3.29 ").replace("3.7", "seven")
    lines = [header, line(1, with_seconds), odd, "5, 6"]
    path = write(tmp_path / "t.csv", lines)
    rows = delimited.read_transactions_leniently(spark, path, with_seconds).collect()
    by_id = {r.ID: r for r in rows}
    assert sorted(by_id) == [0, 1, 5]
    assert by_id[0].V7 is None and by_id[0].Amount == 3.29 and by_id[5].Amount is None
    if with_seconds:
        assert by_id[1].NumericSecondDay == 3600 and by_id[5].NumericSecondDay == 6
    assert len(delimited.read_transactions_leniently(spark, path, with_seconds, header=False).collect()) == 4


def test_the_first_line_of_every_file_is_skipped(spark, tmp_path):
    for name in "ab":
        write(tmp_path / f"{name}.csv", ["7,7", *(line(i) for i in range(5))])
    df = delimited.read_transactions_leniently(spark, str(tmp_path))
    assert sorted(r.ID for r in df.collect()) == sorted([*range(5)] * 2)
    assert df.count() == 10 == df.select("ID").count()


def test_lenient_whole_numbers(spark):
    df = spark.createDataFrame([("1.5," + line(1)[2:],), (line(2)[:-1] + "1.5",)], "value string")
    rows = delimited.lenient_rows(df).orderBy("V1").collect()
    assert rows[0].ID == 0 and rows[1].ID == 2 and rows[1].Class is None


def test_labelled_text(spark, tmp_path):
    path = write(tmp_path / "s.txt", ["1|0.5|2|3", "0|1|2|3", "1.0|7|8|9"])
    df = delimited.read_labelled_text(spark, path, 2, "|")
    assert sorted(r.features for r in df.collect()) == [[0.5, 2.0], [7.0, 8.0]]


@pytest.mark.parametrize("with_seconds", [False, True])
def test_oversampled_scan(spark, tmp_path, with_seconds):
    n = 30 if with_seconds else 29
    first = "7" if with_seconds else "7.5"
    lines = ["1," + ",".join([first] + ["0.5"] * (n - 1)), "0," + ",".join(["1"] * (n + 1))]
    df = delimited.read_oversampled(spark, write(tmp_path / "o.csv", lines), with_seconds)
    assert df.columns[0] == "Class" and df.count() == 1


def test_predictions_round_trip(spark, tmp_path):
    when = dt.datetime(2024, 5, 6, 7, 8, 9, 123000)
    rows = [("u1", 1, 1.0, 1.0, 0.0, 1700000000000, when), ("u2", 2, 0.0, 0.0, 0.0, None, when)]
    df = spark.createDataFrame(rows, schema.PREDICTIONS)
    files.write_table(df, str(tmp_path / "p"), "csv")
    back = delimited.read_predictions(spark, str(tmp_path / "p"))
    assert sorted(back.collect()) == sorted(df.collect())
    assert back.count() == 2


def test_run_logs_are_copied_each_to_its_own_target(spark, tmp_path):
    source, target = tmp_path / "in", tmp_path / "out"
    source.mkdir()
    write(source / "test_partition.csv", [line(1), line(2, label=1)])
    numbers = ["1", "0.5", "2", "100", "30", "32", "entropy", "auto", "1"] + ["0.25"] * 11
    run = ",".join(["06/05/2024 07:08:09:0000123", *numbers, *["p"] * 11])
    write(source / "tuning_log.csv", [run])
    write(source / "submodel_log.csv", ["t,0.5,2,maxDepth:5,numTrees:10,0.75", "broken"])
    files.copy_run_tables(spark, str(source), str(target))
    files.copy_run_tables(spark, str(source), str(target))
    assert delimited.read_test_partition(spark, f"{target}/test_partition.csv").count() == 2
    runs = delimited.read_run_log(spark, f"{target}/tuning_log.csv").collect()
    assert len(runs) == 2 and runs[0].maxDepth == 30 and runs[0].param15 == "p"
    subs = spark.read.text(f"{target}/submodel_log.csv")
    assert subs.count() == 2
    found = delimited.read_submodel_log(spark, str(source / "submodel_log.csv")).first()
    assert found.params == "maxDepth:5,numTrees:10" and found.metric == 0.75


def test_metrics_log_is_appended(spark, tmp_path):
    row = dict.fromkeys(schema.METRIC_NAMES, 0.5)
    for _ in range(2):
        files.append_row(spark, row, schema.METRICS_LOG, str(tmp_path / "log"))
    assert spark.read.parquet(str(tmp_path / "log")).count() == 2


def test_schema_variants():
    assert len(schema.txn_schema()) == 31 and len(schema.txn_schema(True)) == 32
    assert schema.oversampled_schema().names == ["Class", *schema.feature_cols()]
    assert schema.message_schema(True).names[:3] == ["uuid", "id", "NumericSecondDay"]
    assert len(schema.TUNING_LOG) == 32
    assert len(schema.feature_cols()) == 29 and len(schema.feature_cols(True)) == 30


def test_stamp_and_second_of_day(spark):
    df = spark.sql("select timestamp'2024-05-06 07:08:09.012345' t, timestamp_ntz'2024-05-06 23:59:59.9' n")
    row = df.select(run_stamp(F.col("t")), second_of_day(F.col("t")), second_of_day(F.col("n"))).first()
    assert tuple(row) == ("06/05/2024 07:08:09:0000012", 7 * 3600 + 8 * 60 + 9, 86399)


def test_labels_by_name_not_frequency(spark):
    df = spark.createDataFrame([(1,)] * 5 + [(0,)] * 2, "Class int")
    model = projection.label_indexer("Class").fit(df)
    assert list(model.labels) == ["0", "1"]
    assert {(r.Class, r.label) for r in model.transform(df).collect()} == {(0, 0.0), (1, 1.0)}


def test_topics():
    assert messages.topic_list("a, b,a,") == ["a", "b"]
    options = messages.kafka_options("h:9092", "a,b", 500)
    assert options["subscribe"] == "a,b" and options["startingOffsets"] == "earliest"
    assert options["failOnDataLoss"] == "false" and options["maxOffsetsPerTrigger"] == "500"


def test_blank_lines_are_no_rows(spark, tmp_path):
    line = "u,1,1.0,1.0,0.0,5,2020-01-01T00:00:00.000000Z"
    (tmp_path / "p").mkdir()
    (tmp_path / "p" / "a.csv").write_text(f"{line}\n\n  \n{line}\n")
    assert delimited.read_predictions(spark, str(tmp_path / "p")).count() == 2
    row = ",".join(["7"] + ["0.5"] * 29 + ["1"])
    (tmp_path / "t").mkdir()
    (tmp_path / "t" / "a.csv").write_text(f"{row}\n\n \nx\n{row}\n")
    assert delimited.read_transactions_leniently(spark, str(tmp_path / "t"), header=False).count() == 3
    assert delimited.read_transactions_leniently(spark, str(tmp_path / "t"), header=True).count() == 2


def test_other_formats_are_read_or_raise(spark, tmp_path):
    path = str(tmp_path / "pred")
    rows = [("u", 1, 1.0, 1.0, 0.0, 5, None)]
    spark.createDataFrame(rows, schema.PREDICTIONS).write.parquet(path)
    assert delimited.read_predictions(spark, path, "parquet").count() == 1
    with pytest.raises(ValueError):
        delimited.read_predictions(spark, path).count()
    with pytest.raises(ValueError):
        delimited.read_run_log(spark, path, "parquet")


def test_copied_submodel_log_reads_back(spark, tmp_path):
    source, target = tmp_path / "s", tmp_path / "c"
    source.mkdir()
    log = "01.02.2020-03:04:05,0.3,2,maxDepth:5,numTrees:10,0.75"
    (source / "submodel_log.csv").write_text(log + "\n")
    (source / "tuning_log.csv").write_text("\n")
    (source / "test_partition.csv").write_text("\n")
    files.copy_run_tables(spark, str(source), str(target))
    first = delimited.read_submodel_log(spark, str(source / "submodel_log.csv")).collect()
    assert first[0].params == "maxDepth:5,numTrees:10"
    assert delimited.read_submodel_log(spark, f"{target}/submodel_log.csv").collect() == first
