import pytest
from pyspark.sql import functions as F

from raremill.operators import sampling
from raremill.sinks import publish
from raremill.sources import delimited, numbered
from raremill.sources.tables import table

SPLIT = "spark.sql.files.maxPartitionBytes"


@pytest.fixture
def pieces(spark):
    """Files are cut into pieces of about so many bytes."""
    before = spark.conf.get(SPLIT)
    yield lambda size: spark.conf.set(SPLIT, str(size))
    spark.conf.set(SPLIT, before)


@pytest.fixture
def lines(tmp_path):
    """Files with blank lines, one without a last line feed, an empty one and one in a subfolder's order."""
    texts = {
        "a.csv": "".join(f"row {k} {'x' * (k % 50)}\n" for k in range(500)),
        "b.csv": "",
        "c.csv": "one\n\n\nfour",
        "d.csv": "".join(f"tail {k}\r\n" for k in range(40)),
    }
    for name, text in texts.items():
        (tmp_path / name).write_text(text, newline="")
    whole = [x for text in texts.values() for x in text.replace("\r\n", "\n").removesuffix("\n").split("\n") if text]
    return str(tmp_path), whole


def test_numbers_do_not_depend_on_pieces(spark, lines, pieces):
    path, whole = lines
    for size in (64, 1000, 1 << 27):
        pieces(size)
        rows = numbered.numbered_lines(spark, path).collect()
        assert sorted((r.number, r.value) for r in rows) == list(enumerate(whole))
        in_file = {}
        for r in sorted(rows, key=lambda r: r.number):
            in_file.setdefault(r.file, []).append(r.line)
        assert sorted(map(len, in_file.values())) == [4, 40, 500]
        assert all(found == list(range(len(found))) for found in in_file.values())


def test_first_lines_are_left_out(spark, lines, pieces):
    path, whole = lines
    pieces(100)
    rows = numbered.numbered_lines(spark, path, header=True).collect()
    assert sorted(r.number for r in rows) == [n for n in range(len(whole)) if n not in (0, 500, 504)]


def test_parquet_rows(spark, folder, tmp_path, pieces):
    path = str(tmp_path / "events")
    events = table(spark, folder, "events").select("event_id", "value")
    events.repartitionByRange(6, "event_id").sortWithinPartitions("event_id").write.parquet(path)
    for size in (2000, 1 << 27):
        pieces(size)
        rows = numbered.numbered_rows(spark.read.parquet(path)).collect()
        assert sorted((r.number, r.event_id) for r in rows) == [(k, k) for k in range(1000)]
    assert numbered.numbered_rows(spark.read.parquet(path).where("false")).count() == 0


def test_starts(spark):
    counts = spark.createDataFrame([(f"f{k:03d}", k % 3, k) for k in range(200)], "file string, block int, n long")
    rows = sorted(numbered.with_starts(counts, ["file", "block"]).collect())
    assert [r.start for r in rows] == [sum(range(k)) for k in range(200)]
    assert numbered.with_starts(counts.where("false"), ["file", "block"]).collect() == []


def test_bad_ids_are_dealt_fairly(spark, tmp_path):
    """Half of the rows have an id that is no number: every choice treats them as rows of their own."""
    fields = ",".join(["0.5"] * 29)
    text = "".join(f"{'n/a' if k % 2 else k},{fields},{int(k % 10 == 0)}\n" for k in range(4000))
    (tmp_path / "t.csv").write_text("header\n" + text)
    rows = delimited.read_numbered_transactions(spark, str(tmp_path)).cache()
    assert rows.count() == 4000 == rows.select("number").distinct().count()
    bad = rows.where("ID = 0 and Class = 0")
    n = bad.count()
    train, test = sampling.train_test_split(bad, 0.7, "number")
    assert abs(train.count() / n - 0.7) < 0.04 and train.count() + test.count() == n
    folds = {r.f: r.n for r in bad.groupBy(sampling.fold_column("number", 5).alias("f")).agg(F.count("*").alias("n")).collect()}
    assert len(folds) == 5 and all(abs(k / n - 0.2) < 0.04 for k in folds.values())
    assert abs(sampling.undersample(bad, 0.3, "Class", "number").count() / n - 0.3) < 0.04
    sends = publish.keyed_sends(rows, 2, row_key="number")
    assert sends.select("uuid").distinct().count() == 8000 and sends.where("id = 0").count() == 4002
    rows.unpersist()
