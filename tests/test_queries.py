import re
from pathlib import Path

import compare
import pytest
from pyspark.sql import DataFrame

import __spark_entry__ as entry
from raremill.session import shared_folder

ROOT = Path(__file__).resolve().parents[1]


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query_equals_its_sql(spark, folder, name):
    assert compare.run(spark, folder, [name]) == {name: None}


def test_sql_belongs_to_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    df = entry.entry(spark)
    assert isinstance(df, DataFrame) and df.columns[0] == "Class" and df.count() > 1000


def test_shared_folder_is_the_sessions_own(spark):
    configured = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if configured:
        assert configured in shared_folder(spark)
    assert shared_folder(spark) == shared_folder(spark)


def test_nothing_is_collected_or_cut_locally():
    """Only the k-NN join brings rows to the driver: its bounded pivots and cells."""
    text = {p: p.read_text() for p in (ROOT / "raremill").rglob("*.py")}
    collecting = {
        p.name for p, t in text.items()
        if "llm" not in p.parts and re.search(r"\.(collect|toPandas|toArrow|toLocalIterator)\(\)", t)
    }
    assert collecting <= {"knn.py"}
    for banned in ("localCheckpoint", "crossJoin", ".coalesce(1)", "repartition(1)"):
        assert not [p.name for p, t in text.items() if banned in t]
