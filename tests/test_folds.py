import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from raremill.operators import fold_smote, sampling
from raremill.plans import tuning
from raremill.schema import ID, LABEL
from raremill.sources.tables import transactions

FOLDS = 4


def points(spark, n, seed=0, spread=1.0):
    draw = np.random.default_rng(seed)
    rows = [(k, [float(x) for x in np.round(draw.normal(size=2) * spread, 1)]) for k in range(n)]
    return rows, spark.createDataFrame(rows, "id long, features array<double>")


def folds_of(df):
    return {r.id: r.fold for r in df.select("id", sampling.fold_column("id", FOLDS).alias("fold")).collect()}


def brute(rows, fold, k):
    want = {}
    for f in range(FOLDS):
        part = [r for r in rows if fold[r[0]] != f]
        for i, x in part:
            near = sorted((math.sqrt((x[0] - y[0]) ** 2 + (x[1] - y[1]) ** 2), j) for j, y in part if j != i)
            want[f, i] = near[:k]
    return want


@pytest.mark.parametrize(("n", "length"), [(90, None), (90, 3), (9, 3), (5, None), (2, None), (1, None)])
def test_lists_equal_brute_force(spark, n, length):
    """With copies, ties, lists that run short and folds with too few rows."""
    rows, df = points(spark, n)
    fold = folds_of(df)
    found = fold_smote.fold_lists(df, 3, FOLDS, fold_smote.fold_number(FOLDS), length, block_rows=16).collect()
    got = {(r.held_out, r.id): [(n.dist, n.id) for n in r.neighbours] for r in found}
    assert len(got) == len(found) and got == brute(rows, fold, 3)


def test_one_crowded_fold(spark):
    """All near neighbours of most rows lie in the held-out fold: their lists must be completed."""
    _, df = points(spark, 300)
    fold = folds_of(df)
    rows = [(i, [0.001 * i, 0.0] if fold[i] == 0 else [100.0 + i, 50.0]) for i in range(300)]
    df = spark.createDataFrame(rows, "id long, features array<double>")
    found = fold_smote.fold_lists(df, 3, FOLDS, fold_smote.fold_number(FOLDS)).collect()
    got = {(r.held_out, r.id): [(n.dist, n.id) for n in r.neighbours] for r in found}
    assert got == brute(rows, fold, 3)


def test_nothing_of_a_fold_is_used_for_it(spark, folder):
    txn = transactions(spark, folder)
    made = fold_smote.fold_synthetic_rows(txn, ["V1", "V2", "Amount"], LABEL, ID, 2.5, folds=3)
    fold = fold_smote.fold_number(3)
    rows = made.select("held_out", "seed_id", fold(F.col("seed_id")).alias("a"), fold(F.col("nn_id")).alias("b")).collect()
    assert rows and all(r.held_out not in (r.a, r.b) for r in rows)
    per_fold = {f: sum(r.held_out == f for r in rows) for f in range(3)}
    rare = [r.f for r in txn.where("Class = 1").select(fold(F.col(ID)).alias("f")).collect()]
    want = {f: int(sum(x != f for x in rare) * 2.5 + 0.5) for f in range(3)}
    assert per_fold == want


def test_keys_must_be_unique(spark, folder):
    txn = transactions(spark, folder).withColumn(ID, F.lit(1).cast("long"))
    with pytest.raises(ValueError, match="unique"):
        fold_smote.fold_synthetic_rows(txn, ["V1"], LABEL, ID, 1)


def test_cross_validation_within_folds(spark, folder, tmp_path):
    txn = transactions(spark, folder)
    grid = tuning.ForestGrid(num_trees=[3], max_depth=[2, 4])
    found = tuning.sweep(
        txn, [0, 2], [0.5, 0.5], grid, folds=2, log_folder=str(tmp_path), model_path=str(tmp_path / "m"), within_folds=True
    )
    assert len(found.settings) == 2 and found.submodels.count() == 4
    assert all(0 <= r.metric <= 1 for r in found.submodels.collect())
    assert found.report.first().param15 == "5"
