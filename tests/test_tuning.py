import pytest
from pyspark.sql import functions as F

from raremill.operators.metrics import confusion
from raremill.plans import tuning
from raremill.plans.evaluation import evaluate_predictions
from raremill.schema import ID, LABEL, METRIC_NAMES
from raremill.sources.tables import transactions
from raremill.streaming.scoring import load_model


@pytest.fixture(scope="module")
def frame(spark, folder):
    """More positives than the view has, so that every fold holds some."""
    txn = transactions(spark, folder)
    return txn.withColumn(LABEL, ((F.col("Amount") > 60) & (F.col("V1") > 0)).cast("int"))


@pytest.fixture(scope="module")
def swept(spark, frame, tmp_path_factory):
    where = tmp_path_factory.mktemp("sweep")
    grid = tuning.ForestGrid([2, 4], [3], ["gini", "entropy"])
    found = tuning.sweep(
        frame, [0, 1, 5], [1.0, 0.5], grid, folds=2, log_folder=str(where / "logs"),
        model_path=str(where / "model"),
    )
    return found, grid, where


def test_pairs_stop_at_the_shorter_list():
    assert tuning.sampling_pairs([1, 2, 3], [0.1, 0.2]) == [(1, 0.1), (2, 0.2)]


def test_grid_size():
    from pyspark.ml.classification import RandomForestClassifier

    grid = tuning.ForestGrid([1, 2], [3, 4, 5], ["gini", "entropy"], [1, 2], ["auto"], [16, 32])
    assert len(grid) == 48 == len(grid.param_maps(RandomForestClassifier()))
    assert len(tuning.ForestGrid([1, 2], [3])) == 2


def test_sweep_tries_every_setting_and_parameter(swept):
    found, grid, _ = swept
    rows = found.submodels.collect()
    assert len(found.settings) == 2 and len(rows) == 2 * len(grid)
    assert {r.params["numTrees"] for r in rows} == {"2", "4"}
    assert found.best.metric == max(r.metric for r in rows) == max(s.metric for s in found.settings)
    first = next(s for s in found.settings if s.metric == found.best.metric)
    assert found.best is first


def test_report_describes_the_best_setting(swept, frame):
    found, _, _ = swept
    row = found.report.first()
    assert len(found.report.columns) == 33
    assert (row.oversampling, row.undersampling) == (found.best.over, found.best.under)
    assert row.numTrees in (2, 4) and row.maxDepth == 3 and row.param2 == "0;1;5"
    counts = confusion(found.predictions, "predictedLabel").first()
    assert (row.tn, row.fp, row.fn, row.tp) == tuple(float(c) for c in counts)
    again = evaluate_predictions(found.predictions).first()
    assert all(again[n] == row[n] for n in [*METRIC_NAMES, "fpr"])
    assert row.areaUnderROC > 0.5


def test_logs_and_model_are_stored(spark, swept, frame):
    found, grid, where = swept
    assert spark.read.parquet(f"{where}/logs/submodel_log").count() == 2 * len(grid)
    assert spark.read.parquet(f"{where}/logs/tuning_log").count() == 1
    test = spark.read.parquet(f"{where}/logs/test_partition")
    model = load_model(f"{where}/model")
    again = model.transform(tuning.assemble(test)).select(F.col(ID).alias("id"), "prediction")
    want = found.predictions.select("id", "prediction")
    assert again.exceptAll(want).count() == 0 and again.count() == want.count()


def test_rebalanced_classes(frame):
    before = {r[LABEL]: r["count"] for r in frame.groupBy(LABEL).count().collect()}
    after = {r[LABEL]: r["count"] for r in tuning.rebalance(frame, 2, 0.5).groupBy(LABEL).count().collect()}
    assert after[1] == 3 * before[1] and abs(after[0] / before[0] - 0.5) < 0.1


def test_labels_survive_a_minority_made_larger(frame):
    """Index 1 stays the rare class even when oversampling makes it the larger one."""
    ready = tuning.assemble(tuning.rebalance(frame, 9, 0.1)).select(LABEL, "features")
    stages, forest = tuning.forest_stages(ready)
    forest.setNumTrees(2).setMaxDepth(2)
    scored = stages.fit(ready).transform(ready)
    assert scored.where(F.col("label") != F.col(LABEL)).count() == 0
    assert scored.where(F.col("predictedLabel").cast("double") != F.col("prediction")).count() == 0


def test_no_settings(frame):
    with pytest.raises(ValueError):
        tuning.sweep(frame, [], [], tuning.ForestGrid([1], [1]))


def test_given_folds(frame):
    from raremill.operators.sampling import fold_column

    ready = tuning.assemble(frame.withColumn("fold", fold_column(ID, 3)))
    grid = tuning.ForestGrid([1, 2], [2])
    model = tuning.cross_validate(ready, grid, folds=3, fold_col="fold")
    assert len(model.avgMetrics) == 2 and tuning.best_forest_params(model)["maxDepth"] == 2


def test_folds_do_not_depend_on_partitioning(frame):
    def folds(df):
        rows = tuning.rebalance(df, 2, 0.5).groupBy(tuning.FOLD, LABEL).count().collect()
        return sorted(map(tuple, rows))

    assert folds(frame.repartition(1)) == folds(frame.repartition(5))


def test_one_neighbour_search_per_sweep(frame, monkeypatch):
    from raremill.operators import smote

    calls = []
    plain = smote.neighbour_lists
    monkeypatch.setattr(smote, "neighbour_lists", lambda *a, **b: calls.append(1) or plain(*a, **b))
    grid = tuning.ForestGrid(num_trees=[2], max_depth=[2])
    found = tuning.sweep(frame, [1, 1.5], [0.5, 0.4], grid, folds=2)
    assert len(calls) == 1
    assert sorted({r.oversampling for r in found.submodels.collect()}) == [1.0, 1.5]
