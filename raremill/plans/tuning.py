"""Sweep over sampling settings with a cross-validated random forest for each."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field
from multiprocessing.pool import ThreadPool

from pyspark.ml import Pipeline
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.tuning import CrossValidator, CrossValidatorModel, ParamGridBuilder
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pyspark.util import inheritable_thread_target

from raremill.functions.times import run_stamp
from raremill.operators.fold_smote import HELD_OUT, fold_lists, fold_number, fold_synthetic_rows
from raremill.operators.metrics import evaluation
from raremill.operators.projection import label_indexer, label_names
from raremill.operators.sampling import fold_column, train_test_split, undersample
from raremill.operators.smote import Rare, rare_rows, synthetic_rows, with_lists
from raremill.schema import ID, LABEL, METRIC_NAMES, REPORT, SUBMODELS, TUNING_LOG, feature_cols
from raremill.session import cut_lineage
from raremill.sinks.files import append_log, save_model, write_table

FOLD = "fold"


@dataclass(frozen=True)
class ForestGrid:
    """Values to try for each random-forest parameter."""

    num_trees: list[int]
    max_depth: list[int]
    impurity: list[str] = field(default_factory=lambda: ["gini"])
    min_instances: list[int] = field(default_factory=list)
    subset: list[str] = field(default_factory=lambda: ["auto"])
    max_bins: list[int] = field(default_factory=lambda: [32])

    def __len__(self) -> int:
        size = len(self.num_trees) * len(self.max_depth) * len(self.impurity)
        return size * len(self.subset) * len(self.max_bins) * max(1, len(self.min_instances))

    def param_maps(self, forest: RandomForestClassifier) -> list[dict]:
        grid = ParamGridBuilder()
        grid.addGrid(forest.maxBins, self.max_bins)
        grid.addGrid(forest.featureSubsetStrategy, self.subset)
        grid.addGrid(forest.impurity, self.impurity)
        grid.addGrid(forest.maxDepth, self.max_depth)
        grid.addGrid(forest.numTrees, self.num_trees)
        if self.min_instances:
            grid.addGrid(forest.minInstancesPerNode, self.min_instances)
        return grid.build()


@dataclass(frozen=True)
class Setting:
    """What one sampling setting achieved."""

    over: float
    under: float
    metric: float
    model: CrossValidatorModel


@dataclass(frozen=True)
class Sweep:
    best: Setting
    settings: list[Setting]
    submodels: DataFrame
    report: DataFrame
    predictions: DataFrame


def sampling_pairs(over: list[float], under: list[float]) -> list[tuple[float, float]]:
    """Settings tried together: pairs by position, as long as the shorter list."""
    return list(zip(over, under))


def assemble(df: DataFrame, with_seconds: bool = False) -> DataFrame:
    return VectorAssembler(inputCols=feature_cols(with_seconds), outputCol="features").transform(df)


def forest_stages(
    train: DataFrame, label: str = LABEL, seed: int = 11, max_memory_mb: int | None = None
) -> tuple[Pipeline, RandomForestClassifier]:
    """Label index, forest, and the index turned back into the label."""
    indexer = label_indexer(label).fit(train)
    forest = RandomForestClassifier(seed=seed)
    if max_memory_mb:
        forest.setMaxMemoryInMB(max_memory_mb)
    return Pipeline(stages=[indexer, forest, label_names(list(indexer.labels))]), forest


def cross_validate(
    train: DataFrame,
    grid: ForestGrid,
    label: str = LABEL,
    folds: int = 5,
    parallelism: int = 4,
    seed: int = 11,
    score: str = "prediction",
    max_memory_mb: int | None = None,
    fold_col: str = "",
) -> CrossValidatorModel:
    """Best forest of the grid by area under the PR curve. ``score`` is the hard
    prediction by default; ``rawPrediction`` uses the whole curve. Folds are drawn
    with the seed, or taken from ``fold_col``."""
    return _search(train, grid, label, folds, parallelism, seed, score, max_memory_mb, fold_col).fit(train)


def _search(train, grid, label, folds, parallelism, seed, score, max_memory_mb, fold_col="") -> CrossValidator:
    stages, forest = forest_stages(train, label, seed, max_memory_mb)
    evaluator = BinaryClassificationEvaluator(
        metricName="areaUnderPR", labelCol="label", rawPredictionCol=score, numBins=0
    )
    return CrossValidator(
        estimator=stages,
        estimatorParamMaps=grid.param_maps(forest),
        evaluator=evaluator,
        numFolds=folds,
        foldCol=fold_col,
        parallelism=parallelism,
        seed=seed,
    )


def rebalance(
    train: DataFrame,
    over: float,
    under: float,
    with_seconds: bool = False,
    key: str = ID,
    label: str = LABEL,
    k: int = 5,
    seed: int = 11,
    folds: int = 5,
    rare: Rare | None = None,
) -> DataFrame:
    """Undersample the majority, then oversample the minority: (label, features, fold).

    The fold is a hash of the row's key; a synthetic row has that of its seed. ``rare``
    gives the minority's rows and neighbours, which are the same for every setting."""
    columns = [label, *feature_cols(with_seconds)]
    fold = fold_column(key, folds, seed)
    kept = undersample(train, under, label, key, seed)
    rows = kept.select(*columns, fold.alias(FOLD))
    if over == 0:
        return rows
    made = synthetic_rows(kept, columns[1:], label, key, over, k, seed, rare=rare)
    own = fold_column("seed_id", folds, seed)
    return rows.unionByName(made.select(*columns, own.alias(FOLD)))


def cross_validate_within(
    train: DataFrame,
    over: float,
    under: float,
    grid: ForestGrid,
    with_seconds: bool = False,
    key: str = ID,
    label: str = LABEL,
    k: int = 5,
    folds: int = 5,
    parallelism: int = 4,
    seed: int = 11,
    score: str = "prediction",
    max_memory_mb: int | None = None,
    rare: Rare | None = None,
    lists: DataFrame | None = None,
) -> CrossValidatorModel:
    """Best forest of the grid where every fold is judged on its rows as they came, by forests that
    saw nothing of it: the other folds' rows are undersampled, and oversampled among themselves.
    The chosen forest is fitted again on all of ``train``, rebalanced. ``key`` must be unique."""
    features = feature_cols(with_seconds)
    columns = [label, "features"]
    real = assemble(train, with_seconds).select(key, *columns, fold_column(key, folds, seed).alias(FOLD))
    real = cut_lineage(real.hint("rebalance"))
    made = None
    if over:
        # seeds of the folds and of the final fit are drawn alike
        made = fold_synthetic_rows(
            train, features, label, key, over, folds, k, seed, seed, rare=rare, lists=lists
        )
        made = cut_lineage(assemble(made, with_seconds).select(HELD_OUT, *columns).hint("rebalance"))
    search = _search(real.select(label), grid, label, folds, parallelism, seed, score, max_memory_mb)
    stages, maps = search.getEstimator(), search.getEstimatorParamMaps()

    def measured(job: tuple[int, int]) -> tuple[int, float]:
        fold, i = job
        rows = undersample(real.where(F.col(FOLD) != fold), under, label, key, seed).select(*columns)
        if made is not None:
            rows = rows.unionByName(made.where(F.col(HELD_OUT) == fold).select(*columns))
        model = stages.fit(rows, maps[i])
        judged = model.transform(real.where(F.col(FOLD) == fold).select(*columns))
        return i, search.getEvaluator().evaluate(judged)

    jobs = [(f, i) for f in range(folds) for i in range(len(maps))]
    sums = _in_threads(inheritable_thread_target(train.sparkSession)(measured), jobs, parallelism, len(maps))
    metrics = [s / folds for s in sums]
    ready = assemble(rebalance(train, over, under, with_seconds, key, label, k, seed, folds, rare), with_seconds)
    best = stages.fit(cut_lineage(ready.select(*columns).hint("rebalance")), maps[metrics.index(max(metrics))])
    return search._copyValues(CrossValidatorModel(best, metrics))


def _in_threads(run, jobs: Iterable, threads: int, results: int) -> list[float]:
    """Sums of what ``run`` measures for each result, several jobs at a time."""
    sums, pool = [0.0] * results, ThreadPool(threads)
    try:
        for i, value in pool.imap_unordered(run, jobs):
            sums[i] += value
    finally:
        pool.close()
    return sums


def rare_of(train: DataFrame, with_seconds: bool, key: str, label: str, k: int) -> Rare:
    """The minority and its neighbours, searched once for all settings of a sweep."""
    return with_lists(rare_rows(train, feature_cols(with_seconds), label, key), k)


def sweep(
    df: DataFrame,
    over: list[float],
    under: list[float],
    grid: ForestGrid,
    train_share: float = 0.7,
    with_seconds: bool = False,
    key: str = ID,
    label: str = LABEL,
    k: int = 5,
    folds: int = 5,
    parallelism: int = 4,
    seed: int = 11,
    score: str = "prediction",
    max_memory_mb: int | None = None,
    log_folder: str | None = None,
    model_path: str | None = None,
    within_folds: bool = False,
) -> Sweep:
    """Try every sampling setting, keep the one whose best forest has the largest
    metric (the earlier of equals), and evaluate it on the held-out share.

    ``within_folds`` resamples inside the training part of each fold (``cross_validate_within``)
    instead of before the folds are dealt.

    With ``log_folder`` the test partition, the per-parameter results and the
    report are written there; with ``model_path`` the chosen model too.
    """
    spark = df.sparkSession
    started = spark.range(1).select(run_stamp(F.current_timestamp())).first()[0]
    pairs = sampling_pairs(over, under)
    if not pairs:
        raise ValueError("no sampling settings")
    train, test = train_test_split(df, train_share, key, seed)
    rare = rare_of(train, with_seconds, key, label, k) if any(o for o, _ in pairs) else None
    settings, rows, lists = [], [], None
    if within_folds and rare:
        # one search for all settings
        lists = fold_lists(rare.rows.select("id", "features"), k, folds, fold_number(folds, seed))
        lists = cut_lineage(lists)

    def fitted(o: float, u: float) -> CrossValidatorModel:
        if within_folds:
            return cross_validate_within(
                train, o, u, grid, with_seconds, key, label, k, folds, parallelism, seed, score, max_memory_mb, rare, lists
            )
        balanced = rebalance(train, o, u, with_seconds, key, label, k, seed, folds, rare)
        ready = assemble(balanced, with_seconds).select(label, "features", FOLD)
        # read many times while fitting: stored once, in partitions of even size
        ready = cut_lineage(ready.hint("rebalance"))
        return cross_validate(ready, grid, label, folds, parallelism, seed, score, max_memory_mb, FOLD)

    for o, u in pairs:
        model = fitted(o, u)
        maps = zip(model.getEstimatorParamMaps(), model.avgMetrics)
        rows += [
            (started, float(u), float(o), {p.name: str(v) for p, v in params.items()}, float(metric))
            for params, metric in maps
        ]
        settings.append(Setting(o, u, float(max(model.avgMetrics)), model))
    # max keeps the first of equals
    best = max(settings, key=lambda s: s.metric)
    submodels = spark.createDataFrame(rows, SUBMODELS)
    predictions = cut_lineage(
        best.model.transform(assemble(test, with_seconds)).select(
            F.col(key).alias("id"),
            "prediction",
            F.col("predictedLabel").cast("double").alias("predictedLabel"),
            F.col("label"),
        )
    )
    report = _report(predictions, best, started, parallelism, over, under, grid, max_memory_mb, k)
    if log_folder:
        write_table(test, f"{log_folder}/test_partition")
        append_log(submodels, f"{log_folder}/submodel_log")
        append_log(report, f"{log_folder}/tuning_log")
    if model_path:
        save_model(best.model, model_path)
    return Sweep(best, settings, submodels, report, predictions)


def best_forest_params(model: CrossValidatorModel) -> dict:
    """The winning forest's parameters by name."""
    forest = model.bestModel.stages[1]
    return {p.name: v for p, v in forest.extractParamMap().items()}


def _report(predictions, best, started, workers, over, under, grid, max_memory_mb, k) -> DataFrame:
    params = best_forest_params(best.model)
    listed = [over, under, grid.num_trees, grid.max_depth, grid.impurity, grid.min_instances]
    listed += [grid.subset, grid.max_bins]
    given = [";".join(str(v) for v in values) for values in listed]
    given += [str(-1 if max_memory_mb is None else max_memory_mb), None, str(k)]
    known = {
        "executionTime": started,
        "numWorkerNodes": workers,
        "undersampling": float(best.under),
        "oversampling": float(best.over),
        **{
            n: params[n]
            for n in (
                "numTrees", "maxDepth", "maxBins", "impurity", "featureSubsetStrategy",
                "minInstancesPerNode",
            )
        },
        "areaunderPRCV": float(best.metric),
        **dict(zip([n for n in TUNING_LOG.names if n.startswith("param")], given, strict=True)),
    }
    measured = evaluation(predictions, "predictedLabel", "label", "prediction")
    return measured.select(
        *[
            (F.col(f.name) if f.name in [*METRIC_NAMES, "fpr"] else F.lit(known[f.name]))
            .cast(f.dataType)
            .alias(f.name)
            for f in REPORT
        ]
    )
