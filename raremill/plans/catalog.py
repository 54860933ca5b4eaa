"""Named queries over the given tables, each reading its whole tables."""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from raremill.functions.hashing import hash_uniform, keyed_uuid
from raremill.functions.times import run_stamp
from raremill.operators import fold_smote, knn, metrics, projection, sampling
from raremill.operators import smote as oversampling
from raremill.operators.throughput import throughput
from raremill.plans import oracle, tuning
from raremill.schema import AMOUNT, ID, LABEL, TUNING_LOG, feature_cols, txn_schema
from raremill.session import cut_lineage, shared_folder
from raremill.sinks import files, publish
from raremill.sources import delimited, messages, numbered
from raremill.sources.tables import stream_table, table, transactions
from raremill.streaming import evaluation as running
from raremill.streaming import latency, ledger, scoring, windows

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

FEATURES = feature_cols()
SAMPLING = [(2, 0.3), (4, 0.1), (6, 0.5)]
THRESHOLDS = [120.0, 140.0, 160.0, 200.0, 300.0, 1e6]


def query(sql: str | None = None):
    def register(fn: Query) -> Query:
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLES[fn.__name__] = sql
        return fn

    return register


def minority(spark: SparkSession, folder: str) -> DataFrame:
    return projection.minority_vectors(transactions(spark, folder), FEATURES, LABEL, ID)


def rule_scores(spark: SparkSession, folder: str) -> DataFrame:
    """The rule "amount above 160" as a classifier, with the amount as graded score."""
    txn = transactions(spark, folder)
    return txn.select(
        F.col(ID).alias("id"),
        F.col(LABEL).cast("double").alias("label"),
        (F.col(AMOUNT) > 160).cast("double").alias("prediction"),
        F.col(AMOUNT).alias("score"),
    )


def document_scores(spark: SparkSession, folder: str) -> DataFrame:
    """Document length as a graded score of the quality label."""
    docs = table(spark, folder, "documents").select("doc_id", "n_chars")
    return table(spark, folder, "labels").join(docs, "doc_id").select(
        F.col("quality").alias("label"),
        F.col("n_chars").cast("double").alias("score"),
        (F.col("n_chars") > 1000).cast("double").alias("prediction"),
    )


# --- scans and row shapes -------------------------------------------------


@query(oracle.txn("select * from txn"))
def txn_view(spark, folder):
    return transactions(spark, folder)


@query(oracle.txn(f'select "Class", "NumericSecondDay", {oracle.FEATURES} from txn'))
def label_first_projection(spark, folder):
    return projection.label_first(transactions(spark, folder), with_seconds=True)


@query(oracle.SCAN_TEXT_MINORITY)
def scan_text_minority(spark, folder):
    text = F.concat_ws(",", LABEL, *[F.col(c).cast("string") for c in FEATURES])
    lines = transactions(spark, folder).select(F.col(ID).alias("id"), text.alias("value"))
    found = delimited.labelled_lines(lines, 5, keep=("id",))
    return found.select("id", "label", *[F.col("features")[i].alias(f"f{i + 1}") for i in range(5)])


@query(oracle.SCAN_DF_MINORITY)
def scan_df_minority(spark, folder):
    found = projection.minority_vectors(transactions(spark, folder), FEATURES, LABEL, ID, 7)
    return found.select("id", "label", *[F.col("features")[i].alias(f"f{i + 1}") for i in range(7)])


def _dirty_lines(spark, folder):
    """Transaction lines with faults that depend on the event's type: padded fields,
    an id that is no number, a bad amount, a field too many."""
    txn = transactions(spark, folder, extra=("event_type",))
    kind = F.col("event_type")
    identity = F.when(kind == "click", F.lit("n/a")).otherwise(F.col(ID).cast("string"))
    amount = F.when(kind == "error", F.lit("?")).otherwise(F.col(AMOUNT).cast("string"))
    pad = F.when(kind == "view", F.lit(" ")).otherwise(F.lit(""))
    tail = F.when(kind == "purchase", F.lit(",end")).otherwise(F.lit(""))
    vectors = [F.col(c).cast("string") for c in FEATURES[:-1]]
    fields = [F.concat(pad, f) for f in [identity, *vectors, amount, F.col(LABEL).cast("string")]]
    line = F.concat(F.concat_ws(",", *fields), tail)
    return txn.select(F.col(ID).alias("line_no"), line.alias("value"))


@query(oracle.SCAN_LENIENT)
def scan_lenient_csv(spark, folder):
    rows = delimited.lenient_rows(_dirty_lines(spark, folder), keep=("line_no",))
    return rows.select("line_no", ID, "V1", "V28", AMOUNT, LABEL)


@query(oracle.DROP_MALFORMED)
def drop_malformed(spark, folder):
    rows = delimited.strict_rows(_dirty_lines(spark, folder), txn_schema(), keep=("line_no",))
    return rows.select("line_no", ID, "V1", "V28", AMOUNT, LABEL)


#: Rows of a file that is written in order: what one task sorts does not grow with the table.
_FILE_ROWS = 250_000


def _files(rows: DataFrame, least: int) -> int:
    return max(least, math.ceil(rows.count() / _FILE_ROWS))


def _numbered(spark, folder):
    """The same lines stored over several files in the order of their ids, read leniently and numbered
    by file and position: clicks all have id 0, yet every row has a number of its own."""
    path = f"{_run_folder(spark)}/lines"
    files_ = _files(table(spark, folder, "events"), 4)
    lines = _dirty_lines(spark, folder).repartitionByRange(files_, "line_no").sortWithinPartitions("line_no")
    lines.select("value").write.text(path)
    return delimited.read_numbered_transactions(spark, path, header=False)


@query(oracle.numbered('select number, "ID", "V1", "V28", "Amount", "Class" from numbered'))
def numbered_lenient_scan(spark, folder):
    return _numbered(spark, folder).select("number", ID, "V1", "V28", AMOUNT, LABEL)


@query(oracle.NUMBERED_EVENTS)
def numbered_table(spark, folder):
    """Events stored over several Parquet files in time order, numbered by file and position."""
    path = f"{_run_folder(spark)}/events"
    events = table(spark, folder, "events").select("event_id", "ts", "user_id")
    events.repartitionByRange(_files(events, 5), "ts", "event_id").sortWithinPartitions("ts", "event_id").write.parquet(path)
    return numbered.numbered_rows(spark.read.parquet(path)).select("event_id", "number")


@query(oracle.SPLIT_BAD_IDS)
def split_bad_ids(spark, folder):
    """Training share and fold of rows of which many have the same id."""
    part = F.when(sampling.in_training(0.7, "number"), "train").otherwise("test")
    fold = sampling.fold_column("number", 5)
    return _numbered(spark, folder).select("number", ID, LABEL, part.alias("part"), fold.alias("fold"))


@query(oracle.UNDERSAMPLE_BAD_IDS)
def undersample_bad_ids(spark, folder):
    kept = sampling.undersample(_numbered(spark, folder), 0.3, LABEL, "number")
    return kept.select("number", ID, LABEL)


@query(oracle.PUBLISH_REPEATED_IDS)
def publish_repeated_ids(spark, folder):
    """Sends of rows that share an id: a uuid each, the id as it is."""
    sends = publish.keyed_sends(_numbered(spark, folder), cycles=2, row_key="number")
    return sends.select("uuid", "id", "cycle", "number")


@query(oracle.REJECTS)
def rejects_by_reason(spark, folder):
    """Lines kept and rejected by one pass: counts of the stored tables, beside those that the sink returns."""
    path = f"{_run_folder(spark)}/judged"
    judged = delimited.judged_rows(_dirty_lines(spark, folder), txn_schema())
    seen = files.write_judged(judged, path)
    kept, rejected = files.read_judged(spark, path, txn_schema())
    counted = rejected.groupBy("reason", "column").agg(F.count(F.lit(1)).alias("n"))
    whole = kept.agg(F.lit("kept").alias("reason"), F.lit(None).cast("string").alias("column"), F.count(F.lit(1)).alias("n"))
    observed = F.create_map(*[x for r, n in seen.items() for x in (F.lit(r), F.lit(n))])
    counted = counted.unionByName(whole)
    total = F.sum("n").over(Window.partitionBy("reason"))
    return counted.select("reason", "column", "n", (total == observed[F.col("reason")]).alias("as_observed"))


@query(oracle.PREDICTIONS)
def prediction_projection(spark, folder):
    txn = transactions(spark, folder, extra=("ts",))
    hit = (F.col(AMOUNT) > 160).cast("double")
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    scored = txn.select(
        keyed_uuid("txn", 1, F.col(ID)).alias("uuid"),
        F.col(ID).alias("id"),
        hit.alias("prediction"),
        hit.alias("predictedLabel"),
        F.col(LABEL).alias("label"),
        F.floor(micros / 1000).alias("incoming_time"),
        F.col("ts").alias("prediction_time"),
    )
    return projection.predictions_only(scored).withColumn(
        "prediction_time", F.col("prediction_time").cast("timestamp_ntz")
    )


def _run_folder(spark: SparkSession) -> str:
    """A new folder in shared storage for what one run writes."""
    return f"{shared_folder(spark)}/run-{uuid.uuid4()}"


@query(oracle.txn("select * from txn"))
def stored_transactions(spark, folder):
    """The transactions written as CSV with a header and scanned again."""
    path = f"{_run_folder(spark)}/transactions"
    files.write_table(transactions(spark, folder), path, "csv", header=True)
    return delimited.read_transactions(spark, path, with_seconds=True)


@query(oracle.txn(f'select "Class", "NumericSecondDay", {oracle.FEATURES} from txn'))
def stored_oversampled(spark, folder):
    path = f"{_run_folder(spark)}/oversampled"
    rows = projection.label_first(transactions(spark, folder), with_seconds=True)
    files.write_table(rows, path, "csv")
    return delimited.read_oversampled(spark, path, with_seconds=True)


@query(oracle.PREDICTIONS)
def stored_predictions(spark, folder):
    path = f"{_run_folder(spark)}/predictions"
    rows = prediction_projection(spark, folder)
    rows = rows.withColumn("prediction_time", F.col("prediction_time").cast("timestamp"))
    files.write_table(rows, path, "csv", mode="append")
    back = delimited.read_predictions(spark, path)
    return back.withColumn("prediction_time", F.col("prediction_time").cast("timestamp_ntz"))


def _write_submodels(spark, folder, path, gzip=False):
    line = F.concat_ws(
        ",",
        run_stamp(F.col("ts")),
        F.lit("0.5"),
        F.col("user_id").cast("string"),
        F.lit("maxDepth:5"),
        F.concat(F.lit("kind:"), "event_type"),
        F.col("value").cast("string"),
    )
    files.write_table(table(spark, folder, "events").select(line.alias("value")), path, "text", "error", gzip=gzip)


@query(oracle.SUBMODELS)
def stored_submodels(spark, folder):
    """Result lines whose parameter list holds commas, one per event, read back as a log."""
    path = f"{_run_folder(spark)}/submodels"
    _write_submodels(spark, folder, path)
    return delimited.read_submodel_log(spark, path)


def _write_run_log(spark, folder, path, gzip=False):
    """One line of the older run log per event, its numbers from the event."""
    made = {"executionTime": run_stamp(F.col("ts")), "undersampling": F.lit("0.25"), "impurity": F.col("event_type")}
    whole = {name: (F.col("event_id") + i).cast("string") for i, name in enumerate(TUNING_LOG.names)}
    given = [
        made.get(f.name, whole[f.name] if f.dataType.typeName() == "long" else F.col("value").cast("string"))
        for f in TUNING_LOG
    ]
    events = table(spark, folder, "events").where("value is not null")
    files.write_table(events.select(F.concat_ws(",", *given).alias("value")), path, "text", "error", gzip=gzip)


@query(oracle.RUN_LOG)
def stored_run_log(spark, folder):
    path = f"{_run_folder(spark)}/tuning_log"
    _write_run_log(spark, folder, path)
    return delimited.read_run_log(spark, path)


@query(oracle.txn(f'select {oracle.FEATURES}, "Class" from txn'))
def stored_test_partition(spark, folder):
    """A test partition without ids, written as CSV and read back."""
    path = f"{_run_folder(spark)}/test_partition"
    files.write_table(transactions(spark, folder).select(*FEATURES, LABEL), path, "csv")
    return delimited.read_test_partition(spark, path, with_id=False)


def _copied_run(spark, folder):
    """A run's three text tables, copied twice to where a copy shall be."""
    run = _run_folder(spark)
    rows = transactions(spark, folder).select(*FEATURES, LABEL)
    files.write_table(rows, f"{run}/a/test_partition.csv", "csv", gzip=True)
    _write_run_log(spark, folder, f"{run}/a/tuning_log.csv", gzip=True)
    _write_submodels(spark, folder, f"{run}/a/submodel_log.csv", gzip=True)
    for _ in range(2):
        files.copy_run_tables(spark, f"{run}/a", f"{run}/b", with_id=False, gzip=True)
    return f"{run}/b"


@query(oracle.twice(oracle.SUBMODELS))
def copied_submodels(spark, folder):
    """The log of copies that append."""
    return delimited.read_submodel_log(spark, f"{_copied_run(spark, folder)}/submodel_log.csv")


@query(oracle.COPIED_SIZES)
def copied_run_sizes(spark, folder):
    """Rows after two copies: logs grow, the test partition is replaced."""
    path = _copied_run(spark, folder)
    found = {
        "test_partition": delimited.read_test_partition(spark, f"{path}/test_partition.csv", with_id=False),
        "tuning_log": delimited.read_run_log(spark, f"{path}/tuning_log.csv"),
        "submodel_log": delimited.read_submodel_log(spark, f"{path}/submodel_log.csv"),
    }
    rows = [df.agg(F.lit(name).alias("name"), F.count(F.lit(1)).alias("n")) for name, df in found.items()]
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


@query(oracle.RUN_LOG_FORMAT)
def run_log_format(spark, folder):
    events = table(spark, folder, "events")
    stamp = run_stamp(F.col("ts"))
    return events.select(
        "event_id",
        stamp.alias("execution_time"),
        F.concat_ws(",", stamp, F.col("user_id"), "event_type").alias("line"),
    )


@query(oracle.LABEL_INDEX)
def label_index(spark, folder):
    events = table(spark, folder, "events").select("event_type")
    indexer = projection.label_indexer("event_type").fit(events)
    return indexer.transform(events).groupBy("event_type", "label").agg(F.count("*").alias("n"))


# --- sampling ---------------------------------------------------------------


@query(oracle.txn('select "Class", count(*) n from txn group by 1'))
def class_split_counts(spark, folder):
    return sampling.class_counts(transactions(spark, folder), LABEL)


@query(oracle.TRAIN_TEST_SPLIT)
def train_test_split(spark, folder):
    part = F.when(sampling.in_training(0.7, ID), "train").otherwise("test")
    return transactions(spark, folder).select(ID, LABEL, part.alias("part"))


@query(oracle.FOLDS)
def fold_assignment(spark, folder):
    txn = transactions(spark, folder).withColumn("fold", sampling.fold_column(ID, 5))
    return txn.groupBy("fold", LABEL).agg(F.count("*").alias("n"), F.sum(ID).alias("id_sum"))


@query(oracle.UNDERSAMPLE)
def undersample(spark, folder):
    kept = sampling.undersample(transactions(spark, folder), 0.3, LABEL, ID)
    return kept.select(ID, LABEL, AMOUNT)


@query(oracle.txn('select "ID" id, c.copy::int as copy from txn, (select unnest([1,2,3]) as copy) c where "Class" = 1'))
def replicate(spark, folder):
    return sampling.replicate(minority(spark, folder).select("id"), 3)


@query(oracle.EXACT_SAMPLE)
def exact_sample_fractional(spark, folder):
    rare = cut_lineage(minority(spark, folder).select("id"))  # read three times
    return sampling.sample_copies(rare, 1.5, "id")


@query(oracle.HASH_RANKED_EVENTS)
def exact_sample_events(spark, folder):
    events = table(spark, folder, "events").select("event_id", "event_type", "value")
    n = events.count()
    return sampling.hash_ranked(events, n // 3, "event_id", "third")


# --- nearest neighbours and oversampling -----------------------------------


@query(oracle.KNN)
def knn_topk(spark, folder):
    return knn.knn_join(minority(spark, folder), 5)


@query(oracle.KNN_VECTORS)
def knn_all_vectors(spark, folder):
    vectors = table(spark, folder, "embeddings").select(
        F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("features")
    )
    return knn.knn_join(vectors, 5)


@query(oracle.KNN_VECTORS)
def knn_vectors_float(spark, folder):
    """The embeddings as they are stored."""
    vectors = table(spark, folder, "embeddings")
    return knn.knn_join(vectors, 5, "vec_id", "embedding")


@query(oracle.KNN_VECTORS)
def knn_blocked(spark, folder):
    """The same in small blocks, so that many of them meet."""
    vectors = table(spark, folder, "embeddings")
    return knn.knn_join(vectors, 5, "vec_id", "embedding", block_rows=64)


@query(oracle.KNN_PICK)
def knn_neighbor_pick(spark, folder):
    lists = knn.neighbour_lists(minority(spark, folder), 5)
    picked = oversampling.pick_neighbours(sampling.replicate(lists, 3), "id")
    return picked.select(F.col("id").alias("seed_id"), "copy", "rank", "nn_id", "dist")


@query(oracle.smote(3))
def smote_synthetic(spark, folder):
    return oversampling.synthetic_rows(transactions(spark, folder), FEATURES, LABEL, ID, 3)


@query(oracle.smote(3))
def smote_blocked(spark, folder):
    """SMOTE with a neighbour search in small blocks."""
    txn = transactions(spark, folder)
    return oversampling.synthetic_rows(txn, FEATURES, LABEL, ID, 3, block_rows=32)


@query(oracle.REPEATED_IDS)
def smote_repeated_ids(spark, folder):
    """Synthetic rows of each key where every row is there twice and errors have no key."""
    txn = transactions(spark, folder)
    twice = sampling.replicate(txn, 2).withColumn(ID, F.when(F.col(ID) % 3 != 0, F.col(ID) % 1000))
    made = oversampling.synthetic_rows(twice, FEATURES, LABEL, ID, 3)
    return made.groupBy("seed_id").agg(F.count(F.lit(1)).alias("n"))


@query(oracle.fold_smote(2))
def smote_within_folds(spark, folder):
    """Synthetic rows for each held-out fold, of rows outside it only."""
    return fold_smote.fold_synthetic_rows(transactions(spark, folder), FEATURES, LABEL, ID, 2)


@query(oracle.fold_smote(1.5))
def smote_within_folds_short(spark, folder):
    """The same at a fractional rate, from lists so short that most must be completed."""
    txn = transactions(spark, folder)
    return fold_smote.fold_synthetic_rows(txn, FEATURES, LABEL, ID, 1.5, length=5)


@query(oracle.FOLD_COUNTS)
def fold_class_counts(spark, folder):
    """Classes in each fold of a sweep's rebalanced training rows."""
    train, _ = sampling.train_test_split(transactions(spark, folder), 0.7, ID)
    ready = tuning.rebalance(train, 3, 0.3)
    return ready.groupBy(tuning.FOLD, LABEL).agg(F.count(F.lit(1)).alias("n"))


@query(oracle.smote(2, mode="extrapolate"))
def smote_extrapolate(spark, folder):
    txn = transactions(spark, folder)
    return oversampling.synthetic_rows(txn, FEATURES, LABEL, ID, 2, mode="extrapolate")


@query(oracle.smote(1.5))
def smote_fractional(spark, folder):
    return oversampling.synthetic_rows(transactions(spark, folder), FEATURES, LABEL, ID, 1.5)


@query(oracle.smote(0.5))
def smote_below_one(spark, folder):
    return oversampling.synthetic_rows(transactions(spark, folder), FEATURES, LABEL, ID, 0.5)


@query(oracle.smote(2, seconds=True))
def smote_with_seconds(spark, folder):
    return oversampling.synthetic_rows(
        transactions(spark, folder), feature_cols(True), LABEL, ID, 2
    )


@query(oracle.smote(3, union=True))
def smote_full_union(spark, folder):
    return oversampling.smote(transactions(spark, folder), FEATURES, LABEL, ID, 3)


@query(oracle.BALANCED_COUNTS)
def balanced_class_counts(spark, folder):
    kept = sampling.undersample(transactions(spark, folder), 0.3, LABEL, ID)
    full = oversampling.smote(kept, FEATURES, LABEL, ID, 3)
    return sampling.class_counts(full, LABEL)


# --- evaluation ---------------------------------------------------------------


@query(oracle.CONFUSION)
def confusion_matrix(spark, folder):
    return metrics.confusion(rule_scores(spark, folder))


@query(oracle.RATIOS)
def classification_ratios(spark, folder):
    return metrics.with_ratios(metrics.confusion(rule_scores(spark, folder)))


@query(oracle.areas("rule", "prediction"))
def curve_areas_hard(spark, folder):
    return _rounded(metrics.curve_areas(rule_scores(spark, folder), "prediction"))


@query(oracle.areas("rule", "score"))
def curve_areas_graded(spark, folder):
    return _rounded(metrics.curve_areas(rule_scores(spark, folder), "score"))


@query(oracle.areas("docs", "prediction"))
def curve_areas_documents_hard(spark, folder):
    return _rounded(metrics.curve_areas(document_scores(spark, folder), "prediction"))


@query(oracle.areas("docs", "score"))
def curve_areas_documents_graded(spark, folder):
    return _rounded(metrics.curve_areas(document_scores(spark, folder), "score"))


@query(oracle.EVALUATION)
def evaluation_report(spark, folder):
    row = metrics.evaluation(rule_scores(spark, folder))
    return row.withColumns({c: F.round(c, 9) for c in ("areaUnderROC", "areaUnderPR")})


def _rounded(areas: DataFrame) -> DataFrame:
    return areas.select(*[F.round(c, 9).alias(c) for c in areas.columns])


@query(oracle.sampling_grid(SAMPLING))
def sampling_grid(spark, folder):
    """Class sizes each (over, under) setting of a sweep trains on."""
    pairs = tuning.sampling_pairs([o for o, _ in SAMPLING], [u for _, u in SAMPLING])
    train, _ = sampling.train_test_split(transactions(spark, folder), 0.7, ID)
    train = cut_lineage(train.select(ID, LABEL))
    out = None
    for ordinal, (over, under) in enumerate(pairs):
        kept = sampling.undersample(train, under, LABEL, ID, seed=11)
        rare = kept.where(F.col(LABEL) == 1)
        copies = sampling.sample_copies(rare.select(ID), over, ID, seed=11)
        classes = kept.select(LABEL).unionByName(copies.select(F.lit(1).alias(LABEL)))
        row = classes.agg(
            F.lit(ordinal).alias("ordinal"),
            F.lit(over).alias("oversampling"),
            F.lit(under).alias("undersampling"),
            F.count_if(F.col(LABEL) == 0).alias("negatives"),
            F.count_if(F.col(LABEL) == 1).alias("positives"),
        )
        out = row if out is None else out.unionByName(row)
    return out


@query(oracle.best_config(THRESHOLDS))
def best_config(spark, folder):
    """The rule threshold with the best accuracy; the first of equals."""
    scores = rule_scores(spark, folder)
    tried = {t: (F.col("score") > t).cast("double") for t in THRESHOLDS}
    counts = metrics.confusion_of_each(scores, tried, "threshold")
    ratios = metrics.with_ratios(counts).select("ordinal", "threshold", "accuracy")
    return metrics.best_of(ratios, "accuracy", "ordinal")


@query(oracle.THROUGHPUT)
def throughput_5s(spark, folder):
    return throughput(table(spark, folder, "events").select("ts"), "ts")


# --- messages and streams -----------------------------------------------------


@query(oracle.publish(2))
def keyed_publish_rows(spark, folder):
    sends = publish.keyed_sends(transactions(spark, folder), cycles=2)
    return sends.select("uuid", "id", "cycle", AMOUNT, LABEL)


@query(oracle.round_trip())
def message_round_trip(spark, folder):
    sent = publish.messages(publish.keyed_sends(transactions(spark, folder)), with_seconds=True)
    return scoring.decode_messages(sent, with_seconds=True)


@query(oracle.SEND_LOG)
def send_log(spark, folder):
    """The send log; its times are checked for what they can be."""
    sent = publish.messages(publish.keyed_sends(transactions(spark, folder)))
    log = publish.send_log(sent)
    now = F.unix_millis(F.current_timestamp())
    ok = F.col("time").between(now - 86_400_000, now + 86_400_000)
    return log.select("uuid", "id", ok.alias("time_ok"))


@query(oracle.UUID_FROM_KEY)
def uuid_from_key(spark, folder):
    """Messages whose uuid is taken from the key."""
    sent = publish.messages(publish.keyed_sends(transactions(spark, folder)))
    return scoring.decode_messages(sent, uuid_from_key=True).select("uuid", "id")


@query(oracle.round_trip())
def stream_decoded(spark, folder):
    """Publish the transactions as messages, then decode them as a stream."""
    run = _run_folder(spark)
    sent = publish.messages(publish.keyed_sends(transactions(spark, folder)), with_seconds=True)
    publish.to_files(sent, f"{run}/messages")
    rows = scoring.decode_messages(messages.file_messages(spark, f"{run}/messages"), True)
    writer = rows.writeStream.format("parquet").option("path", f"{run}/rows")
    writer = writer.option("checkpointLocation", f"{run}/checkpoint")
    writer.trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(rows.schema).parquet(f"{run}/rows")


@query(oracle.LINEAGE)
def stream_with_lineage(spark, folder):
    """Messages decoded with the topic, partition and offset that each came from."""
    run = _run_folder(spark)
    sent = publish.messages(publish.keyed_sends(transactions(spark, folder)))
    sent.select(
        "key", "value", F.lit("transactions").alias("topic"), (F.col("id") % 3).cast("int").alias("partition"),
        F.floor(F.col("id") / 3).cast("long").alias("offset"),
    ).write.parquet(f"{run}/messages")
    schema = "key string, value binary, topic string, partition int, offset long"
    stream = spark.readStream.schema(schema).parquet(f"{run}/messages")
    rows = scoring.decode_messages(stream, keep=("topic", "partition", "offset"))
    rows = rows.select("uuid", "id", "topic", "partition", "offset")
    writer = rows.writeStream.format("parquet").option("path", f"{run}/rows")
    writer.option("checkpointLocation", f"{run}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(rows.schema).parquet(f"{run}/rows")


@query(oracle.THROUGHPUT)
def stream_throughput_5s(spark, folder):
    """All windows of a stream at its end, from the updates it stored."""
    run = _run_folder(spark)
    events = stream_table(spark, folder, "events")
    stamped = events.select(F.col("ts").cast("timestamp").alias("ts"))
    windows.throughput_updates(
        stamped, "ts", f"{run}/windows", f"{run}/checkpoint", available_now=True
    ).awaitTermination()
    out = windows.latest_windows(spark, f"{run}/windows")
    return out.withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


def _sends_and_predictions(spark, folder):
    """Sends and predictions of the transactions: some are never predicted, some too late,
    some were never logged as sent; and a heartbeat a day after the last of each."""
    txn = transactions(spark, folder, extra=("ts",))
    uuid = keyed_uuid("send", 1, F.col(ID), F.lit(1)).alias("uuid")
    delay = F.when(F.col(ID) % 97 == 0, F.lit(3600)).otherwise(F.col(ID) % 7 * 20 + 1)
    at = F.col("ts").cast("timestamp")
    sends = txn.where(F.col(ID) % 11 != 5).select(uuid, at.alias("sent_at"))
    found = txn.where(F.col(ID) % 10 != 3).select(
        uuid, F.timestamp_seconds(F.unix_seconds(at) + delay).alias("predicted_at")
    )
    end = txn.select((F.max(at) + F.expr("interval 1 day")).alias("end"))
    beat = lambda name: end.select(F.lit(None).cast("string").alias("uuid"), F.col("end").alias(name))
    return sends, found, beat("sent_at"), beat("predicted_at")


@query(oracle.LATENCY)
def send_latency_rows(spark, folder):
    """Every send and every prediction with its partner, if it has one within ten minutes."""
    sends, found, _, _ = _sends_and_predictions(spark, folder)
    return _plain_times(latency.send_latency(sends, found))


def _plain_times(rows: DataFrame) -> DataFrame:
    names = ("sent_at", "predicted_at", "window_start")
    return rows.withColumns({c: F.col(c).cast("timestamp_ntz") for c in names if c in rows.columns})


@query(oracle.LATENCY)
def stream_latency(spark, folder):
    """The same as a join of two streams; a last row far ahead moves the watermarks past all others."""
    run = _run_folder(spark)
    sends, found, last_send, last_found = _sends_and_predictions(spark, folder)
    sends.unionByName(last_send).write.parquet(f"{run}/sends")
    found.unionByName(last_found).write.parquet(f"{run}/found")
    streams = [spark.readStream.schema(df.schema).parquet(f"{run}/{n}") for df, n in ((sends, "sends"), (found, "found"))]
    rows = latency.send_latency(*streams)
    latency.store_latency(rows, f"{run}/rows", f"{run}/checkpoint", available_now=True).awaitTermination()
    return _plain_times(spark.read.schema(rows.schema).parquet(f"{run}/rows").where("uuid is not null"))


@query(oracle.LATENCY_REPORT)
def latency_by_hour(spark, folder):
    sends, found, _, _ = _sends_and_predictions(spark, folder)
    return _plain_times(latency.latency_report(latency.send_latency(sends, found)))


def _consumed(spark, folder):
    """Events as the offsets of four partitions, consumed in batches of fifty: the third batch of
    each partition is lost but for its last ten offsets, the fifth is stored twice."""
    events = table(spark, folder, "events").select("event_id")
    at = F.col("event_id")
    rows = events.select(
        F.lit("transactions").alias("topic"),
        (at % 4).cast("int").alias("partition"),
        F.floor(at / 4).cast("long").alias("offset"),
    ).withColumn("batch", F.floor(F.col("offset") / 50).cast("long"))
    kept = rows.where((F.col("batch") != 2) | (F.col("offset") % 50 >= 40))
    return rows, kept.unionByName(kept.where("batch = 4").withColumn("batch", F.lit(1004).cast("long")))


@query(oracle.OFFSET_RANGES)
def offset_ranges(spark, folder):
    _, kept = _consumed(spark, folder)
    return ledger.offset_ranges(kept)


@query(oracle.OFFSET_AUDIT)
def offset_audit(spark, folder):
    """Lost and repeated offsets, with the batches around and in them."""
    found = ledger.audit(ledger.offset_ranges(_consumed(spark, folder)[1]))
    return found.withColumn("batches", F.array_join("batches", ","))


@query(oracle.OFFSET_COVERAGE)
def offset_coverage(spark, folder):
    """For each batch as it was planned: offsets stored and lost."""
    planned, kept = (ledger.offset_ranges(df) for df in _consumed(spark, folder))
    return ledger.coverage(planned, kept)


@query(oracle.OFFSET_STREAM)
def stream_ledger(spark, folder):
    """The ledger that a stream keeps of its own batches: together they cover every offset once."""
    run = _run_folder(spark)
    _consumed(spark, folder)[0].drop("batch").repartition(6, "offset").write.parquet(f"{run}/messages")
    schema = "topic string, partition int, offset long"
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 2).parquet(f"{run}/messages")
    ledger.record_offsets(stream, f"{run}/ledger", f"{run}/checkpoint", available_now=True).awaitTermination()
    found = ledger.read_ledger(spark, f"{run}/ledger")
    covered = ledger.merge_intervals(found, ledger.SOURCE)
    twice = ledger.audit(found).where("kind = 'overlap'").groupBy(*ledger.SOURCE).agg(F.count(F.lit(1)).alias("n"))
    return covered.join(twice, ledger.SOURCE, "left").select(
        *ledger.SOURCE, "first", "last", F.coalesce("n", F.lit(0)).cast("long").alias("overlaps")
    )


@query(oracle.THROUGHPUT)
def stream_windows_late(spark, folder):
    """Windows of a stream whose last files come long after their time, late rows counted in."""
    run = _run_folder(spark)
    events = table(spark, folder, "events").select(F.col("ts").cast("timestamp").alias("ts"), "event_id")
    for part in (F.col("event_id") % 5 != 0, F.col("event_id") % 5 == 0):
        events.where(part).write.mode("append").parquet(f"{run}/events")
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(f"{run}/events")
    windows.throughput_with_late(stream, "ts", f"{run}/w", f"{run}/checkpoint", available_now=True).awaitTermination()
    found = windows.windows_with_late(spark, f"{run}/w").drop("late")
    return found.withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


@query(oracle.RUNNING)
def running_evaluation(spark, folder):
    """Counts of a prediction stream as it runs; the exact areas must lie within their bounds."""
    run = _run_folder(spark)
    rows = rule_scores(spark, folder)
    rows.repartition(4, "id").write.parquet(f"{run}/scores")
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{run}/scores")
    tallies = running.score_tallies(stream, 0.0, 1000.0, 256)
    running.store_tallies(tallies, f"{run}/tallies", f"{run}/checkpoint", available_now=True).awaitTermination()
    found = running.running_report(running.latest_tallies(spark, f"{run}/tallies"))
    exact = metrics.curve_areas(rows, "score").select(F.struct("*")).scalar()
    inside = lambda c: F.col(f"exact.{c}").between(F.col(f"{c}_low") - 1e-12, F.col(f"{c}_high") + 1e-12)
    narrow = lambda c: F.col(f"{c}_high") - F.col(f"{c}_low") < 0.1
    areas = ("areaUnderROC", "areaUnderPR")
    return found.withColumn("exact", exact).select(
        "tn", "fp", "fn", "tp", "accuracy", "precision", "sensitivity", "specificity", "fpr",
        *[inside(c).alias(f"{c}_inside") for c in areas], narrow("areaUnderROC").alias("areaUnderROC_narrow"),
    )


# --- models -------------------------------------------------------------------


def _forest(train: DataFrame):
    stages, forest = tuning.forest_stages(train)
    forest.setNumTrees(10).setMaxDepth(5)
    return stages.fit(train)


def _fitted(spark: SparkSession, folder: str):
    train, test = sampling.train_test_split(transactions(spark, folder), 0.7, ID)
    ready = tuning.assemble(tuning.rebalance(train, 3, 0.3)).select(LABEL, "features")
    return _forest(cut_lineage(ready)), test


def _checked(predictions: DataFrame) -> DataFrame:
    """Exact id and label; a forest's own output is checked for what it can be."""
    hard = F.col("prediction").isin(0.0, 1.0)
    return predictions.select(
        "id", F.col("label").cast("double").alias("label"), hard.alias("prediction_ok"),
        (F.col("predictedLabel").cast("double") == F.col("prediction")).alias("label_ok"),
    )


@query(oracle.HELD_OUT_CHECKED)
def forest_scores(spark, folder):
    """Held-out transactions scored by a forest trained on the rebalanced rest."""
    model, test = _fitted(spark, folder)
    scored = model.transform(tuning.assemble(test))
    return _checked(scored.select(F.col(ID).alias("id"), "label", "prediction", "predictedLabel"))


@query(oracle.HELD_OUT_STAMPED)
def score_stamped(spark, folder):
    """The same as prediction rows; arrival is not after prediction."""
    model, test = _fitted(spark, folder)
    scored = scoring.score(publish.keyed_sends(test), model)
    in_time = F.col("incoming_time") <= F.unix_millis("prediction_time")
    return _checked(scored.withColumn("in_time", in_time)).join(
        scored.select("id", "uuid", in_time.alias("time_ok")), "id"
    )


def _published(spark: SparkSession, folder: str):
    run = _run_folder(spark)
    model, test = _fitted(spark, folder)
    publish.to_files(publish.messages(publish.keyed_sends(test)), f"{run}/messages")
    rows = scoring.decode_messages(messages.file_messages(spark, f"{run}/messages"))
    return run, model, rows


@query(oracle.HELD_OUT_CHECKED)
def stream_scored(spark, folder):
    """Held-out transactions published as messages and scored as a stream."""
    run, model, rows = _published(spark, folder)
    scoring.score_stream(
        rows, model, f"{run}/predictions", f"{run}/checkpoint", available_now=True
    ).awaitTermination()
    return _checked(delimited.read_predictions(spark, f"{run}/predictions"))


@query(oracle.SENT_TWICE)
def stream_sent_twice(spark, folder):
    """Held-out transactions of which a third is sent again and a seventh a third time, over several
    micro-batches: each is scored once."""
    run = _run_folder(spark)
    model, test = _fitted(spark, folder)
    sent = cut_lineage(publish.messages(publish.keyed_sends(test)))
    for again, later in ((F.lit(True), 0), (F.col("id") % 3 == 0, 60_000), (F.col("id") % 7 == 0, 120_000)):
        publish.to_files(sent.where(again).withColumn("time", F.col("time") + later), f"{run}/messages")
    stream = scoring.sent_once(messages.file_messages(spark, f"{run}/messages", max_files=2))
    scoring.score_stream(
        scoring.decode_messages(stream), model, f"{run}/predictions", f"{run}/checkpoint", available_now=True
    ).awaitTermination()
    found = delimited.read_predictions(spark, f"{run}/predictions")
    return _checked(found).join(found.select("id", "uuid"), "id")


@query(oracle.HELD_OUT_CHECKED)
def scored_batches(spark, folder):
    """The same by micro-batches, each in a folder of its own."""
    run, model, rows = _published(spark, folder)
    scoring.score_batches(
        rows, model, f"{run}/predictions", f"{run}/checkpoint", fmt="parquet", available_now=True
    ).awaitTermination()
    return _checked(delimited.read_predictions(spark, f"{run}/predictions", "parquet"))


@query(oracle.HELD_OUT_CHECKED)
def stream_at_interval(spark, folder):
    """The same at a fixed interval until nothing is left; a micro-batch without rows stores nothing."""
    run, model, rows = _published(spark, folder)
    none = spark.read.schema(messages.FILE_SCHEMA).parquet(f"{run}/messages").limit(0)
    publish.to_files(none, f"{run}/messages")
    query = scoring.score_batches(
        rows, model, f"{run}/predictions", f"{run}/checkpoint", fmt="parquet", every=scoring.batch_interval(500, "ms")
    )
    try:
        query.processAllAvailable()
    finally:
        query.stop()
    return _checked(delimited.read_predictions(spark, f"{run}/predictions", "parquet"))


def _small_sweep(spark, folder):
    run = _run_folder(spark)
    grid = tuning.ForestGrid(num_trees=[5], max_depth=[4])
    txn = transactions(spark, folder)
    tuning.sweep(txn, [2], [0.3], grid, folds=2, log_folder=run, model_path=f"{run}/model")
    return run


@query(oracle.HELD_OUT_CHECKED)
def stored_model_scores(spark, folder):
    """Held-out transactions scored by a sweep's model, saved and loaded again."""
    run = _small_sweep(spark, folder)
    test = delimited.read_test_partition(spark, f"{run}/test_partition", fmt="parquet")
    scored = scoring.load_model(f"{run}/model").transform(tuning.assemble(test))
    return _checked(scored.select(F.col(ID).alias("id"), "label", "prediction", "predictedLabel"))


@query(oracle.SWEEP_REPORT)
def sweep_report(spark, folder):
    """The report row of a sweep; its counts must be those of the held-out rows, its ratios follow
    from them, and the forest must be better than chance, where there is a positive to tell by."""
    run = _small_sweep(spark, folder)
    row = delimited.read_run_log(spark, f"{run}/tuning_log", "parquet")
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    near = lambda a, b: F.abs(F.coalesce(a - F.try_divide(*b), F.lit(0.0))) < 1e-12
    share = (tp + fn) / (tp + fp + fn + tn)
    return row.select(
        "numWorkerNodes", "undersampling", "oversampling", "numTrees", "maxDepth", "impurity", "param2", "param15",
        (tp + fn).cast("long").alias("positives"), (fp + tn).cast("long").alias("negatives"),
        (near(F.col("precision"), (tp, tp + fp)) & near(F.col("sensitivity"), (tp, tp + fn))
         & near(F.col("specificity"), (tn, tn + fp)) & near(F.col("fpr"), (fp, tn + fp))).alias("ratios_ok"),
        F.when(tp + fn == 0, F.col("areaUnderPR").isNull())
        .otherwise((F.col("areaUnderPR") > share) & (F.col("areaunderPRCV") > share)).alias("better_than_chance"),
    )


@query(oracle.SWEEP)
def cv_sweep(spark, folder):
    """Grid points of a sweep over two sampling settings and two forests, from its stored log;
    the metrics are checked to be shares."""
    grid = tuning.ForestGrid(num_trees=[5, 10], max_depth=[5], impurity=["entropy"])
    run = _run_folder(spark)
    tuning.sweep(
        transactions(spark, folder), [2, 1.5], [0.3, 0.1], grid, parallelism=4, log_folder=run
    )
    found = delimited.read_submodel_log(spark, f"{run}/submodel_log", "parquet")
    return found.select(
        "oversampling", "undersampling", F.col("params")["numTrees"].alias("num_trees"),
        F.col("params")["maxDepth"].alias("max_depth"), F.col("params")["impurity"].alias("impurity"),
        F.col("metric").between(0, 1).alias("metric_ok"),
    )


@query(oracle.SWEEP_WITHIN)
def cv_sweep_within_folds(spark, folder):
    """The same with every fold resampled apart; its forests must do better than chance."""
    grid = tuning.ForestGrid(num_trees=[5], max_depth=[4, 6], impurity=["gini"])
    run = _run_folder(spark)
    tuning.sweep(
        transactions(spark, folder), [2], [0.3], grid, folds=3, parallelism=4, log_folder=run, within_folds=True
    )
    found = delimited.read_submodel_log(spark, f"{run}/submodel_log", "parquet")
    chance = transactions(spark, folder).select(F.avg(LABEL)).scalar()
    return found.select(
        "oversampling", "undersampling", F.col("params")["maxDepth"].alias("max_depth"),
        F.col("metric").between(chance, 1).alias("better_than_chance"),
    )
