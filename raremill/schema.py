"""Schemas of transactions, predictions and run logs."""

from __future__ import annotations

from pyspark.sql import types as T

ID = "ID"
SECONDS = "NumericSecondDay"
LABEL = "Class"
COMPONENTS = [f"V{i}" for i in range(1, 29)]
AMOUNT = "Amount"


def feature_cols(with_seconds: bool = False) -> list[str]:
    """The 29 model features, or 30 with the second of the day in front."""
    return ([SECONDS] if with_seconds else []) + COMPONENTS + [AMOUNT]


def txn_schema(
    with_seconds: bool = False,
    with_id: bool = True,
    with_uuid: bool = False,
    label_first: bool = False,
    id_name: str = ID,
) -> T.StructType:
    """Every variant of the labelled transaction row."""
    label = T.StructField(LABEL, T.IntegerType(), False)
    fields = [label] if label_first else []
    if with_uuid:
        fields.append(T.StructField("uuid", T.StringType()))
    if with_id:
        fields.append(T.StructField(id_name, T.LongType()))
    for name in feature_cols(with_seconds):
        kind = T.IntegerType() if name == SECONDS else T.DoubleType()
        fields.append(T.StructField(name, kind))
    if not label_first:
        fields.append(label)
    return T.StructType(fields)


def oversampled_schema(with_seconds: bool = False) -> T.StructType:
    return txn_schema(with_seconds, with_id=False, label_first=True)


def message_schema(with_seconds: bool = False, with_uuid: bool = True) -> T.StructType:
    return txn_schema(with_seconds, with_uuid=with_uuid, id_name="id")


PREDICTIONS = T.StructType(
    [
        T.StructField("uuid", T.StringType()),
        T.StructField("id", T.LongType()),
        T.StructField("prediction", T.DoubleType()),
        T.StructField("predictedLabel", T.DoubleType()),
        T.StructField("label", T.DoubleType()),
        T.StructField("incoming_time", T.LongType()),
        T.StructField("prediction_time", T.TimestampType()),
    ]
)

SEND_LOG = T.StructType(
    [
        T.StructField("uuid", T.StringType()),
        T.StructField("id", T.LongType()),
        T.StructField("time", T.LongType()),
    ]
)

METRIC_NAMES = [
    "tp", "fp", "fn", "tn", "accuracy", "precision", "sensitivity", "specificity",
    "areaUnderROC", "areaUnderPR",
]

METRICS_LOG = T.StructType([T.StructField(n, T.DoubleType()) for n in METRIC_NAMES])

SUBMODEL_LOG = T.StructType(
    [
        T.StructField("executionTime", T.StringType()),
        T.StructField("undersampling", T.DoubleType()),
        T.StructField("oversampling", T.LongType()),
        T.StructField("params", T.StringType()),
        T.StructField("metric", T.DoubleType()),
    ]
)

# Names and types of the tuning log, in file order.
_TUNING_FIELDS = [
    ("executionTime", T.StringType()),
    ("numWorkerNodes", T.LongType()),
    ("undersampling", T.DoubleType()),
    ("oversampling", T.LongType()),
    ("numTrees", T.LongType()),
    ("maxDepth", T.LongType()),
    ("maxBins", T.LongType()),
    ("impurity", T.StringType()),
    ("featureSubsetStrategy", T.StringType()),
    ("minInstancesPerNode", T.LongType()),
    *[(name, T.DoubleType()) for name in METRIC_NAMES],
    ("areaunderPRCV", T.DoubleType()),
    *[(f"param{i}", T.StringType()) for i in (2, 3, 7, 8, 9, 10, 11, 12, 13, 14, 15)],
]

TUNING_LOG = T.StructType([T.StructField(n, t) for n, t in _TUNING_FIELDS])

# Our own logs. Rates may be fractions. Older logs hold the false-positive rate under the
# name "specificity"; reports carry both, each under its proper name.
REPORT = T.StructType(
    [
        *(T.StructField(f.name, T.DoubleType()) if f.name == "oversampling" else f for f in TUNING_LOG),
        T.StructField("fpr", T.DoubleType()),
    ]
)

SUBMODELS = T.StructType(
    [
        T.StructField("executionTime", T.StringType()),
        T.StructField("undersampling", T.DoubleType()),
        T.StructField("oversampling", T.DoubleType()),
        T.StructField("params", T.MapType(T.StringType(), T.StringType())),
        T.StructField("metric", T.DoubleType()),
    ]
)
