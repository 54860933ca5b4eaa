"""Delimited text: labelled lines, strict rows and lenient rows.

Strict reading does not lean on a reader mode. ``DROPMALFORMED`` looks only at
the columns a query asks for, so its row count changes with the projection;
here a row is kept when it has the right number of fields and all of them cast.
"""

from __future__ import annotations

import functools
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from raremill.schema import (
    ID, PREDICTIONS, REPORT, SUBMODEL_LOG, SUBMODELS, TUNING_LOG, oversampled_schema, txn_schema,
)
from raremill.sources.numbered import NUMBER, numbered_lines


def fields(line: Column, delimiter: str = ",") -> Column:
    return F.split(line, re.escape(delimiter))


def labelled_lines(
    df: DataFrame,
    n_features: int,
    delimiter: str = ",",
    label: float = 1.0,
    line: str = "value",
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """Lines ``label<d>f1<d>...`` with the wanted label as (label, features), the
    first ``n_features`` only. ``keep`` passes key columns through."""
    parts = fields(F.col(line), delimiter)
    number = parts[0].cast("double")
    values = F.transform(F.slice(parts, 2, n_features), lambda s: s.cast("double"))
    return (
        df.select(*keep, number.alias("label"), values.alias("features"))
        .where(F.col("label") == label)
    )


def read_labelled_text(
    spark: SparkSession, path: str, n_features: int, delimiter: str = ",", label: float = 1.0
) -> DataFrame:
    return labelled_lines(spark.read.text(path), n_features, delimiter, label)


def not_blank(line: str = "value") -> Column:
    """Lines with a character other than white space; blank ones are no rows in any table."""
    return F.trim(F.regexp_replace(line, r"\s", "")) != ""


def text_lines(spark: SparkSession, path: str) -> DataFrame:
    """The lines of delimited files; files of another format raise."""
    lines = spark.read.text(path)
    first = lines.head(1)
    if first and first[0].value.startswith(("PAR1", "ORC", "Obj\x01")):
        raise ValueError(f"{path} holds no delimited text")
    return lines.where(not_blank())


def stored_rows(spark: SparkSession, path: str, schema: T.StructType, fmt: str) -> DataFrame:
    """A stored table of another format than text; a missing column raises."""
    found = spark.read.format(fmt).load(path)
    missing = [n for n in schema.names if n not in found.columns]
    if missing:
        raise ValueError(f"{path} has no column {', '.join(missing)}")
    return found.select([F.col(f.name).cast(f.dataType) for f in schema])


def strict_rows(
    df: DataFrame,
    schema: T.StructType,
    delimiter: str = ",",
    line: str = "value",
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """Typed rows of the lines that fit ``schema``; the others are dropped.

    An empty field is null, which only a nullable column accepts. Header lines do
    not fit and drop out like any other; blank lines are no rows.
    """
    df = df.where(not_blank(line))
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
    options = {"sep": delimiter, "mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}
    # a generator keeps each line parsed once: a filter is not pushed through it
    parsed = df.select(*keep, F.inline(F.array(F.from_csv(line, f"{ddl}, `_bad` string", options))))
    fits = F.col("_bad").isNull()
    for f in schema:
        if not f.nullable:
            fits = fits & F.col(f.name).isNotNull()
    return parsed.where(fits).select(*keep, *schema.names)


_END = "\u0002"
REASONS = ("few_fields", "many_fields", "bad_value", "missing_value", "malformed")


def judged_rows(
    df: DataFrame,
    schema: T.StructType,
    delimiter: str = ",",
    line: str = "value",
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """Every line that is not blank, once: the typed row where ``strict_rows`` would keep it; where it would
    not, the line, the reason and the first column at fault.

    Adds ``reason`` (null: kept), ``column`` and ``rejected`` (the line) before the columns of the
    schema, which are null in rejected rows. A reason is one of ``REASONS``: too few or too many fields, else
    the first field that is no value of its type, else the first empty one that must not be."""
    # a last field of our own tells how many fields there are; the reader has null for empty and missing ones
    text = ", ".join(f"`f{i}` string" for i in range(len(schema) + 1))
    marked = F.concat(F.col("_line"), F.lit(delimiter + _END))
    named = [f"_typed_{f.name}" for f in schema]
    ddl = ", ".join(f"`{n}` {f.dataType.simpleString()}" for n, f in zip(named, schema, strict=True))
    strict = {"sep": delimiter, "mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}
    rows = df.where(not_blank(line)).select(
        *keep, F.col(line).alias("_line"), F.inline(F.array(F.from_csv(line, f"{ddl}, `_bad` string", strict)))
    )
    fits = F.col("_bad").isNull()
    for name, f in zip(named, schema, strict=True):
        if not f.nullable:
            fits = fits & F.col(name).isNotNull()
    rows = rows.withColumn("_raw", F.when(~fits, F.from_csv(marked, text, {"sep": delimiter, "mode": "PERMISSIVE"})))
    raw = lambda i: F.col("_raw")[f"f{i}"]
    n = len(schema)
    empty = [F.coalesce(F.trim(raw(i)) == "", F.lit(True)) for i in range(n)]
    wrong = [F.when(~empty[i] & F.col(named[i]).isNull(), F.lit(f.name)) for i, f in enumerate(schema)]
    absent = [F.when(empty[i], F.lit(f.name)) for i, f in enumerate(schema) if not f.nullable]
    at_end = [F.coalesce(raw(i).endswith(_END), F.lit(False)) for i in range(n + 1)]
    ended = functools.reduce(lambda a, b: a | b, [a & (raw(i) == _END) for i, a in enumerate(at_end[:n])], F.lit(False))
    open_quote = functools.reduce(lambda a, b: a | b, at_end)
    few, many = ended, ~open_quote
    whole = F.coalesce(raw(n) == _END, F.lit(False))
    first_wrong, first_absent = _first(wrong), _first(absent)
    reason = (
        F.when(fits, F.lit(None)).when(few, "few_fields").when(many, "many_fields")
        .when(~whole, "malformed")
        .when(first_wrong.isNotNull(), "bad_value").when(first_absent.isNotNull(), "missing_value").otherwise("malformed")
    )
    column = F.when(~fits & whole, F.coalesce(first_wrong, first_absent))
    return rows.select(
        *keep, reason.alias("reason"), column.alias("column"), F.when(~fits, F.col("_line")).alias("rejected"),
        *[F.when(fits, F.col(name)).alias(f.name) for name, f in zip(named, schema, strict=True)],
    )


def _first(names: list[Column]) -> Column:
    return F.coalesce(*names, F.lit(None).cast("string"))


def lenient_rows(
    df: DataFrame,
    with_seconds: bool = False,
    line: str = "value",
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """Transactions of any line: an id that is no number becomes 0, any other bad or
    missing field null."""
    schema = txn_schema(with_seconds)
    parts = df.select(*keep, fields(F.col(line)).alias("_f"))
    values = []
    for i, f in enumerate(schema):
        value = F.trim(F.get("_f", F.lit(i))).try_cast(f.dataType)
        if f.name == ID:
            value = F.coalesce(value, F.lit(0).cast("long"))
        values.append(value.alias(f.name))
    return parts.select(*keep, *values)


def read_transactions(spark: SparkSession, path: str, with_seconds: bool = False) -> DataFrame:
    """Labelled transactions, with or without a header; malformed rows are dropped."""
    return strict_rows(spark.read.text(path), txn_schema(with_seconds))


def read_transactions_leniently(
    spark: SparkSession, path: str, with_seconds: bool = False, header: bool = True
) -> DataFrame:
    """Every line that is not blank as a transaction, but for the first line of each file
    if it is a header."""
    lines = _without_first_lines(spark, path) if header else text_lines(spark, path)
    return lenient_rows(lines.where(not_blank()), with_seconds)


def read_numbered_transactions(
    spark: SparkSession, path: str, with_seconds: bool = False, header: bool = True
) -> DataFrame:
    """The same rows with a unique ``number`` each, from file and position: a key for splits, folds, draws
    and messages where ids are no numbers or repeat."""
    lines = numbered_lines(spark, path, header).where(not_blank())
    return lenient_rows(lines, with_seconds, keep=(NUMBER,))


def _without_first_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines but the first of each file, whatever it says. A separator that text
    does not hold makes the CSV reader, which knows where files begin, keep lines whole."""
    options = {"header": True, "sep": "\u0001", "quote": "", "enforceSchema": True}
    return spark.read.schema("value string").options(**options).csv(path)


def read_oversampled(spark: SparkSession, path: str, with_seconds: bool = False) -> DataFrame:
    """Headerless, label-first rows of an oversampled set."""
    return strict_rows(spark.read.text(path), oversampled_schema(with_seconds))


def read_predictions(spark: SparkSession, path: str, fmt: str = "csv") -> DataFrame:
    if fmt != "csv":
        return stored_rows(spark, path, PREDICTIONS, fmt)
    return strict_rows(text_lines(spark, path), PREDICTIONS)


def read_test_partition(
    spark: SparkSession, path: str, with_seconds: bool = False, with_id: bool = True, fmt: str = "csv"
) -> DataFrame:
    schema = txn_schema(with_seconds, with_id=with_id)
    if fmt != "csv":
        return stored_rows(spark, path, schema, fmt)
    return strict_rows(text_lines(spark, path), schema)


def read_run_log(spark: SparkSession, path: str, fmt: str = "csv") -> DataFrame:
    """The text form has the older log's columns, the others the report's."""
    if fmt != "csv":
        return stored_rows(spark, path, REPORT, fmt)
    return strict_rows(text_lines(spark, path), TUNING_LOG)


def read_submodel_log(spark: SparkSession, path: str, fmt: str = "csv") -> DataFrame:
    """The text form's parameter list itself contains commas: everything between the third
    field and the last is ``params``. The other forms hold it as a map."""
    if fmt != "csv":
        return stored_rows(spark, path, SUBMODELS, fmt)
    parts = text_lines(spark, path).select(fields(F.col("value")).alias("_f"))
    n = F.size("_f")
    row = parts.where(n >= len(SUBMODEL_LOG)).select(
        F.col("_f")[0].alias("executionTime"),
        F.col("_f")[1].try_cast("double").alias("undersampling"),
        F.col("_f")[2].try_cast("long").alias("oversampling"),
        F.array_join(F.slice("_f", F.lit(4), n - 4), ",").alias("params"),
        F.element_at("_f", -1).try_cast("double").alias("metric"),
    )
    return row.where(
        F.col("undersampling").isNotNull()
        & F.col("oversampling").isNotNull()
        & F.col("metric").isNotNull()
    )
