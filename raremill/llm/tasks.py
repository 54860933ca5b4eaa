"""Small helpers shared by the operators: Arrow tasks and stored tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from raremill.session import shared_folder

#: Rows handed to a function at once inside a task.
ROWS = 256
#: Rows that Spark sends to a task's Python side at once; texts and sets are long rows.
_SENT = "spark.sql.execution.arrow.maxRecordsPerBatch"
_MOST_SENT = 1024


def map_rows(df: DataFrame, make: Callable[[], Callable], schema: str, rows: int = ROWS) -> DataFrame:
    """Run ``make()`` once per task and the function it returns on each slice of at
    most ``rows`` rows; the function maps a RecordBatch to a RecordBatch or None."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = make()
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                out = step(batch.slice(at, rows))
                if out is not None and out.num_rows:
                    yield out
        pa.default_memory_pool().release_unused()

    conf = df.sparkSession.conf
    if not 0 < int(conf.get(_SENT)) <= _MOST_SENT:
        conf.set(_SENT, str(_MOST_SENT))
    return df.mapInArrow(task, schema)


def int_lists(values, lengths, kind=pa.int32()) -> pa.ListArray:
    """Flat ``values`` cut into lists of ``lengths``."""
    import numpy as np

    offsets = np.zeros(len(lengths) + 1, np.int64)
    np.cumsum(lengths, out=offsets[1:])
    if offsets[-1] > np.iinfo(np.int32).max:
        raise OverflowError("more values than the lists of one batch can hold; use smaller slices")
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, kind))


def new_folder(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that no other run uses."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str, compression: str | None = None) -> DataFrame:
    """``df`` written to the shared folder as Parquet and read back with its schema."""
    spark, path = df.sparkSession, new_folder(df.sparkSession, name)
    df.write.parquet(path, compression=compression)
    return spark.read.schema(df.schema).parquet(path)
