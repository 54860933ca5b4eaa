"""Avro binary transactions as Arrow column functions.

A message is one Avro record: [uuid string,] id long, [second-of-day int,] 29
doubles, class int, in that order and without nulls. Where the Avro connector is
on the class path pass ``connector=True`` to stay on the JVM; the functions here
need only Arrow and work on whole column batches, never row by row.
"""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from raremill.schema import AMOUNT, COMPONENTS, LABEL, SECONDS, message_schema

_DOUBLES = [*COMPONENTS, AMOUNT]
_DOUBLE_BYTES = 8 * len(_DOUBLES)
_AVRO_TYPES = {"string": "string", "bigint": "long", "int": "int", "double": "double"}


def avro_schema(with_seconds: bool = False, with_uuid: bool = True) -> str:
    """The record's Avro schema, for the connector and for other producers."""
    fields = [
        {"name": f.name, "type": _AVRO_TYPES[f.dataType.simpleString()]}
        for f in message_schema(with_seconds, with_uuid)
    ]
    return json.dumps({"type": "record", "name": "transaction", "fields": fields})


def decode(
    value: Column | str,
    with_seconds: bool = False,
    with_uuid: bool = True,
    permissive: bool = False,
    connector: bool = False,
) -> Column:
    """Binary message to struct. A message that does not fit fails the query, or is
    null when ``permissive``."""
    if connector:
        from pyspark.sql.avro.functions import from_avro

        mode = "PERMISSIVE" if permissive else "FAILFAST"
        return from_avro(value, avro_schema(with_seconds, with_uuid), {"mode": mode})

    return decoder(with_seconds, with_uuid, permissive)(value)


def decoder(with_seconds: bool = False, with_uuid: bool = True, permissive: bool = False):
    """The decoding function itself, for columns or to register under a SQL name."""

    @F.arrow_udf(_nullable(message_schema(with_seconds, with_uuid)))
    def read(messages: pa.Array) -> pa.Array:
        return decode_batch(messages, with_seconds, with_uuid, permissive)

    return read


def register_decoder(
    spark: SparkSession, name: str = "deserialize", with_seconds: bool = False, with_uuid: bool = True
) -> None:
    """Make ``name(value)`` available to SQL expressions."""
    spark.udf.register(name, decoder(with_seconds, with_uuid))


def encode(with_seconds: bool = False, with_uuid: bool = True, connector: bool = False) -> Column:
    """The row's message columns, taken by name, to one binary message."""
    schema = message_schema(with_seconds, with_uuid)
    row = F.struct(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema])
    if connector:
        from pyspark.sql.avro.functions import to_avro

        return to_avro(row, avro_schema(with_seconds, with_uuid))

    @F.arrow_udf(T.BinaryType())
    def write(rows: pa.Array) -> pa.Array:
        return encode_batch(rows, with_seconds, with_uuid)

    return write(row)


def _nullable(schema: T.StructType) -> T.StructType:
    return T.StructType([T.StructField(f.name, f.dataType) for f in schema])


class _Cursor:
    """One read position per message, moved through a shared byte buffer."""

    def __init__(self, messages: pa.Array):
        width = np.int64 if pa.types.is_large_binary(messages.type) else np.int32
        _, offsets, data = messages.buffers()
        at = np.frombuffer(offsets, width)[messages.offset : messages.offset + len(messages) + 1]
        raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
        # room to read past the end of a short last message before it is rejected
        self.bytes = np.concatenate([raw, np.zeros(_DOUBLE_BYTES + 16, np.uint8)])
        self.pos = at[:-1].astype(np.int64)
        self.end = at[1:].astype(np.int64)
        self.bad = np.zeros(len(messages), bool)

    def number(self) -> np.ndarray:
        """A zigzag variable-length integer of each message."""
        total = np.zeros(len(self.pos), np.uint64)
        open_ = ~self.bad
        for shift in range(0, 70, 7):
            byte = self.bytes[self.pos[open_]]
            total[open_] |= (byte & 0x7F).astype(np.uint64) << np.uint64(shift)
            self.pos[open_] += 1
            open_[open_] = byte >= 0x80
            if not open_.any():
                break
        self._reject(open_ | (self.pos > self.end))
        return (total >> np.uint64(1)).astype(np.int64) ^ -(total & np.uint64(1)).astype(np.int64)

    def text(self) -> pa.Array:
        size = self.number()
        self._reject((size < 0) | (size > self.end - self.pos))
        size = np.where(self.bad, 0, size)
        ends = np.cumsum(size)
        starts = ends - size
        index = np.repeat(self.pos - starts, size) + np.arange(ends[-1] if len(ends) else 0)
        offsets = np.concatenate([[0], ends]).astype(np.int32)
        self.pos += size
        return pa.StringArray.from_buffers(
            len(size), pa.py_buffer(offsets.tobytes()), pa.py_buffer(self.bytes[index].tobytes())
        )

    def doubles(self) -> np.ndarray:
        self._reject(self.pos + _DOUBLE_BYTES > self.end)
        start = np.where(self.bad, 0, self.pos)
        block = self.bytes[start[:, None] + np.arange(_DOUBLE_BYTES)]
        self.pos += np.where(self.bad, 0, _DOUBLE_BYTES)
        return np.ascontiguousarray(block).view("<f8")

    def finish(self) -> np.ndarray:
        self._reject(self.pos != self.end)
        return self.bad

    def _reject(self, rows: np.ndarray) -> None:
        self.bad |= rows


def decode_batch(
    messages: pa.Array, with_seconds: bool, with_uuid: bool, permissive: bool
) -> pa.StructArray:
    missing = np.asarray(messages.is_null())
    cursor = _Cursor(messages)
    cursor.bad |= missing
    columns, names = [], []
    if with_uuid:
        columns.append(cursor.text())
        names.append("uuid")
    columns.append(pa.array(cursor.number()))
    names.append("id")
    if with_seconds:
        columns.append(pa.array(cursor.number().astype(np.int32)))
        names.append(SECONDS)
    values = cursor.doubles()
    columns += [pa.array(np.ascontiguousarray(values[:, i])) for i in range(len(_DOUBLES))]
    names += _DOUBLES
    columns.append(pa.array(cursor.number().astype(np.int32)))
    names.append(LABEL)
    bad = cursor.finish()
    if not permissive and (bad & ~missing).any():
        raise ValueError(f"{int((bad & ~missing).sum())} malformed transaction messages in a batch")
    return pa.StructArray.from_arrays(columns, names=names, mask=pa.array(bad))


def encode_batch(rows: pa.StructArray, with_seconds: bool, with_uuid: bool) -> pa.Array:
    parts = []
    if with_uuid:
        parts += _text_bytes(_whole(rows, "uuid"))
    parts.append(_number_bytes(_whole(rows, "id")))
    if with_seconds:
        parts.append(_number_bytes(_whole(rows, SECONDS)))
    doubles = np.column_stack([_floats(_whole(rows, n)) for n in _DOUBLES]).astype("<f8")
    flat = np.ascontiguousarray(doubles).view(np.uint8).reshape(len(rows), _DOUBLE_BYTES)
    parts.append((flat, np.full(len(rows), _DOUBLE_BYTES)))
    parts.append(_number_bytes(_whole(rows, LABEL)))
    used = [np.arange(block.shape[1])[None, :] < size[:, None] for block, size in parts]
    data = np.hstack([block for block, _ in parts])[np.hstack(used)]
    offsets = np.concatenate([[0], np.cumsum(sum(size for _, size in parts))]).astype(np.int32)
    return pa.BinaryArray.from_buffers(
        pa.binary(), len(rows), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(data.tobytes())]
    )


def _whole(rows: pa.StructArray, name: str) -> pa.Array:
    column = rows.field(name)
    if column.null_count:
        raise ValueError(f"a transaction without {name} cannot be sent")
    return column


def _floats(column: pa.Array) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False)


def _number_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    signed = column.to_numpy(zero_copy_only=False).astype(np.int64)
    return _zigzag(signed)


def _zigzag(signed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    left = ((signed << np.int64(1)) ^ (signed >> np.int64(63))).astype(np.uint64)
    block = np.zeros((len(signed), 10), np.uint8)
    size = np.ones(len(signed), np.int64)
    for i in range(10):
        block[:, i] = (left & np.uint64(0x7F)).astype(np.uint8)
        left = left >> np.uint64(7)
        more = left > 0
        block[more, i] |= 0x80
        size[more] += 1
    return block, size


def _text_bytes(column: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    binary = column.cast(pa.large_binary())
    _, offsets, data = binary.buffers()
    at = np.frombuffer(offsets, np.int64)[binary.offset : binary.offset + len(binary) + 1]
    size = np.diff(at)
    block = np.zeros((len(size), int(size.max(initial=0))), np.uint8)
    if block.size:
        block[np.arange(block.shape[1])[None, :] < size[:, None]] = np.frombuffer(data, np.uint8)[
            at[0] : at[-1]
        ]
    return [_zigzag(size), (block, size)]
