import struct

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from raremill.functions.codec import (
    avro_schema, decode, decode_batch, encode, encode_batch, register_decoder,
)
from raremill.schema import AMOUNT, COMPONENTS, LABEL, SECONDS, message_schema

DOUBLES = [*COMPONENTS, AMOUNT]


def varint(n):
    n = (n << 1) ^ (n >> 63)
    n &= (1 << 64) - 1
    out = bytearray()
    while True:
        byte, n = n & 0x7F, n >> 7
        out.append(byte | (0x80 if n else 0))
        if not n:
            return bytes(out)


def by_hand(row, with_seconds, with_uuid=True):
    """One record after the Avro specification."""
    out = b""
    if with_uuid:
        raw = row["uuid"].encode()
        out += varint(len(raw)) + raw
    out += varint(row["id"])
    if with_seconds:
        out += varint(row[SECONDS])
    for name in DOUBLES:
        out += struct.pack("<d", row[name])
    return out + varint(row[LABEL])


def rows(n, seed=0):
    rng = np.random.default_rng(seed)
    ids = [0, -1, 1, 63, 64, -65, 2**40, -(2**63), 2**63 - 1]
    out = []
    for i in range(n):
        row = {"uuid": "u" * (i % 40) + "é" * (i % 3), "id": ids[i % len(ids)]}
        row[SECONDS] = int(rng.integers(0, 86400))
        row.update({name: float(v) for name, v in zip(DOUBLES, rng.normal(size=29))})
        row[LABEL] = i % 2
        out.append(row)
    return out


def structs(data, with_seconds, with_uuid=True):
    schema = message_schema(with_seconds, with_uuid)
    kinds = {"string": pa.string(), "bigint": pa.int64(), "int": pa.int32(), "double": pa.float64()}
    return pa.StructArray.from_arrays(
        [pa.array([r[f.name] for r in data], kinds[f.dataType.simpleString()]) for f in schema],
        names=schema.names,
    )


@pytest.mark.parametrize("with_seconds", [False, True])
@pytest.mark.parametrize("with_uuid", [False, True])
def test_bytes_follow_the_specification_and_come_back(with_seconds, with_uuid):
    data = rows(60)
    batch = structs(data, with_seconds, with_uuid)
    made = encode_batch(batch, with_seconds, with_uuid)
    assert made.to_pylist() == [by_hand(r, with_seconds, with_uuid) for r in data]
    assert decode_batch(made, with_seconds, with_uuid, False).to_pylist() == batch.to_pylist()
    part = made.slice(7, 20)
    assert decode_batch(part, with_seconds, with_uuid, False).to_pylist() == batch.to_pylist()[7:27]
    part = batch.slice(5, 9)
    assert encode_batch(part, with_seconds, with_uuid).to_pylist() == made.to_pylist()[5:14]


def test_malformed_messages():
    good = by_hand(rows(1)[0], False)
    broken = [good[:-1], good + b"\0", b"", b"\xff" * 300, good[:20], varint(10**9) + good, None]
    batch = pa.array([good, *broken, good], pa.binary())
    out = decode_batch(batch, False, True, permissive=True).to_pylist()
    assert out[0] is not None and out[-1] == out[0]
    assert out[1:-1] == [None] * len(broken)
    with pytest.raises(ValueError):
        decode_batch(batch, False, True, permissive=False)


def test_empty_batch():
    batch = structs([], True)
    assert decode_batch(encode_batch(batch, True, True), True, True, False).to_pylist() == []


def test_nulls_cannot_be_sent():
    data = rows(2)
    data[1]["V3"] = None
    with pytest.raises(ValueError):
        encode_batch(structs(data, False), False, True)


def test_in_a_query(spark):
    data = rows(50)
    schema = message_schema(True)
    df = spark.createDataFrame([tuple(r[n] for n in schema.names) for r in data], schema)
    sent = df.select(encode(True).alias("value"))
    back = sent.select(decode(F.col("value"), True).alias("r")).select("r.*")
    assert back.columns == schema.names
    assert sorted(back.collect()) == sorted(df.collect())
    register_decoder(spark, "deserialize", with_seconds=True)
    named = sent.selectExpr("deserialize(value) AS rows").select("rows.*")
    assert sorted(named.collect()) == sorted(df.collect())


def test_schema_names():
    assert '"NumericSecondDay"' in avro_schema(True)
    assert '"uuid"' not in avro_schema(False, with_uuid=False)
