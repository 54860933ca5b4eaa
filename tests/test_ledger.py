import random

import pytest
from pyspark.sql import functions as F

from raremill.streaming import latency, ledger, scoring

RANGES = "topic string, partition int, batch long, first long, last long"


def covered(rows):
    out = {}
    for t, p, b, first, last in rows:
        for at in range(first, last + 1):
            out.setdefault((t, p), {}).setdefault(at, set()).add(b)
    return out


def brute_audit(rows):
    found = {}
    for source, offsets in covered(rows).items():
        for at in range(min(offsets), max(offsets) + 1):
            held = offsets.get(at, set())
            if len(held) == 1:
                continue
            kind = "overlap" if held else "gap"
            name = tuple(sorted(held))
            run = found.setdefault(source, [])
            if run and run[-1][2] == at - 1 and run[-1][3] == name:
                run[-1][2] = at
            else:
                run.append([kind, at, at, name])
    out = set()
    for source, runs in found.items():
        for kind, first, last, held in runs:
            offsets = covered(rows)[source]
            names = set(held) if held else offsets[first - 1] | offsets[last + 1]
            out.add((*source, kind, first, last, tuple(sorted(names))))
    return out


@pytest.mark.parametrize("seed", range(4))
@pytest.mark.parametrize("stretch", [4, 1 << 20])
def test_audit_equals_brute_force(spark, monkeypatch, seed, stretch):
    monkeypatch.setattr(ledger, "STRETCH", stretch)
    draw = random.Random(seed)
    rows = []
    for b in range(14):
        first = draw.randrange(60)
        rows.append(("t", draw.randrange(2), b, first, first + draw.randrange(12)))
    df = spark.createDataFrame(rows, RANGES)
    got = {(*r[:5], tuple(r.batches)) for r in ledger.audit(df).collect()}
    # brute force joins neighbouring stretches that hold the same batches
    assert merged(got) == merged(brute_audit(rows))
    whole = {(r.topic, r.partition): set() for r in df.collect()}
    for r in ledger.merge_intervals(df, ledger.SOURCE).collect():
        span = set(range(r.first, r.last + 1))
        assert not whole[r.topic, r.partition] & span
        whole[r.topic, r.partition] |= span
    assert whole == {s: set(o) for s, o in covered(rows).items()}
    planned = spark.createDataFrame([("t", 0, 77, 5, 40), ("t", 1, 78, -3, 2), ("u", 0, 79, 1, 2)], RANGES)
    lost = {r.batch: (r.held, r.lost) for r in ledger.coverage(planned, df).collect()}
    for batch, key, first, last in ((77, ("t", 0), 5, 40), (78, ("t", 1), -3, 2), (79, ("u", 0), 1, 2)):
        held = len(whole.get(key, set()) & set(range(first, last + 1)))
        assert lost[batch] == (held, last - first + 1 - held)


def merged(rows):
    cells = set()
    for t, p, kind, first, last, names in rows:
        if kind == "gap":
            cells.add((t, p, kind, first, last, names))
        else:
            cells |= {(t, p, kind, at, names) for at in range(first, last + 1)}
    return cells


@pytest.mark.parametrize("stretch", [3, 1 << 20])
def test_ranges(spark, monkeypatch, stretch):
    monkeypatch.setattr(ledger, "STRETCH", stretch)
    held = {(0, 1): {1, 2, 3, 4, 7, 8}, (0, 2): {5, 6}, (1, 1): {0}}
    rows = [("t", p, b, at) for (p, b), offsets in held.items() for at in [*offsets, *list(offsets)[:2]]]
    df = spark.createDataFrame([*rows, ("t", 0, 1, None)], "topic string, partition int, batch long, offset long")
    got = {(r.partition, r.batch, r.first, r.last) for r in ledger.offset_ranges(df).collect()}
    assert got == {(0, 1, 1, 4), (0, 1, 7, 8), (0, 2, 5, 6), (1, 1, 0, 0)}
    assert ledger.audit(ledger.offset_ranges(df.where("false"))).collect() == []


SENDS, FOUND = "uuid string, sent_at timestamp", "uuid string, predicted_at timestamp"


def at(seconds):
    return F.timestamp_seconds(F.lit(1_700_000_000 + seconds))


def stamped(spark, rows, name):
    base = spark.createDataFrame(rows, "uuid string, s long")
    return base.select("uuid", F.timestamp_seconds(F.lit(1_700_000_000) + F.col("s")).alias(name))


def test_latency_of_odd_rows(spark):
    sends = stamped(spark, [("a", 0), ("a", 0), ("b", 0), ("c", 0), (None, 0), ("d", None)], "sent_at")
    found = stamped(spark, [("a", 5), ("b", -1), ("c", 601), (None, 1), ("e", 0)], "predicted_at")
    rows = sorted((r.uuid or "", r.status, r.latency_ms) for r in latency.send_latency(sends, found).collect())
    assert [r for r in rows if r[1] == "matched"] == [("a", "matched", 5000)] * 2
    assert sorted(r[0] for r in rows if r[1] == "unpredicted") == ["", "b", "c", "d"]
    assert sorted(r[0] for r in rows if r[1] == "unsent") == ["", "b", "c", "e"]


def test_late_rows_are_counted_and_state_is_dropped(spark, tmp_path):
    """A send and its prediction far behind the watermark are left out, and the query says so."""
    parts = [
        ([("a", 0), ("b", 10)], [("a", 3)]),
        ([("x", 100_000)], [("x", 100_001)]),
        ([("old", 20)], [("old", 21)]),
        ([(None, 900_000)], [(None, 900_000)]),
    ]
    for k, (s, f) in enumerate(parts):
        for rows, name, column in ((s, "sends", "sent_at"), (f, "found", "predicted_at")):
            stamped(spark, rows, column).coalesce(2).write.mode("append").parquet(str(tmp_path / name))
        streams = [spark.readStream.schema(x).parquet(str(tmp_path / n)) for x, n in ((SENDS, "sends"), (FOUND, "found"))]
        rows = latency.send_latency(*streams)
        query = latency.store_latency(rows, str(tmp_path / "rows"), str(tmp_path / "state"), available_now=True)
        query.awaitTermination()
        assert latency.dropped_late(query) == (2 if k == 2 else 0)
        held = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]
    assert held[-1] <= 4
    got = sorted((r.uuid, r.status) for r in spark.read.parquet(str(tmp_path / "rows")).where("uuid is not null").collect())
    assert got == [("a", "matched"), ("b", "unpredicted"), ("x", "matched")]


def test_sent_once(spark, tmp_path):
    schema = "key string, value binary, id bigint, time bigint"
    first = [("a", b"1", 1, 1000), ("b", b"2", 2, 1000), (None, b"3", 3, 1000), (None, b"4", 4, 1000)]
    again = [("a", b"1", 1, 61_000), (None, b"3", 3, 61_000), ("c", b"5", 5, 61_000)]
    table = spark.createDataFrame(first + again, schema)
    assert sorted(r.id for r in scoring.sent_once(table).collect()) == [1, 2, 3, 4, 5]
    assert {r.time for r in scoring.sent_once(table).where("id = 1").collect()} == {1000}
    for rows in (first, again):
        spark.createDataFrame(rows, schema).write.mode("append").parquet(str(tmp_path / "m"))
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "m"))
        writer = scoring.sent_once(stream).writeStream.option("checkpointLocation", str(tmp_path / "s"))
        writer.format("parquet").trigger(availableNow=True).start(str(tmp_path / "out")).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out"))
    assert sorted(r.id for r in got.collect()) == [1, 2, 3, 4, 5] and got.columns == ["key", "value", "id", "time"]
