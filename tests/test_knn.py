import numpy as np
import pytest
from pyspark.sql import functions as F

from raremill.operators import knn
from raremill.operators.knn import knn_join


def brute(rows, k, seeds=None):
    """rows: list of (id, vector). Ranks by (distance, id), self excluded."""
    out = {}
    for i, x in rows:
        if seeds is not None and i not in seeds:
            continue
        found = []
        for j, y in rows:
            if i != j:
                total = 0.0
                for a, b in zip(x, y):
                    total += (a - b) * (a - b)
                found.append((float(np.sqrt(total)), j))
        out[i] = sorted(found)[:k]
    return out


def run(spark, rows, k, **kw):
    df = spark.createDataFrame(rows, "id long, features array<double>")
    out = {}
    for r in knn_join(df, k, **kw).collect():
        out.setdefault(r.seed_id, []).append((r.rank, r.dist, r.nn_id))
    for v in out.values():
        v.sort()
        assert [x[0] for x in v] == list(range(1, len(v) + 1))
    return {i: [(d, j) for _, d, j in v] for i, v in out.items()}


def clustered(n, d, seed):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(6, d)) * 10
    data = centres[rng.integers(0, 6, n)] + rng.normal(size=(n, d))
    data[: n // 3] = data[0]  # a third of the rows are copies of one
    data[n // 3 : n // 2] = data[n // 3] + rng.normal(size=(n // 2 - n // 3, d)) * 1e-6
    ids = rng.permutation(n * 3)[:n]
    return [(int(i), [float(v) for v in x]) for i, x in zip(ids, data)]


@pytest.mark.parametrize("block_rows,max_pivots", [(4096, 1024), (20, 1024), (20, 4), (20, 1)])
def test_matches_brute_force_whatever_the_blocking(spark, block_rows, max_pivots):
    rows = clustered(300, 5, 3)
    got = run(spark, rows, 4, block_rows=block_rows, max_pivots=max_pivots)
    assert got == brute(rows, 4)


def test_grid_with_many_ties(spark):
    rows = [(i * 7 % 144, [float(i % 12), float(i // 12)]) for i in range(144)]
    assert run(spark, rows, 5, block_rows=16) == brute(rows, 5)


def test_only_seeds_search_but_all_are_found(spark):
    rows = clustered(120, 3, 5)
    seeds = {i for i, _ in rows if i % 4 == 0}
    for size in (4096, 15):
        got = run(spark, rows, 3, seed=F.col("id") % 4 == 0, block_rows=size)
        assert got == brute(rows, 3, seeds)


@pytest.mark.parametrize("n", [0, 1, 2, 3])
def test_fewer_rows_than_k(spark, n):
    rows = [(i, [float(i), 0.0]) for i in range(n)]
    expected = {i: v for i, v in brute(rows, 5).items() if v}
    assert run(spark, rows, 5) == expected


def test_all_rows_equal(spark):
    rows = [(i, [1.0, 2.0]) for i in range(30)]
    assert run(spark, rows, 3, block_rows=4) == brute(rows, 3)


def test_large_values_close_together(spark):
    rng = np.random.default_rng(1)
    rows = [(i, [float(v) for v in 1e6 + rng.normal(size=4) * 1e-3]) for i in range(80)]
    assert run(spark, rows, 4, block_rows=16) == brute(rows, 4)


def test_rows_without_a_distance_take_no_part(spark):
    rows = [(0, [0.0]), (1, [1.0]), (2, None), (3, [None]), (4, [float("nan")]), (5, [float("inf")])]
    assert run(spark, rows, 3) == {0: [(1.0, 1)], 1: [(1.0, 0)]}


def test_signed_zeros_are_the_same_value(spark):
    rows = [(3, [0.0, 1.0]), (1, [-0.0, 1.0]), (2, [0.0, 1.0]), (4, [0.0, -0.0]), (5, [-0.0, 0.0])]
    assert run(spark, rows, 2) == brute(rows, 2)
    assert run(spark, rows, 2, block_rows=1) == brute(rows, 2)


def test_distances_that_overflow(spark):
    rows = [(i, [float(i), 0.0]) for i in range(8)] + [(8, [1e200, 0.0]), (9, [-1e200, 1.0]), (10, [1e200, 5.0])]
    for size in (4096, 2):
        assert run(spark, rows, 3, block_rows=size) == brute(rows, 3)


@pytest.mark.parametrize("seed", range(3))
def test_random_shapes(spark, seed):
    rng = np.random.default_rng(seed)
    n, d, k = int(rng.integers(20, 120)), int(rng.integers(1, 8)), int(rng.integers(1, 12))
    data = rng.integers(0, 4, (n, d)) * rng.choice([1.0, 1e-3, 1e3])
    rows = [(int(i), [float(v) for v in x]) for i, x in zip(rng.permutation(n), data)]
    got = run(spark, rows, k, block_rows=int(rng.integers(1, 30)), max_pivots=int(rng.integers(1, 20)))
    assert got == brute(rows, k)


def test_small_blocks_travel_together(spark, monkeypatch):
    """Cells of a few vectors cost no row of their own where seeds and vectors meet."""
    met, plain = [], knn._meet

    def counted(*args):
        found = plain(*args)
        met.append(found.count())
        return found

    monkeypatch.setattr(knn, "_meet", counted)
    rng = np.random.default_rng(2)
    rows = [(i, [float(v) for v in x]) for i, x in enumerate(rng.normal(size=(1200, 6)))]
    assert run(spark, rows, 3, block_rows=4) == brute(rows, 3)
    assert met[0] <= 16


@pytest.mark.parametrize("load_rows,run_rows", [(8, 3), (40, 512)])
def test_many_groups_of_loads(spark, monkeypatch, load_rows, run_rows):
    monkeypatch.setattr(knn, "LOAD_ROWS", load_rows)
    monkeypatch.setattr(knn, "RUN_ROWS", run_rows)
    rows = clustered(400, 4, 9)
    assert run(spark, rows, 4, block_rows=8) == brute(rows, 4)


def test_tasks_are_sent_few_meetings_at_once(spark, monkeypatch):
    sent, plain = [], knn._probe
    monkeypatch.setattr(knn, "_probe", lambda *a: sent.append(spark.conf.get(knn._SENT)) or plain(*a))
    rows = [(i, [float(i), 1.0]) for i in range(20)]
    assert run(spark, rows, 2) == brute(rows, 2)
    assert int(sent[0].rstrip("bB")) <= 8 << 20
