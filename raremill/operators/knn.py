"""Exact k-nearest-neighbour self-join.

The join never pairs everything with everything and keeps every task bounded:

1. Exact copies are folded first. A group of copies needs only its k+1 smallest
   ids, taken map-side, so a hot group shrinks before the shuffle.
2. Distinct vectors are placed in the cell of their closest pivot. Pivots are a
   fixed-size hash sample, so dense regions get more of them, about four for ``block_rows``
   vectors; they are numbered so that near cells have near numbers.
3. Neighbouring cells travel together in loads of at most ``block_rows`` vectors (``LOAD_ROWS``
   if that is more), so that small cells cost no row, message or kernel call each; cells
   larger than a load are sliced by hash.
4. Each load bounds its seeds' k-th distance from inside the load, then the
   triangle inequality against the pivots tells which cells can still hold a
   closer vector. Seeds are sent only where such cells are.
5. Seeds and loads meet by an equi-join on groups of loads and of senders, the
   square root of the number of loads of each, so that no vector travels more often
   than that. A numpy kernel goes through the load in runs of cells, visits those that a
   seed still needs, tightens the seed's bound and keeps at most k rows per seed and load;
   a top-k window (limited map-side) merges them.

Pivot choice and block size change the work, never the result. At most
``max_pivots`` vectors and cell statistics reach the driver.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from raremill.functions import nearest
from raremill.functions.vectors import is_finite
from raremill.session import cut_lineage

BLOCK_ROWS = 4096
MAX_PIVOTS = 1 << 14
#: Vectors that travel together at least, and those of a load that are compared at once.
LOAD_ROWS = 1024
RUN_ROWS = 512
#: Bytes that Spark sends to a task's Python side at once; a meeting of two loads is one long row.
_SENT, _MOST_SENT = "spark.sql.execution.arrow.maxBytesPerBatch", 8 << 20


def knn_join(
    points: DataFrame,
    k: int,
    id_col: str = "id",
    features_col: str = "features",
    seed: Column | None = None,
    block_rows: int = BLOCK_ROWS,
    max_pivots: int = MAX_PIVOTS,
) -> DataFrame:
    """Edges (seed_id, rank, nn_id, dist), ranks by distance and then id.

    ``id_col`` must be a unique bigint. ``seed`` restricts which rows search for
    neighbours; every row can be found as one. Rows with a null or non-finite
    feature have no distance and take no part. With fewer than k other rows a
    seed gets those that exist.
    """
    lists = neighbour_lists(points, k, id_col, features_col, seed, block_rows, max_pivots)
    return lists.select(
        F.col(id_col).alias("seed_id"), F.posexplode("neighbours").alias("pos", "nn")
    ).select(
        "seed_id",
        (F.col("pos") + 1).alias("rank"),
        F.col("nn.id").alias("nn_id"),
        F.col("nn.dist").alias("dist"),
    )


def neighbour_lists(
    points: DataFrame,
    k: int,
    id_col: str = "id",
    features_col: str = "features",
    seed: Column | None = None,
    block_rows: int = BLOCK_ROWS,
    max_pivots: int = MAX_PIVOTS,
    stored: bool = False,
) -> DataFrame:
    """Seeds (id, features) with ``neighbours``, an array of at most k structs
    (dist, id, copy) in rank order; ``copy`` marks an exact copy of the seed. The
    points are kept in the shared folder, unless the caller has ``stored`` them."""
    if k < 1:
        raise ValueError("k must be at least 1")
    rows = points.select(
        F.col(id_col).cast("long").alias("id"),
        F.col(features_col).cast("array<double>").alias("features"),
        (F.lit(True) if seed is None else F.coalesce(seed, F.lit(False))).alias("is_seed"),
    ).where(is_finite(F.col("features")))
    # the hash leads every sort and join on vectors: comparing arrays is slow
    rows = rows.withColumn("h", F.xxhash64("features"))
    if not stored:
        rows = cut_lineage(rows)
    vectors = cut_lineage(_fold_copies(rows, k, every_row=seed is None))
    others = _vector_neighbours(vectors, k, block_rows, max_pivots)

    # lists are completed per vector; rows join them once, and a hot group of copies
    # is then one key with a single row on the other side, which AQE can split
    seeking = vectors.where("is_seed").select("h", "features", "vid", "ids")
    group = seeking.join(others, "vid", "left").drop("vid")
    listed = rows.where("is_seed").select("h", "features", "id").join(group, ["h", "features"])
    copies = F.transform(
        F.filter("ids", lambda i: i != F.col("id")),
        lambda i: F.struct(F.lit(0.0).alias("dist"), i.alias("id"), F.lit(True).alias("copy")),
    )
    found = F.transform(
        F.coalesce("others", F.array().cast("array<struct<dist:double,id:bigint>>")),
        lambda n: F.struct(n["dist"].alias("dist"), n["id"].alias("id"), F.lit(False).alias("copy")),
    )
    merged = F.slice(F.array_sort(F.concat(copies, found)), 1, k)
    return listed.select(
        F.col("id").alias(id_col), F.col("features").alias(features_col), merged.alias("neighbours")
    )


def _fold_copies(rows: DataFrame, k: int, every_row: bool) -> DataFrame:
    """One row per distinct vector: vid (its smallest id), its k+1 smallest ids, and
    whether any of its rows is a seed. Both windows share one shuffle when every
    row is a seed."""
    vector = ["h", "features"]
    limit = Window.partitionBy(*vector, *([] if every_row else ["is_seed"])).orderBy("id")
    least = rows.withColumn("_n", F.row_number().over(limit)).where(F.col("_n") <= k + 1)
    members = Window.partitionBy(*vector).orderBy("id")
    seen = members.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return (
        least.select(
            F.col("id").alias("vid"),
            F.collect_list("id").over(members.rowsBetween(0, k)).alias("ids"),
            *vector,
            F.max("is_seed").over(seen).alias("is_seed"),
            F.row_number().over(members).alias("_n"),
        )
        .where(F.col("_n") == 1)
        .drop("_n")
    )


def _vector_neighbours(
    vectors: DataFrame, k: int, block_rows: int, max_pivots: int
) -> DataFrame:
    """Per seed vector the k nearest rows that belong to other vectors:
    (vid, others: array<struct<dist, id>>)."""
    conf = vectors.sparkSession.conf
    sent = conf.get(_SENT).rstrip("bB")
    if not (sent.isdigit() and 0 < int(sent) <= _MOST_SENT):
        conf.set(_SENT, str(_MOST_SENT))
    n = vectors.count()
    # cells smaller than a block prune better; only crowded ones are sliced
    cells = min(max_pivots, math.ceil(4 * n / block_rows))
    load_rows = max(block_rows, LOAD_ROWS)
    pivots = nearest.near_order(_choose_pivots(vectors, n, cells))
    placed = cut_lineage(_place(vectors, pivots))
    plan = _plan(placed, len(pivots), load_rows, math.isqrt(max(0, n - 1) // load_rows) + 1)
    loads = cut_lineage(_pack(placed, plan))
    requests = _requests(loads, pivots, plan, k)
    meetings = _meet(requests, loads, plan.groups).select("asked", "rows", "first_run")
    return _merge(_probe(meetings, k), k)


def _meet(requests: DataFrame, loads: DataFrame, groups: int) -> DataFrame:
    """Requests beside the loads of the cells they ask for.

    Loads and senders both fall into ``groups`` groups. A seed travels once to each group
    that has cells it needs, a load once to each group of senders, so that the shuffle
    grows with ``groups`` and not with the number of loads."""
    every = F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))
    held = loads.select("*", every.alias("senders"))
    # requests can outgrow any estimate made before they exist: never broadcast them
    joined = requests.hint("merge").join(held, ["group", "senders"])
    return joined.where(F.array_contains("loads", F.col("load")))


def _choose_pivots(vectors: DataFrame, n: int, cells: int) -> np.ndarray:
    """A fixed-size hash sample; the only vectors that reach the driver. Rows that
    cannot be among the smallest hashes are filtered out where they are read."""
    place = F.pmod(F.xxhash64("vid", F.lit(17)), F.lit(n))
    near = vectors.where(place < 4 * cells + 64)
    sample = near.orderBy(place, "vid").limit(cells).select("features").collect()
    return np.array([row.features for row in sample], dtype=np.float64)


def _place(vectors: DataFrame, pivots: np.ndarray) -> DataFrame:
    """Add the cell of the closest pivot and the exact distance to it."""
    kind = T.StructType(
        [T.StructField("cell", T.IntegerType()), T.StructField("radius", T.DoubleType())]
    )

    @F.arrow_udf(kind)
    def place(features: pa.Array) -> pa.Array:
        data = _matrix(features)
        cell, radius = nearest.closest_pivots(data, pivots)
        return pa.StructArray.from_arrays(
            [pa.array(cell.astype(np.int32)), pa.array(radius)], names=["cell", "radius"]
        )

    return vectors.withColumn("_at", place("features")).select(
        *vectors.columns, F.col("_at.cell").alias("cell"), F.col("_at.radius").alias("radius")
    )


@dataclass
class _Plan:
    """Where cells travel, by their number: runs, loads and groups hold neighbouring cells each."""

    inner: np.ndarray
    outer: np.ndarray
    run: np.ndarray
    load: np.ndarray
    slices: np.ndarray
    groups: int

    def group(self, loads: np.ndarray) -> np.ndarray:
        return loads * self.groups // max(1, int(self.load[-1]) + 1 if len(self.load) else 1)

    def run_loads(self) -> np.ndarray:
        """The load of each run."""
        return self.load[np.unique(self.run, return_index=True)[1]]


def _plan(placed: DataFrame, cells: int, load_rows: int, groups: int) -> _Plan:
    """Radii and sizes of the cells, at most ``max_pivots`` rows, and the cells dealt to runs, loads and groups."""
    inner, outer, size = np.full(cells, np.inf), np.full(cells, -np.inf), np.zeros(cells, np.int64)
    grouped = placed.groupBy("cell").agg(
        F.min("radius").alias("inner"), F.max("radius").alias("outer"), F.count(F.lit(1)).alias("n")
    )
    for row in grouped.collect():
        inner[row.cell], outer[row.cell], size[row.cell] = row.inner, row.outer, row.n
    run, load = np.zeros(cells, np.int32), np.zeros(cells, np.int32)
    runs = loads = in_run = in_load = 0
    for cell, n in enumerate(size.tolist()):
        if in_load and in_load + n > load_rows:
            loads, runs, in_load, in_run = loads + 1, runs + 1, 0, 0
        elif in_run and in_run + n > RUN_ROWS:
            runs, in_run = runs + 1, 0
        run[cell], load[cell] = runs, loads
        in_run, in_load = in_run + n, in_load + n
    slices = np.maximum(1, -(-size // load_rows)).astype(np.int32)
    return _Plan(inner, outer, run, load, slices, min(groups, loads + 1))


def _pack(placed: DataFrame, plan: _Plan) -> DataFrame:
    """One row per load, or per slice of a crowded cell: its group, its first run and its vectors."""
    spark = placed.sparkSession
    groups = plan.group(plan.load)
    first = {int(g): int(plan.run[i]) for g, i in zip(*np.unique(groups, return_index=True), strict=True)}
    rows = zip(range(len(plan.run)), plan.run, plan.load, groups, (first[int(g)] for g in groups), plan.slices, strict=True)
    dealt = spark.createDataFrame(
        [tuple(int(x) for x in row) for row in rows], "cell int, run int, load int, group int, first_run int, slices int"
    )
    member = F.struct("run", "vid", "ids", "features", "is_seed")
    part = F.pmod(F.xxhash64("vid"), F.col("slices")).cast("int").alias("slice")
    return (
        placed.join(F.broadcast(dealt), "cell")
        .groupBy("load", part, "group", "first_run")
        .agg(F.collect_list(member).alias("rows"))
    )


_REQUEST = (
    "group int, senders int, loads array<int>, "
    "asked array<struct<vid:bigint,features:array<double>,limit:double,runs:binary>>"
)


def _requests(loads: DataFrame, pivots: np.ndarray, plan: _Plan, k: int) -> DataFrame:
    """The seeds each load sends to each group of loads, each with the runs of cells of the group
    that may hold a closer vector, as bits."""
    run_loads = plan.run_loads()
    run_groups = plan.group(run_loads)
    run_starts = np.unique(plan.run, return_index=True)[1]
    groups, inner, outer = plan.groups, plan.inner, plan.outer

    def asks(members: pa.StructArray, sender: int):
        seeds = members.filter(members.field("is_seed"))
        if len(seeds) == 0:
            return
        limit = _limits(seeds, members, k)
        wanted = nearest.reachable_cells(_matrix(seeds.field("features")), limit, pivots, inner, outer)
        wanted &= np.isfinite(inner)
        runs = np.logical_or.reduceat(wanted, run_starts, axis=1)
        for group in range(groups):
            held = np.flatnonzero(run_groups == group)
            own = runs[:, held[0] : held[-1] + 1] if len(held) else runs[:, :0]
            take = np.flatnonzero(own.any(axis=1))
            if not len(take):
                continue
            own = own[take]
            bits = [row.tobytes() for row in np.packbits(own, axis=1)]
            sent = pa.StructArray.from_arrays(
                [
                    seeds.field("vid").take(pa.array(take)),
                    seeds.field("features").take(pa.array(take)),
                    pa.array(limit[take]),
                    pa.array(bits, pa.binary()),
                ],
                names=["vid", "features", "limit", "runs"],
            )
            asked = np.unique(run_loads[held[own.any(axis=0)]])
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([group], pa.int32()),
                    pa.array([sender % groups], pa.int32()),
                    _lists(asked.astype(np.int32), [len(asked)]),
                    _lists(sent, [len(sent)]),
                ],
                names=["group", "senders", "loads", "asked"],
            )

    def send(batches):
        sender = TaskContext.get().partitionId()
        for batch in batches:
            for members in batch.column("rows"):
                yield from asks(members.values, sender)
                sender += 1

    return loads.select("rows").mapInArrow(send, _REQUEST)


def _lists(values, counts) -> pa.ListArray:
    offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
    return pa.ListArray.from_arrays(
        pa.array(offsets), values if isinstance(values, pa.Array) else pa.array(values)
    )


def _limits(seeds: pa.StructArray, members: pa.StructArray, k: int) -> np.ndarray:
    """The distance within which each seed's k nearest lie, judged from its own
    load: unbounded if the load has fewer than k others, zero if the seed has k
    exact copies."""
    features, vids = _matrix(seeds.field("features")), _longs(seeds.field("vid"))
    limit = np.full(len(seeds), np.inf)
    found = nearest.block_neighbours(
        features, vids, limit, _matrix(members.field("features")), _longs(members.field("vid")), k
    )
    position, _, dist, rank = found
    last = rank == k - 1
    limit[position[last]] = dist[last]
    limit[_longs(seeds.field("ids").value_lengths()) > k] = 0.0
    return limit


def _probe(meetings: DataFrame, k: int) -> DataFrame:
    """Up to k candidates per seed of every pair of seeds and a load."""

    def search(batches):
        for batch in batches:
            for seeds, rows, first in zip(*(batch.column(c) for c in ("asked", "rows", "first_run")), strict=True):
                seeds, rows = seeds.values, rows.values
                bits = np.frombuffer(b"".join(seeds.field("runs").to_pylist()), np.uint8).reshape(len(seeds), -1)
                vids = _longs(seeds.field("vid"))
                position, column, dist = nearest.load_neighbours(
                    _matrix(seeds.field("features")),
                    vids,
                    seeds.field("limit").to_numpy(zero_copy_only=False),
                    np.unpackbits(bits, axis=1),
                    _matrix(rows.field("features")),
                    _longs(rows.field("vid")),
                    _longs(rows.field("run")) - first.as_py(),
                    k,
                )
                if len(position):
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(vids[position]),
                            pa.array(dist),
                            rows.field("ids").take(pa.array(column)),
                        ],
                        names=["vid", "dist", "ids"],
                    )

    return meetings.mapInArrow(search, "vid bigint, dist double, ids array<bigint>")


def _merge(candidates: DataFrame, k: int) -> DataFrame:
    """The k best of each seed vector, expanded to row ids."""
    order = Window.partitionBy("vid").orderBy("dist", F.col("ids")[0])
    best = candidates.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= k)
    expanded = F.flatten(
        F.collect_list(
            F.transform("ids", lambda i: F.struct(F.col("dist").alias("dist"), i.alias("id")))
        )
    )
    return best.groupBy("vid").agg(F.slice(F.array_sort(expanded), 1, k).alias("others"))


def _matrix(features: pa.Array) -> np.ndarray:
    flat = features.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(features), -1) if len(features) else flat.reshape(0, 0)


def _longs(values: pa.Array) -> np.ndarray:
    return values.to_numpy(zero_copy_only=False)
