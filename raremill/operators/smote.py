"""Synthetic minority oversampling as one distributed plan."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from raremill.functions.hashing import hash_bits, hash_uniform
from raremill.functions.vectors import all_finite, feature_array
from raremill.operators.knn import BLOCK_ROWS, MAX_PIVOTS, neighbour_lists
from raremill.operators.sampling import extra_copy, with_copies
from raremill.session import cut_lineage

_MOVES = {"interpolate": "{x} + ({y} - {x}) * gap", "extrapolate": "{x} + ({x} - {y}) * gap"}


def pick_neighbours(lists: DataFrame, key: str, seed: int = 1) -> DataFrame:
    """For each (row, copy) one of the row's neighbours, uniformly by hash.

    Needs ``neighbours`` and ``copy``; adds ``rank``, ``nn_id``, ``dist`` and
    ``same`` (the neighbour is an exact copy). Rows without neighbours drop out.
    """
    found = lists.where(F.size("neighbours") > 0)
    rank = (hash_bits("nn", seed, F.col(key), F.col("copy")) % F.size("neighbours") + 1).cast("int")
    chosen = F.inline(F.array(F.element_at("neighbours", F.col("rank"))))
    return found.withColumn("rank", rank).select(
        *[c for c in found.columns if c != "neighbours"],
        "rank",
        chosen.alias("dist", "nn_id", "same"),
    )


@dataclass(frozen=True)
class Rare:
    """Minority rows kept in the shared folder: ``rows`` (id, user_id, features) with a unique
    ``id``, whether any id differs from the user's, and their neighbour ``lists``."""

    rows: DataFrame
    renamed: bool
    lists: DataFrame | None = None


def rare_rows(
    df: DataFrame, features: list[str], label: str, key: str, minority: int = 1
) -> Rare:
    """The minority rows of ``df``, read once. A row whose key is null or repeated gets an id
    hashed from its key, features and number among its equals; all others keep theirs."""
    rare = df.where((F.col(label) == minority) & all_finite(features)).select(
        F.col(key).cast("long").alias("user_id"), feature_array(features).alias("features")
    )
    # a wide scan leaves a few rare rows in each of very many partitions: gather them
    rare = cut_lineage(rare.hint("rebalance", "user_id"))
    count = F.count(F.lit(1))
    again = rare.groupBy("user_id").agg(count.alias("n")).where("n > 1 or user_id is null")
    if not again.head(1):
        return Rare(rare.select(F.col("user_id").alias("id"), "user_id", "features"), False)
    # equal rows are counted before they meet and numbered afterwards
    same = ["user_id", "h", "features"]
    numbered = (
        rare.withColumn("h", F.xxhash64("features")).groupBy(*same).agg(count.alias("n"))
        .withColumn("number", F.explode(F.sequence(F.lit(1).cast("long"), "n")))
    )
    again = cut_lineage(again.select(F.col("user_id").alias("_again")))
    marked = numbered.join(again, F.col("user_id").eqNullSafe(F.col("_again")), "left")
    own = F.col("_again").isNull() & F.col("user_id").isNotNull()
    name = F.xxhash64(F.lit("row"), "user_id", "h", "number")
    rows = cut_lineage(
        marked.select(F.when(own, F.col("user_id")).otherwise(name).alias("id"), "user_id", "features")
        .hint("rebalance", "id")
    )
    if rows.groupBy("id").agg(count.alias("n")).where("n > 1").head(1):
        raise ValueError("two rows got the same id; give unique keys")
    return Rare(rows, True)


def with_lists(rare: Rare, k: int, seed: Column | None = None, **blocking: int) -> Rare:
    """``rare`` with the neighbours of its rows, or of those for which ``seed`` holds."""
    lists = neighbour_lists(rare.rows.select("id", "features"), k, seed=seed, stored=True, **blocking)
    # kept: several readers follow, and the search is the costly part
    return replace(rare, lists=cut_lineage(lists))


def synthetic_rows(
    df: DataFrame,
    features: list[str],
    label: str,
    key: str,
    rate: float,
    k: int = 5,
    seed: int = 1,
    mode: str = "interpolate",
    minority: int = 1,
    block_rows: int = BLOCK_ROWS,
    max_pivots: int = MAX_PIVOTS,
    rare: Rare | None = None,
) -> DataFrame:
    """``round(m * rate)`` synthetic rows for the m minority rows:
    (seed_id, copy, nn_id, label, features).

    Each minority row is used ``floor(rate)`` times and a hash-ranked share once
    more. ``key`` is a bigint; rows that share one, or have none, are still rows of
    their own, and are named by it in the result. ``interpolate`` places the new row between
    seed and neighbour, ``extrapolate`` on the far side of the seed. The minority rows are
    read from the input once and kept in the shared folder; everything after that works
    on them alone. ``rare`` gives them, with all their lists, when several calls share them.
    """
    if mode not in _MOVES:
        raise ValueError(f"mode must be one of {sorted(_MOVES)}")
    rare = rare or rare_rows(df, features, label, key, minority)
    whole, extra = int(rate), extra_copy(rare.rows, rate, "id", seed)
    if rare.lists is None:
        wanted = None if whole else extra
        rare = with_lists(rare, k, wanted, block_rows=block_rows, max_pivots=max_pivots)
    copies = with_copies(rare.lists, whole, extra)
    picked = pick_neighbours(copies, "id", seed)
    return moved_rows(
        picked, rare.rows, df.schema, features, label, seed, mode, minority, users=rare.rows if rare.renamed else None
    )


def moved_rows(
    picked: DataFrame,
    rows: DataFrame,
    schema: T.StructType,
    features: list[str],
    label: str,
    seed: int,
    mode: str,
    minority: int,
    keep: tuple[str, ...] = (),
    users: DataFrame | None = None,
) -> DataFrame:
    """The synthetic rows of picked neighbours; ``users`` gives the user's keys where ids were made."""
    ends = _with_ends(picked, rows, seed, keep)
    if users is not None:
        ends = _with_user_ids(ends, users)
    kinds = {f.name: f.dataType for f in schema.fields}
    return ends.selectExpr(
        *keep,
        "id as seed_id",
        "copy",
        "nn_id",
        f"cast({minority} as {kinds[label].simpleString()}) as `{label}`",
        *[_moved(i, kinds[name], mode) + f" as `{name}`" for i, name in enumerate(features)],
    )


def _with_user_ids(ends: DataFrame, rows: DataFrame) -> DataFrame:
    """The user's keys in place of the ids that were made."""
    for column in ("id", "nn_id"):
        named = rows.select(F.col("id").alias(column), F.col("user_id").alias("_user"))
        ends = ends.join(named, column).drop(column).withColumnRenamed("_user", column)
    return ends


def _with_ends(picked: DataFrame, rare: DataFrame, seed: int, keep: tuple[str, ...] = ()) -> DataFrame:
    """Fetch the picked neighbour's features by key and draw the gap.

    The neighbour of an exact copy is the seed itself, whatever the gap, so those
    rows need no fetch; this keeps a hot group of copies, all of which point to
    the same few ids, out of the join.
    """
    columns = [*keep, "id", "copy", "nn_id", "features"]
    ends = rare.select(F.col("id").alias("nn_id"), F.col("features").alias("nn_features"))
    gap = hash_uniform("gap", seed, F.col("id"), F.col("copy")).alias("gap")
    apart = picked.where(~F.col("same")).select(*columns, gap).join(ends, "nn_id")
    still = picked.where("same").select(
        *columns, F.lit(0.0).alias("gap"), F.col("features").alias("nn_features")
    )
    return apart.unionByName(still)


def _moved(i: int, kind: T.DataType, mode: str) -> str:
    """The i-th feature of the new row. Whole-number features stay whole."""
    value = _MOVES[mode].format(x=f"features[{i}]", y=f"nn_features[{i}]")
    if isinstance(kind, T.IntegralType):
        value = f"round({value})"
    return f"cast({value} as {kind.simpleString()})"


def smote(
    df: DataFrame,
    features: list[str],
    label: str,
    key: str,
    rate: float,
    k: int = 5,
    seed: int = 1,
    mode: str = "interpolate",
    minority: int = 1,
    **blocking: int,
) -> DataFrame:
    """All input rows and the synthetic ones, as (label, features). Rate 0 adds none."""
    columns = [label, *features]
    if rate == 0:
        return df.select(*columns)
    made = synthetic_rows(df, features, label, key, rate, k, seed, mode, minority, **blocking)
    return df.select(*columns).unionByName(made.select(*columns))
