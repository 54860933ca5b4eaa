"""Oversampling inside the training part of each fold.

A synthetic row made before the folds are dealt may lie between a training row and a row of the
fold that judges it. Here every held-out fold gets synthetic rows of its own, made of rows of the
other folds only. The neighbours are searched once for all folds, in lists somewhat longer than
needed; rows of the held-out fold are taken out of them. A list that runs short although more
rows exist is completed exactly, by a search among the training rows of that fold alone.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from raremill.operators.knn import BLOCK_ROWS, MAX_PIVOTS, neighbour_lists
from raremill.operators.sampling import extra_copy, fold_column, with_copies
from raremill.operators.smote import Rare, moved_rows, pick_neighbours, rare_rows
from raremill.session import cut_lineage

HELD_OUT = "held_out"


def list_length(k: int, folds: int) -> int:
    """So many neighbours that k of them mostly lie in other folds."""
    return math.ceil(k * folds / (folds - 1)) + 2 * math.isqrt(k) + 2


def fold_lists(
    rows: DataFrame,
    k: int,
    folds: int,
    fold_of,
    length: int | None = None,
    block_rows: int = BLOCK_ROWS,
    max_pivots: int = MAX_PIVOTS,
) -> DataFrame:
    """(held_out, id, features, neighbours) for each of ``rows`` (id, features) and each fold that it does
    not belong to: its k nearest among the rows outside that fold. ``fold_of`` maps an id column to
    its fold. ``length`` changes the work, never the result."""
    length = max(k, length or list_length(k, folds))
    blocking = {"block_rows": block_rows, "max_pivots": max_pivots, "stored": True}
    every = cut_lineage(neighbour_lists(rows, length, **blocking))
    others = F.explode(F.filter(F.sequence(F.lit(0), F.lit(folds - 1)), lambda f: f != fold_of(F.col("id"))))
    apart = every.select("*", others.alias(HELD_OUT))
    kept = F.filter("neighbours", lambda n: fold_of(n["id"]) != F.col(HELD_OUT))
    apart = apart.withColumn("kept", kept)
    short = (F.size("kept") < k) & (F.size("neighbours") >= length)
    found = apart.where(~short).select(HELD_OUT, "id", "features", F.slice("kept", 1, k).alias("neighbours"))
    lacking = cut_lineage(apart.where(short).select(HELD_OUT, "id"))
    # one small row: the folds that have short lists
    for fold in lacking.agg(F.collect_set(HELD_OUT).alias("folds")).first().folds:
        ids = lacking.where(F.col(HELD_OUT) == fold).select("id", F.lit(True).alias("_short"))
        part = cut_lineage(rows.where(fold_of(F.col("id")) != fold).join(ids, "id", "left"))
        again = neighbour_lists(part, k, seed=F.col("_short"), **blocking)
        found = found.unionByName(again.select(F.lit(fold).alias(HELD_OUT), "id", "features", "neighbours"))
    return found


def fold_synthetic_rows(
    df: DataFrame,
    features: list[str],
    label: str,
    key: str,
    rate: float,
    folds: int = 5,
    k: int = 5,
    seed: int = 1,
    fold_seed: int = 11,
    mode: str = "interpolate",
    minority: int = 1,
    length: int | None = None,
    rare: Rare | None = None,
    lists: DataFrame | None = None,
    **blocking: int,
) -> DataFrame:
    """(held_out, seed_id, copy, nn_id, label, features): for every fold ``round(m * rate)`` synthetic rows of the m
    minority rows outside it. Seeds and neighbours are both outside it. Folds are those of
    ``fold_column(key, folds, fold_seed)``; ``key`` must be unique (number the rows first where it
    is not). ``rare`` and ``lists`` (of ``fold_lists``) can be shared by several rates."""
    rare = rare or rare_rows(df, features, label, key, minority)
    if rare.renamed:
        raise ValueError(f"{key} is null or repeated; folds need a unique key")
    fold_of = fold_number(folds, fold_seed)
    if lists is None:
        lists = cut_lineage(fold_lists(rare.rows.select("id", "features"), k, folds, fold_of, length, **blocking))
    whole, extra = int(rate), F.lit(False)
    if rate != whole:
        for fold in range(folds):
            part = rare.rows.where(fold_of(F.col("id")) != fold)
            extra = F.when(F.col(HELD_OUT) == fold, extra_copy(part, rate, "id", seed)).otherwise(extra)
    picked = pick_neighbours(with_copies(lists, whole, extra), "id", seed)
    return moved_rows(picked, rare.rows, df.schema, features, label, seed, mode, minority, (HELD_OUT,))


def fold_number(folds: int, seed: int = 11):
    """A function of an id column: its fold."""

    def fold_of(key: Column) -> Column:
        return fold_column(key, folds, seed)

    return fold_of
