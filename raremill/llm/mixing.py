"""Mixing sources to target weights (operator 1); DataFrame functions only.

Documents fall into cells (source, language, topic). Iterative proportional fitting rakes
the cells' token weights until each marginal equals its target. A document of a cell is
kept with probability min(1, scale * weight / tokens), the scale being chosen so that the
expected tokens are ``rate`` of all; what capped cells cannot give goes to the others. The
draw is a hash of the document's id, so it does not depend on partitioning.

A target is a number, the exponent by which the marginal's own token shares are tempered, or
a DataFrame (value string, weight double) of which values that do not occur are left out;
values without a weight get none, so their documents go. Tokens are runs of characters other
than space and \\t \\n \\v \\f \\r. Null dimensions are a value of their own, ``(none)``. A cell
without tokens costs nothing and is kept. Rows that repeat an id share its draw; rows with a
null id draw by their text. Columns of the input are never clashed with.

Rounds work on cells only, as many rows as there are combinations; every tenth is stored.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from raremill.functions.hashing import hash_uniform
from raremill.llm.tasks import stored

DIMS = ("source", "lang", "topic")
#: Topics by the first text that occurs; what is left goes by its length.
MARKERS = (("licence", "icens"), ("table", " | "), ("contact", "@"), ("assignment", "="))
_CELLS_PER_TASK = 100_000
_ROUNDS_STORED = 10


def token_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def topic(text: Column, tokens: Column) -> Column:
    found = F.when(tokens == 0, "empty")
    for name, mark in MARKERS:
        found = found.when(F.contains(text, F.lit(mark)), name)
    return found.when(tokens < 100, "short").when(tokens < 1000, "medium").otherwise("long")


def described(docs: DataFrame) -> DataFrame:
    """``docs`` with its cell and token count in the column ``_mix``."""
    tokens = token_count(F.col("text"))
    value = {d: F.coalesce(F.col(d).cast("string"), F.lit("(none)")) for d in DIMS[:2]}
    return docs.withColumn("_mix_tokens", tokens).withColumn(
        "_mix",
        F.struct(
            *(value[d].alias(d) for d in DIMS[:2]), topic(F.col("text"), F.col("_mix_tokens")).alias("topic"),
            F.col("_mix_tokens").alias("tokens"),
        ),
    ).drop("_mix_tokens")


def _target(cells: DataFrame, dim: str, target: float | DataFrame) -> DataFrame:
    """(dim, goal): shares that sum to one over the values that occur."""
    own = cells.groupBy(dim).agg(F.sum("tokens").alias("t")).where("t > 0")
    if isinstance(target, DataFrame):
        own = own.join(target.select(F.col("value").alias(dim), "weight"), dim).groupBy(dim).agg(F.max("weight").alias("w"))
    else:
        own = own.select(dim, F.pow("t", F.lit(float(target))).alias("w"))
    total = own.agg(F.sum("w")).first()[0] or 1.0
    return own.select(dim, (F.col("w") / F.lit(total)).alias("goal"))


def rake(cells: DataFrame, targets: Mapping[str, float | DataFrame], tolerance: float = 1e-8, rounds: int = 200) -> DataFrame:
    """``cells`` (dimensions, tokens) with the raked share of each in ``weight``."""
    now = cells.withColumn("weight", F.col("tokens").cast("double"))
    for d, target in targets.items():
        goal = _target(cells, d, target).withColumnRenamed("goal", f"_goal_{d}")
        now = now.join(goal, d, "left").fillna(0.0, [f"_goal_{d}"])
    now = stored(now, "raked")
    tasks = max(1, now.count() // _CELLS_PER_TASK)
    gap = F.greatest(*(F.abs(_sum(d) - F.col(f"_goal_{d}")) for d in targets), F.lit(0.0))
    for _ in range(0, rounds, _ROUNDS_STORED):
        now = now.coalesce(tasks)
        for _ in range(_ROUNDS_STORED):
            for d in targets:
                share = F.col("weight") * F.col(f"_goal_{d}") / _sum(d)
                now = now.withColumn("weight", F.when(_sum(d) > 0, share).otherwise(F.lit(0.0)))
        now = stored(now, "raked")
        off = now.coalesce(tasks).select(gap.alias("gap")).agg(F.max("gap")).first()[0]
        if (off or 0.0) <= tolerance:
            break
    return now.select(*cells.columns, "weight")


def _sum(dim: str) -> Column:
    """Weight of all cells that share a value; these are few rows, for the documents were
    summed before."""
    return F.sum("weight").over(Window.partitionBy(dim))


def calibrate(raked: DataFrame, rate: float) -> DataFrame:
    """Probability of each cell, so that ``rate`` of all tokens is expected (less if cells
    with a target do not hold as many)."""
    total = raked.agg(F.sum("tokens")).first()[0] or 0
    budget, scale = rate * total, rate * total
    share = F.when(F.col("tokens") > 0, F.col("weight") / F.col("tokens")).otherwise(F.lit(0.0))
    while True:
        capped = F.lit(scale) * share >= 1
        held, free = raked.agg(
            F.sum(F.when(capped, F.col("tokens")).otherwise(F.lit(0))), F.sum(F.when(~capped, F.col("weight")))
        ).first()
        better = max(scale, (budget - (held or 0)) / free) if free else scale
        if better <= scale * (1 + 1e-12):
            break
        scale = better
    probability = F.when(F.col("tokens") == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), F.lit(scale) * share))
    return raked.withColumn("probability", probability)


def drawn(docs: DataFrame, targets: Mapping[str, float | DataFrame], rate: float, seed: int = 7) -> DataFrame:
    """``docs`` with a struct ``_mix``: the cell, tokens, probability and whether it is kept."""
    rows = described(docs)
    cells = stored(rows.groupBy(*(F.col(f"_mix.{d}").alias(d) for d in DIMS)).agg(F.sum("_mix.tokens").alias("tokens")), "cells")
    chances = stored(calibrate(rake(cells, targets), rate), "chances")
    named = chances.select(*(F.col(d).alias(f"_c_{d}") for d in DIMS), F.col("probability").alias("_p"))
    same = [F.col(f"_mix.{d}") == F.col(f"_c_{d}") for d in DIMS]
    draw = hash_uniform("mixing", seed, F.coalesce(F.col("doc_id").cast("string"), F.md5("text"), F.lit("")))
    return rows.join(named, same).select(
        *docs.columns,
        F.struct("_mix.*", F.col("_p").alias("probability"), (draw < F.col("_p")).alias("kept")).alias("_mix"),
    )


def sampled(docs: DataFrame, targets: Mapping[str, float | DataFrame], rate: float, seed: int = 7) -> DataFrame:
    """The documents drawn; all columns stay."""
    return drawn(docs, targets, rate, seed).where("_mix.kept").drop("_mix")
