"""Splits, class undersampling, replication and exact-size samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from raremill.functions.hashing import hash_bits, hash_uniform


def in_training(train_share: float, key: str, seed: int = 11) -> Column:
    """Whether a row belongs to the training share."""
    return hash_uniform("split", seed, F.col(key)) < train_share


def train_test_split(
    df: DataFrame, train_share: float, key: str, seed: int = 11
) -> tuple[DataFrame, DataFrame]:
    """Two disjoint filters over ``df``; no shuffle, no order dependence."""
    inside = in_training(train_share, key, seed)
    return df.where(inside), df.where(~inside)


def fold_column(key: str | Column, folds: int, seed: int = 11) -> Column:
    """Fold number of a row, for cross-validation with a fold column."""
    key = F.col(key) if isinstance(key, str) else key
    return (hash_bits("fold", seed, key) % folds).cast("int")


def undersample(
    df: DataFrame, ratio: float, label: str, key: str, seed: int = 1
) -> DataFrame:
    """Keep every positive and a Bernoulli share of the negatives.

    A ratio of 0 or 1 leaves the data as it is. One filter on one scan; the class
    test reaches the source, which can skip rows of neither class.
    """
    if ratio in (0.0, 1.0):
        return df
    kept = hash_uniform("under", seed, F.col(key)) < ratio
    return df.where(F.col(label).isin(0, 1) & ((F.col(label) == 1) | kept))


def replicate(df: DataFrame, copies: int, copy_col: str = "copy") -> DataFrame:
    """``copies`` numbered copies of each row (1-based)."""
    if copies < 1:
        raise ValueError("copies must be at least 1")
    return df.withColumn(copy_col, F.explode(F.sequence(F.lit(1), F.lit(copies))))


#: Rows that one task ranks at most.
RANKED = 1 << 16
_DIGIT = 14


def among_first(df: DataFrame, size: int, key: str, purpose: str, seed: int = 1) -> Column:
    """A condition true for exactly ``size`` rows of ``df`` (all, if it has fewer):
    those with the smallest (hash, key). ``key`` must be unique; rows that share one stand or
    fall together.

    The condition compares with the size-th smallest pair, so using it is a plain
    filter. That pair is found without a global order, by radix selection: see ``boundary``.
    """
    if size <= 0:
        return F.lit(False)
    bits = hash_bits(purpose, seed, F.col(key))
    hashed = df.select(bits.alias("bits"), F.col(key).alias("key"))
    found = boundary(hashed, size)
    if found is None:
        return F.lit(True)
    low, high, rank, _ = found
    # equal keys are one row with a weight
    near = hashed.where(F.col("bits").between(low, high)).groupBy("bits", "key").agg(F.count(F.lit(1)).alias("n"))
    up_to = F.sum("n").over(Window.partitionBy(F.lit(0)).orderBy("bits", "key"))
    last = near.select("bits", "key", "n", up_to.alias("up_to")).where(
        (F.col("up_to") >= rank) & (F.col("up_to") - F.col("n") < rank)
    ).first()
    pair = F.struct(bits.alias("bits"), F.col(key).alias("key"))
    kind = hashed.schema["key"].dataType
    return pair <= F.struct(F.lit(last.bits).cast("long").alias("bits"), F.lit(last.key).cast(kind).alias("key"))


def boundary(hashed: DataFrame, size: int) -> tuple[int, int, int, int] | None:
    """The hashes (from, to) among which the size-th smallest lies, its rank among them, and their
    number of rows; None if there are fewer rows.

    Rows are counted in 16,384 ranges of hashes; the one that holds the rank is cut again as long as it has
    more than ``RANKED`` rows and more than one hash. Each round reads the rows once and brings one
    row to the driver."""
    low, span, rank = 0, 1 << 32, size
    while True:
        step = max(1, span >> _DIGIT)
        part = hashed.where(F.col("bits").between(low, low + span - 1))
        place = F.floor((F.col("bits") - low) / step).alias("place")
        counts = part.groupBy(place).agg(F.count(F.lit(1)).alias("n"))
        # at most 16384 rows: a window over all of them is small
        up_to = F.sum("n").over(Window.orderBy("place"))
        holds = counts.select("place", "n", up_to.alias("up_to")).where(
            (F.col("up_to") >= rank) & (F.col("up_to") - F.col("n") < rank)
        )
        row = holds.first()
        if row is None:
            return None
        low, span, rank = low + row.place * step, step, rank - (row.up_to - row.n)
        if row.n <= RANKED or span == 1:
            return low, low + span - 1, rank, row.n


def hash_ranked(df: DataFrame, size: int, key: str, purpose: str, seed: int = 1) -> DataFrame:
    """Exactly ``size`` rows (or all, if fewer), without replacement."""
    return df.where(among_first(df, size, key, purpose, seed))


def extra_copy(df: DataFrame, rate: float, key: str, seed: int = 1) -> Column:
    """Which rows get one copy more than ``floor(rate)`` so that there are
    ``round(n * rate)`` copies altogether."""
    whole = int(rate)
    if rate == whole:
        return F.lit(False)
    n = df.count()
    return among_first(df, round_half_up(n * rate) - n * whole, key, "extra", seed)


def sample_copies(df: DataFrame, rate: float, key: str, seed: int = 1) -> DataFrame:
    """``round(n * rate)`` rows: each row ``floor(rate)`` times, and one more copy
    for a hash-ranked share. The copy number is in ``copy``. ``df`` is read up to four
    times; cut its lineage first if that is costly."""
    return with_copies(df, int(rate), extra_copy(df, rate, key, seed))


def with_copies(df: DataFrame, whole: int, extra: Column) -> DataFrame:
    copies = F.lit(whole) + F.coalesce(extra, F.lit(False)).cast("int")
    counted = df.withColumn("_copies", copies).where(F.col("_copies") > 0)
    numbers = F.explode(F.sequence(F.lit(1), F.col("_copies")))
    return counted.withColumn("copy", numbers).drop("_copies")


def round_half_up(x: float) -> int:
    return int(x + 0.5)


def class_counts(df: DataFrame, label: str) -> DataFrame:
    return df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
