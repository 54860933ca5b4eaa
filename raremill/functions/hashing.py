"""Randomness keyed by row id and seed.

Every random choice is a hash of (purpose, seed, row key). The outcome depends
neither on partitioning nor on which attempt of a task produced the row, so a
stage recomputed after an executor is lost repeats itself exactly.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_RANGE = 4294967296.0


def hash_bits(purpose: str, seed: int, *keys: Column) -> Column:
    """An integer in [0, 2**32) from the first eight hex digits of an MD5."""
    text = F.concat_ws(":", F.lit(purpose), F.lit(str(seed)), *[k.cast("string") for k in keys])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")


def hash_uniform(purpose: str, seed: int, *keys: Column) -> Column:
    """A double in [0, 1)."""
    return hash_bits(purpose, seed, *keys) / F.lit(_RANGE)


def keyed_uuid(purpose: str, seed: int, *keys: Column) -> Column:
    """A 36-character identifier that a retried task reproduces, unlike ``uuid()``."""
    text = F.concat_ws(":", F.lit(purpose), F.lit(str(seed)), *[k.cast("string") for k in keys])
    digest = F.md5(text)
    cuts = [(1, 8), (9, 4), (13, 4), (17, 4), (21, 12)]
    return F.concat_ws("-", *[F.substring(digest, start, size) for start, size in cuts])
