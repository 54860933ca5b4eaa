"""Vector expressions that stay inside generated code where rows are many."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def feature_array(names: list[str], first: int | None = None) -> Column:
    """The first ``first`` of the named columns as one array of doubles."""
    return F.expr("array(" + ", ".join(f"cast(`{n}` as double)" for n in names[:first]) + ")")


def is_finite(features: Column) -> Column:
    """True where the array exists and holds neither nulls, NaNs nor infinities."""
    finite = F.forall(features, lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False)))
    return F.coalesce(finite, F.lit(False))


def all_finite(names: list[str]) -> Column:
    """The same for scalar columns: plain comparisons, compiled with the scan."""
    return F.expr(" and ".join(f"abs(cast(`{n}` as double)) < double('infinity')" for n in names))
