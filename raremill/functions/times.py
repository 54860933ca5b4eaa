"""Time helpers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def second_of_day(ts: Column) -> Column:
    """Seconds since local midnight, as an int feature."""
    return F.hour(ts) * 3600 + F.minute(ts) * 60 + F.second(ts)


def run_stamp(ts: Column) -> Column:
    """``dd/MM/yyyy HH:mm:ss:`` followed by the milliseconds padded to seven digits."""
    millis = F.substring(F.date_format(ts, "SSSSSS"), 1, 3)
    return F.concat(F.date_format(ts, "dd/MM/yyyy HH:mm:ss:"), F.lpad(millis, 7, "0"))


def now_millis() -> Column:
    return F.unix_millis(F.current_timestamp())
