"""Weekly send slots."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def weekly_slot(ts: str | Column) -> Column:
    """1 to 28: Monday first, four stretches of three hours a day from 9 to 21; null outside and for null."""
    ts = F.col(ts) if isinstance(ts, str) else ts
    return F.when(F.hour(ts).between(9, 20), F.weekday(ts) * 4 + F.floor((F.hour(ts) - 9) / 3) + 1).cast("int")


def same_slot(a: str, b: str) -> Column:
    """1 if both slots are equal; 0 otherwise, also where both are null."""
    return F.coalesce((F.col(a) == F.col(b)).cast("int"), F.lit(0))
