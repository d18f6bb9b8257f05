"""Bounded samples by the least hashes, of which no partition sends more than its share."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: So many times the rows wanted are let through before the least hashes are taken.
SPARE = 1.5


def least_hashes(rows: DataFrame, by: str, n: int, want: int) -> DataFrame:
    """Up to want of n rows, those with the least hash in column by (64 bits, spread evenly). Only hashes below a threshold, set from n,
    are sorted, so what reaches one task is about SPARE * want rows whatever the number of partitions."""
    share = SPARE * want / max(n, 1)
    if share < 1:
        rows = rows.where(F.col(by) < F.lit(int(-(1 << 63) + share * (1 << 64))))
    return rows.orderBy(by).limit(want)
