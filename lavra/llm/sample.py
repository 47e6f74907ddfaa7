"""Bounded samples for fitting models on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Range of the hash that decides, and the surplus that makes falling short of the bound unlikely.
RANGE, SURPLUS = 1 << 30, 1.3


def bounded_sample(df: DataFrame, key: str, size: int, seed: int, order: list[str], total: int | None = None) -> DataFrame:
    """At most ``size`` rows, those of least hash of ``key``.

    Rows are thinned by hash where they are read, so that the driver gets about
    ``size`` rows in all, not ``size`` from each partition.
    """
    total = df.count() if total is None else total
    h = F.pmod(F.xxhash64(F.col(key).cast("string"), F.lit(seed)), F.lit(RANGE))
    if total > size:
        df = df.filter(h < int(min(1.0, SURPLUS * size / total) * RANGE))
    return df.orderBy(h, *order).limit(size)
