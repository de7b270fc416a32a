"""Bounded samples of labelled rows for fitting models."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def sample_per_label(rows: DataFrame, label: str, key: Column, limit: int) -> DataFrame:
    """About ``limit`` rows of each label: those whose hashed ``key`` falls below the label's share.

    The rows drawn depend on their keys alone, so reruns draw the same ones.
    """
    counts = {r[0]: r["count"] for r in rows.groupBy(label).count().collect()}
    spot = F.pmod(F.xxhash64(key), F.lit(1_000_000)) / 1e6
    chosen = F.lit(False)
    for value, n in sorted(counts.items(), key=lambda x: str(x[0])):
        chosen = chosen | ((F.col(label) == F.lit(value)) & (spot < min(1.0, limit / n)))
    return rows.where(chosen)
