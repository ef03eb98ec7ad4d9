"""Temperatures of chains, as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def temperature(chain: Column, chains: Column | int, cold: int, hottest: float) -> Column:
    """Of chain 1 .. chains: 1 for the first `cold` ones, then equal ratios up to the hottest."""
    n = F.lit(chains) if isinstance(chains, int) else chains
    return F.when(chain <= cold, 1.0).otherwise(F.pow(F.lit(float(hottest)), (chain - cold) / F.greatest(n - cold, F.lit(1))))
