"""Functions that take Columns or numpy arrays, so that one formula serves plans and samplers alike."""

from __future__ import annotations

from contextlib import contextmanager
from contextvars import ContextVar

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

ARRAYS: ContextVar[dict | None] = ContextVar("arrays", default=None)


@contextmanager
def arrays(columns: dict[str, np.ndarray]):
    """While it lasts, col() gives these arrays, and lit() plain numbers."""
    token = ARRAYS.set(columns)
    try:
        yield
    finally:
        ARRAYS.reset(token)


def col(name: str):
    known = ARRAYS.get()
    return F.col(name) if known is None else known[name]


def lit(x):
    return F.lit(x) if ARRAYS.get() is None else x


def both(spark, numpy):
    return lambda *x: spark(*x) if any(isinstance(v, Column) for v in x) else numpy(*x)


sin, cos, sqrt = both(F.sin, np.sin), both(F.cos, np.cos), both(F.sqrt, np.sqrt)
asin, atan, atan2 = both(F.asin, np.arcsin), both(F.atan, np.arctan), both(F.atan2, np.arctan2)


def choose(condition, yes, no):
    """yes where the condition holds, else no."""
    return F.when(condition, yes).otherwise(no) if isinstance(condition, Column) else np.where(condition, yes, no)
