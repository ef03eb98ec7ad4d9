"""A value with a name inside an expression."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value evaluated once for each row, however often body (or a function inside it) uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))
