"""Values that an expression uses several times."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value written into the plan once and computed once a row, however often it is used. Without
    this, nested calls double a plan's size again and again."""
    return F.get(F.transform(F.array(value), use), F.lit(0))
