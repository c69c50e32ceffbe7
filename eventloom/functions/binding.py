"""Names for values inside one expression."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` in which the value stands once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), 0)
