"""Evaluate an expression once and use its value several times."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once per row.

    Inside a lambda over an array, a plain expression would be computed again
    for every element, which turns linear work into quadratic.
    """
    return F.get(F.transform(F.array(value), use), F.lit(0))
