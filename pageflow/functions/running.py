"""Running sums and maxima of an array, as column expressions.

Each round combines every value with what stands 1, 2, 4, ... places before, so
n values take n log n steps and nothing is appended to.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def _doubled(values: Column, combine: Callable[[Column, Column], Column]) -> Column:
    rounds = F.ceil(F.log2(F.greatest(F.size(values), F.lit(2)))).cast("int")

    def step(acc: Column, k: Column) -> Column:
        back = F.call_function("shiftleft", F.lit(1), k)
        return F.transform(acc, lambda x, i: combine(x, F.get(acc, i - back)))

    return F.aggregate(F.sequence(F.lit(0), rounds - 1), values, step)


def running_sums(values: Column) -> Column:
    """Sums of an array<bigint> up to each place."""
    return _doubled(values, lambda x, before: x + F.coalesce(before, F.lit(0).cast("bigint")))


def running_max(values: Column) -> Column:
    """Maxima of an array<int> up to each place."""
    return _doubled(values, lambda x, before: F.greatest(x, before))  # skips NULL
