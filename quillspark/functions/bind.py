"""A value bound to a name inside an expression."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once a row, also where body uses it inside a lambda.

    A plain expression inside a lambda is computed again for every element, and
    a column made beforehand is put back in its place by the optimiser.
    """
    return F.element_at(F.transform(F.array(value), body), 1)
