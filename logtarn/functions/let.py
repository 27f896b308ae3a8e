"""Bind an expression to a name inside an expression."""

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once, however often ``body`` refers to it.

    A lambda that captures a computed column computes it again for each array element. Bound
    as a lambda variable it is computed once per row.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))
