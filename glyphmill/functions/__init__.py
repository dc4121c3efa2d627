"""Column expressions: every function here takes and gives Columns, and stays inside the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value evaluated once. Inside a lambda, an outer expression would be evaluated again for every element."""
    return F.element_at(F.transform(F.array(value), body), 1)
