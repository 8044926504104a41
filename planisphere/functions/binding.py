"""Values worked out once a row."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value bound, so that a body that uses it often does not repeat its expression."""
    return F.transform(F.array(value), body)[0]
