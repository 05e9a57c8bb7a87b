"""Steps over arrays: values that are used more than once, and paths of their items."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value), with the value worked out once for each row: as the one item of an array that is transformed."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def numbered_path(pattern: str, index: Column) -> Column:
    """A path with the index in place of #, null without one. For lambdas: concat isn't compiled there and takes a lazy list for each call."""
    return F.replace(F.lit(pattern), F.lit("#"), index.cast("string"))
