"""Predicates that count only if there is a value to compare with."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F


def present(value: Any) -> bool:
    """None, blank text and empty lists say nothing."""
    return value is not None and not (isinstance(value, str) and not value.strip()) and not (isinstance(value, (list, tuple, set)) and not value)


def if_present(value: Any, predicate: Callable[[Any], Column]) -> Column:
    """predicate(value), or true for every row where there is no value; such a filter is gone from the plan."""
    return predicate(value) if present(value) else F.lit(True)


def list_filter(equal: dict[str, Any] = {}, like: dict[str, Any] = {}, within: dict[str, Any] = {}, between: dict[str, tuple] = {}) -> Column:
    """All of the conditions that have values: equality, contained text (as it is, without wildcards), membership, and ranges open at a missing end."""
    out = F.lit(True)
    for c, v in equal.items():
        out = out & if_present(v, lambda x, c=c: F.col(c) == x)
    for c, v in like.items():
        out = out & if_present(v, lambda x, c=c: F.col(c).contains(x))
    for c, v in within.items():
        out = out & if_present(v, lambda x, c=c: F.col(c).isin(*x))
    for c, (low, high) in between.items():
        out = out & if_present(low, lambda x, c=c: F.col(c) >= x) & if_present(high, lambda x, c=c: F.col(c) <= x)
    return out
