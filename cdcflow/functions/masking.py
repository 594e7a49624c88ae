"""Masking of personal columns. Strategies are native expressions on whole columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

STAR = "*"


def keep_ends(value: Column, prefix: int, suffix: int, middle: Column | None = None) -> Column:
    """The first and last characters, stars between (as many as are hidden, or `middle`); a value too short to hide anything is all stars."""
    n = F.length(value)
    stars = F.repeat(F.lit(STAR), n - prefix - suffix) if middle is None else middle
    return F.when(n <= prefix + suffix, F.repeat(F.lit(STAR), n)).otherwise(F.concat(F.substring(value, 1, prefix), stars, F.substring(value, F.lit(1) + n - suffix, F.lit(suffix)) if suffix else F.lit("")))


def fixed_mask(value: Column, prefix: int, suffix: int, stars: int) -> Column:
    """Four rules by length: blank as it is; up to prefix: all stars; up to prefix + suffix: the prefix and stars; longer: prefix, `stars` stars, suffix."""
    n = F.length(value)
    return (
        F.when(value.isNull() | (F.trim(value) == ""), value).when(n <= prefix, F.repeat(F.lit(STAR), n)).when(n <= prefix + suffix, F.concat(F.substring(value, 1, prefix), F.repeat(F.lit(STAR), n - prefix)))
        .otherwise(F.concat(F.substring(value, 1, prefix), F.lit(STAR * stars), F.substring(value, n - suffix + 1, F.lit(suffix))))
    )


def high_security_mask(value: Column, prefix: int, suffix: int) -> Column:
    """Three rules by length: up to prefix: all stars; up to prefix + suffix: all but `prefix` leading characters, then `prefix` stars; longer: the ends, stars between."""
    n = F.length(value)
    return (
        F.when(value.isNull() | (F.trim(value) == ""), value).when(n <= prefix, F.repeat(F.lit(STAR), n)).when(n <= prefix + suffix, F.concat(F.substring(value, F.lit(1), n - prefix), F.lit(STAR * prefix)))
        .otherwise(F.concat(F.substring(value, 1, prefix), F.repeat(F.lit(STAR), n - prefix - suffix), F.substring(value, n - suffix + 1, F.lit(suffix))))
    )


def masked(value: Column, strategy: str) -> Column:
    """value masked by a named strategy; null stays null."""
    n = F.length(value)
    rules = {
        "ID_CARD": lambda: keep_ends(value, 3, 4),
        "PHONE": lambda: keep_ends(value, 3, 4),
        "FIXED_PHONE": lambda: keep_ends(value, 4, 2),
        "ADDRESS": lambda: F.when(n <= 8, F.repeat(F.lit(STAR), n)).otherwise(F.concat(F.substring(value, F.lit(1), n - 8), F.lit(STAR * 8))),
        "EMAIL": lambda: F.when(F.instr(value, "@") <= 1, value).otherwise(F.concat(F.substring(value, 1, 1), F.repeat(F.lit(STAR), F.instr(value, "@") - 2), F.substring(value, F.instr(value, "@"), n))),
        "BANK_CARD": lambda: keep_ends(value, 4, 4),
        "NAME": lambda: F.when(n <= 1, value).otherwise(F.concat(F.substring(value, 1, 1), F.repeat(F.lit(STAR), n - 1))),
        "USER_ID": lambda: F.lit("0"),
        "PASSWORD": lambda: F.repeat(F.lit(STAR), n),
        "IPV4": lambda: F.regexp_replace(value, r"^(\d+)\.\d+\.\d+\.\d+$", "$1.*.*.*"),
        "IPV6": lambda: F.regexp_replace(value, r"^([0-9A-Fa-f]*):.*$", "$1:*:*:*:*:*:*:*"),
        "CAR_LICENSE": lambda: keep_ends(value, 3, 1),
        "FIRST": lambda: F.concat(F.substring(value, 1, 1), F.repeat(F.lit(STAR), n - 1)),
        "PASSPORT": lambda: keep_ends(value, 2, 2),
        "STRING": lambda: fixed_mask(value, 4, 4, 4),
        "HIGH_SECURITY": lambda: high_security_mask(value, 4, 4),
        "CLEAR": lambda: F.lit(""),
        "CLEAR_TO_NULL": lambda: F.lit(None).cast("string"),
    }
    return F.when(value.isNotNull(), rules[strategy]())
