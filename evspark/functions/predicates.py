"""Conditions on fields, with the three-valued meaning that `not` and missing fields need.

`equals` is null for a missing field, so its negation drops such rows; all others are true or false.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .fields import field, number


def equals(name: str, value: str) -> Column:
    return field(name) == F.lit(value)


def differs(name: str, value: str) -> Column:
    """True for a missing field too."""
    return ~field(name).eqNullSafe(F.lit(value))


def missing(name: str) -> Column:
    return field(name).isNull()


def present(name: str) -> Column:
    return field(name).isNotNull()


def _sure(condition: Column) -> Column:
    return F.coalesce(condition, F.lit(False))


def contains(name: str, part: str) -> Column:
    """Literal substring, whatever its case."""
    return _sure(F.contains(F.lower(field(name)), F.lower(F.lit(part))))


def one_of(name: str, values: list[str]) -> Column:
    return _sure(field(name).isin(values)) if values else F.lit(False)


def matches(name: str, pattern: str) -> Column:
    """Anywhere in the text, ignoring case, a dot matching newlines too."""
    return _sure(field(name).rlike("(?isu)" + pattern))


def above(name: str, value: float) -> Column:
    return _sure(number(field(name)) > value)


def at_least(name: str, value: float) -> Column:
    return _sure(number(field(name)) >= value)


def below(name: str, value: float) -> Column:
    return _sure(number(field(name)) < value)


def at_most(name: str, value: float) -> Column:
    return _sure(number(field(name)) <= value)


def dataset(*names: str) -> Column:
    """Events of these source types; `*` in a name stands for anything, other characters for themselves."""
    if any(set(n) == {"*"} for n in names):
        return F.lit(True)
    exact = [n for n in names if "*" not in n]
    condition = F.col("source_type").isin(exact) if exact else F.lit(False)
    for n in names:
        if "*" in n:
            escaped = n.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_").replace("*", "%")
            condition |= F.col("source_type").like(escaped)
    return condition
