"""Expressions over long arrays that cost no more for each element than over short ones."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Elements that are folded, summed or cut together.
CHUNK = 256


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value), with value evaluated once for a row, however often f names it and wherever.

    A column made before and named once inside a lambda is no substitute: Spark moves its expression into the lambda, where it is
    evaluated for every element.
    """
    return F.get(F.transform(F.array(value), f), F.lit(0))


def chunks(array: Column, f: Callable[[Column, Column], Column]) -> Column:
    """f(slice, number) of each CHUNK elements."""
    last = F.floor((F.size(array) - 1) / CHUNK).cast("int")
    numbers = F.when(F.size(array) > 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))
    return F.transform(numbers, lambda k: let(F.slice(array, k * CHUNK + 1, F.lit(CHUNK)), lambda part: f(part, k)))


def total(sizes: Column) -> Column:
    return F.aggregate(sizes, F.lit(0).cast("long"), lambda n, x: n + x)


def before(sizes: Column) -> Column:
    """For each element of an array of up to CHUNK sizes, the sum of those before it."""
    return let(sizes, lambda s: F.transform(s, lambda _, i: total(F.slice(s, F.lit(1), i))))


def sums_before(sizes: Column) -> Column:
    """For each element of an array of any length, the sum of those before it."""

    def bound(sizes: Column) -> Column:
        of_chunk = chunks(sizes, lambda part, _: total(part))
        chunk_at = let(of_chunk, before)
        return let(chunk_at, lambda starts: F.flatten(chunks(sizes, lambda part, k: F.transform(before(part), lambda n: n + F.get(starts, k)))))

    return let(sizes, bound)
