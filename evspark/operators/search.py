"""Searches over events: conditions, text projections, aggregates, order and limit, as one lazy DataFrame."""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from datetime import datetime

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from ..functions.fields import default_alias, event_time, number
from ..functions.fields import field as text_of

#: Rows returned when no limit is given, and at most.
DEFAULT_LIMIT, MOST_ROWS = 1000, 5000


def aggregate(function: str, name: str | None = None) -> Column:
    """count, count_distinct (exact), sum, min, max or avg of a field; the last four use number-looking text only."""
    if function == "count":
        return F.count(F.lit(1) if name is None else text_of(name))
    if name is None:
        raise ValueError(f"{function} needs a field")
    if function == "count_distinct":
        return F.count_distinct(text_of(name))
    return {"sum": F.sum, "min": F.min, "max": F.max, "avg": F.avg}[function](number(text_of(name)))


@dataclass(frozen=True)
class Search:
    """A search in the making; every method returns a new one and `frame` the DataFrame.

    Conditions add up. The last fields, comp, sort and limit win. Without `sort`, rows come newest first,
    and groups by their last aggregate, largest first and nulls before all; ties fall to id and to keys.
    """

    events: DataFrame
    conditions: tuple[Column, ...] = ()
    columns: dict[str, str] = field(default_factory=dict)
    aggregates: dict[str, Column] = field(default_factory=dict)
    keys: tuple[str, ...] = ()
    order: tuple[tuple[str, bool], ...] = ()
    rows: int | None = DEFAULT_LIMIT

    def where(self, *conditions: Column) -> Search:
        return replace(self, conditions=self.conditions + conditions)

    def between(self, start: datetime | str, end: datetime | str) -> Search:
        """Events from start to end, both included."""
        return self.where(event_time().between(F.lit(start).cast("timestamp"), F.lit(end).cast("timestamp")))

    def fields(self, *names: str, **aliases: str) -> Search:
        """Project to text: names as they are, and alias=name."""
        return replace(self, columns={n: n for n in names} | aliases)

    def comp(self, *by: str, **aggregates: tuple[str, str] | str) -> Search:
        """Group by text fields; alias=(function, field), or 'count' for the number of rows."""
        made = {alias: aggregate(a) if isinstance(a, str) else aggregate(*a) for alias, a in aggregates.items()}
        return replace(self, aggregates=made, keys=by)

    def sort(self, *keys: str | tuple[str, str], ascending: bool = False) -> Search:
        """By keys in the given direction, or pairs of a key and `asc` or `desc`. Nulls come last either way."""
        pairs = [(k, ascending) if isinstance(k, str) else (k[0], k[1] == "asc") for k in keys]
        return replace(self, order=tuple(pairs))

    def limit(self, rows: int) -> Search:
        return replace(self, rows=max(1, min(MOST_ROWS, int(rows))))

    def unlimited(self) -> Search:
        """All rows or groups; such a search has no pages."""
        return replace(self, rows=None)

    def _first(self, ordered: DataFrame, extra: int) -> DataFrame:
        return ordered if self.rows is None else ordered.limit(self.rows + extra)

    def _ordered(self, extra: int) -> DataFrame:
        found = self.events
        for condition in self.conditions:
            found = found.filter(condition)
        last = [F.col(k).asc_nulls_last() if up else F.col(k).desc_nulls_last() for k, up in self.order]
        if self.aggregates:
            keys = [text_of(k).alias(k) for k in self.keys]
            aggregates = [a.alias(n) for n, a in self.aggregates.items()]
            found = found.groupBy(*keys).agg(*aggregates) if keys else found.agg(*aggregates)
            default = [F.col(list(self.aggregates)[-1]).desc_nulls_first()]
            return self._first(found.orderBy(*(last or default), *[F.col(f"`{k}`").asc_nulls_first() for k in self.keys]), extra)
        by = [text_of(k).asc_nulls_last() if up else text_of(k).desc_nulls_last() for k, up in self.order]
        found = self._first(found.orderBy(*(by or [event_time().desc()]), F.col("id").desc()), extra)
        if self.columns:
            return found.select(*[text_of(name).alias(alias) for alias, name in self.columns.items()])
        return found.select(F.col("id").alias("_id"), event_time().alias("_time"), "source_type", "collector_id", F.col("raw").alias("_raw"), "parsed")

    def frame(self) -> DataFrame:
        return self._ordered(0)

    def page(self) -> tuple[list[Row], bool]:
        """At most the limit's rows, and whether there were more."""
        if self.rows is None:
            raise ValueError("a page needs a limit")
        rows = self._ordered(1).collect()
        return rows[: self.rows], len(rows) > self.rows


def alias_of(function: str, name: str | None = None) -> str:
    return default_alias(function, name)


def frequent_columns(rows: DataFrame, most: int = 40) -> DataFrame:
    """The top-level keys that are in most documents of a result."""
    keys = rows.select(F.explode(F.json_object_keys("parsed")).alias("name"))
    return keys.groupBy("name").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "name").limit(most)
