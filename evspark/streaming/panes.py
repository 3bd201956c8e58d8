"""Partial groups of rules by the minute, which sliding windows are combined from."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from ..functions.fields import event_time
from ..functions.lineage import cut_lineage
from ..operators import cycle
from ..operators.match import MOST_GROUPS, SAMPLES
from ..operators.rulesets import Detection
from ..sources.changes import ChangeLog

PANE = "day string, rule_id string, group_key string, minute timestamp, n long, first_at timestamp, last_at timestamp, newest array<struct<at timestamp, id string, raw string>>"
_KEY = ["day", "rule_id", "group_key", "minute"]


def minute_of(at: Column) -> Column:
    """The end of the minute that a time belongs to. A full minute is an end, so that a window of whole minutes is open at its beginning."""
    return F.timestamp_micros((F.ceil(F.unix_micros(at) / F.lit(60_000_000)) * 60_000_000).cast("long"))


def _first(rows: DataFrame, key: list[str]) -> DataFrame:
    """Of each key the newest SAMPLES of a column `event`, as the array newest. Gathered by rank, so a key may have any number."""
    rank = F.row_number().over(Window.partitionBy(*key).orderBy(F.desc("event.at"), F.desc("event.id")))
    some = rows.select(*key, "event").withColumn("rank", rank).filter(F.col("rank") <= SAMPLES)
    return some.groupBy(*key).agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "event"))), lambda s: s["event"]).alias("newest"))


def combined(panes: DataFrame, key: list[str]) -> DataFrame:
    """Partial groups summed up by a key; associative, so any order of combining gives the same."""
    counts = panes.groupBy(*key).agg(F.sum("n").alias("n"), F.min("first_at").alias("first_at"), F.max("last_at").alias("last_at"))
    return counts.join(_first(panes.select(*key, F.explode("newest").alias("event")), key), key)


def panes_of(pairs: DataFrame) -> DataFrame:
    """Partial groups of the pairs that `cycle.matched` gives. Pairs are dealt once: their ranks, counts and newest events come from the same order."""
    minute = minute_of(F.col("at"))
    rows = pairs.select(F.date_format(minute, "yyyy-MM-dd").alias("day"), "rule_id", "group_key", minute.alias("minute"), F.struct("at", "id", "raw").alias("event"))
    rank = F.row_number().over(Window.partitionBy(*_KEY).orderBy(F.desc("event.at"), F.desc("event.id")))
    some = F.array_sort(F.collect_list(F.when(F.col("rank") <= SAMPLES, F.struct("rank", "event"))))
    return rows.withColumn("rank", rank).groupBy(*_KEY).agg(
        F.count(F.lit(1)).alias("n"), F.min("event.at").alias("first_at"), F.max("event.at").alias("last_at"), F.transform(some, lambda s: s["event"]).alias("newest")
    )


def added(made: DataFrame, before: DataFrame) -> DataFrame:
    """The panes made, each with the one that was there under its key. Both have a row for each key."""
    old = before.select(*_KEY, F.struct("n", "first_at", "last_at", "newest").alias("old"))
    newest = F.slice(F.sort_array(F.concat("newest", F.coalesce("old.newest", F.array().cast(made.schema["newest"].dataType))), asc=False), 1, SAMPLES)
    return made.join(old, _KEY, "left").select(
        *_KEY, (F.col("n") + F.coalesce("old.n", F.lit(0))).alias("n"), F.least("first_at", "old.first_at").alias("first_at"), F.greatest("last_at", "old.last_at").alias("last_at"), newest.alias("newest")
    )


class Panes:
    """Panes of a set of rules in a folder, corrected by each batch of events, however late, and blind to events that come again.

    A batch reads its events, the ids and the panes of the days that they are of, and writes the panes that changed. Ids of events
    that fit a rule are kept by day for that. Both go with `forget`.
    """

    def __init__(self, spark: SparkSession, path: str, rules: Sequence[Detection]):
        self.spark, self.rules = spark, list(rules)
        self.panes = ChangeLog(spark, f"{path}/panes", PANE, _KEY, ["day"])
        self.seen = ChangeLog(spark, f"{path}/seen", "day string, id string", ["day", "id"], ["day"])

    def add(self, number: int, events: DataFrame) -> None:
        """Take in a batch; the same number again replaces it."""
        events = events.filter(event_time().isNotNull())
        day = lambda at: F.date_format(minute_of(at), "yyyy-MM-dd").alias("day")
        days = cut_lineage(events.select(day(event_time())).distinct())
        # Events are dealt once, by day and id, before they become pairs: those seen go, and so do repeats within the batch.
        fitting = cycle.fitting(events, self.rules) if self.rules else self.spark.createDataFrame([], "at timestamp, id string, raw string, pairs array<struct<rule_id string, group_key string>>")
        dealt = fitting.withColumn("day", day(F.col("at"))).repartition("day", "id")
        new = dealt.join(self.seen.latest(number, days), ["day", "id"], "left_anti")
        each = new.select("day", "at", "id", "raw", F.posexplode("pairs").alias("place", "pair")).select("day", "pair.rule_id", "pair.group_key", "at", "id", "raw", "place")
        pairs = cut_lineage(each.dropDuplicates(["day", "id", "at", "rule_id", "group_key"]))
        self.panes.append(number, added(panes_of(pairs), self.panes.latest(number, days)))
        # The first rule that any copy of an event fits is first in each copy that fits it: every id has such a row.
        self.seen.append(number, pairs.filter(F.col("place") == 0).select("day", "id"))

    def hits(self, now: str, before: int | None = None, limit: int = MOST_GROUPS) -> DataFrame:
        """What `cycle.hits` gives for all events taken in (by the batches before a number), for a full minute `now`."""
        at = F.lit(now).cast("timestamp")
        rules = cycle.settings(self.spark, self.rules)
        since = F.date_format(at - cycle.minutes(max([r.window_minutes for r in self.rules], default=0)), "yyyy-MM-dd")
        # Each rule's window is a condition on keys, so that only panes within it are merged.
        windows = sorted({r.window_minutes for r in self.rules})
        within = [F.col("rule_id").isin([r.name for r in self.rules if r.window_minutes == w]) & (F.col("minute") > at - cycle.minutes(w)) for w in windows]
        live = self.panes.latest(before, where=(F.col("day") >= since) & reduce(lambda x, y: x | y, within, F.lit(False)))
        found = combined(cut_lineage(live), ["rule_id", "group_key"])
        out = cycle.over_threshold(found, rules, limit)
        return out.select(*[c for c in out.columns if c != "newest"], F.transform("newest", lambda e: e["id"]).alias("sample_ids"), F.get("newest", F.lit(0))["raw"].alias("sample_raw"))

    def forget(self, day: str, keep: int = 2) -> None:
        """Merge the batches but the last ones, without what is of days before this one."""
        self.panes.compact(keep, F.col("day") >= day)
        self.seen.compact(keep, F.col("day") >= day)
