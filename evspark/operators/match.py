"""Grouped threshold detection: groups of events, with their newest samples."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.fields import event_time, field
from ..functions.lineage import cut_lineage

SAMPLES, MOST_GROUPS = 5, 1000


def by_field(name: str) -> Column:
    return F.coalesce(field(name), F.lit("unknown"))


def by_capture(pattern: str) -> Column:
    """First group (else the whole) of the first match in raw, case-sensitive; `unknown` for none or an empty one."""
    group = 1 if re.compile(pattern).groups else 0
    return F.coalesce(F.nullif(F.regexp_extract("raw", "(?s)" + pattern, group), F.lit("")), F.lit("unknown"))


def match_groups(
    events: DataFrame, *conditions: Column, group: Column | None = None, after: str | None = None, threshold: int = 1, limit: int = MOST_GROUPS
) -> DataFrame:
    """group_key, n, first_at, last_at, sample_ids (newest SAMPLES), sample_raw (of the newest); most frequent first.

    Events at exactly `after` are not counted. Only SAMPLES rows of a group are gathered, by rank, and the
    counts come from partial aggregation, so a group may be of any size.
    """
    found = events
    for condition in conditions:
        found = found.filter(condition)
    if after is not None:
        found = found.filter(event_time() > F.lit(after).cast("timestamp"))
    # Written, since counts and samples both read them: the events are read once.
    found = cut_lineage(found.select((F.lit("all") if group is None else group).alias("group_key"), event_time().alias("at"), "id", "raw"))
    counts = found.groupBy("group_key").agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("first_at"), F.max("at").alias("last_at"), F.max(F.struct("at", "id", "raw")).alias("newest"))
    counts = counts.filter(F.col("n") >= threshold).orderBy(F.desc("n"), "group_key").limit(min(limit, MOST_GROUPS))
    rank = F.row_number().over(Window.partitionBy("group_key").orderBy(F.desc("at"), F.desc("id")))
    kept = F.broadcast(counts.select("group_key"))  # at most MOST_GROUPS rows
    some = found.select("group_key", "at", "id").join(kept, "group_key", "left_semi").withColumn("rank", rank).filter(F.col("rank") <= SAMPLES)
    samples = some.groupBy("group_key").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "id"))), lambda s: s["id"]).alias("sample_ids"))
    return counts.join(samples, "group_key").select("group_key", "n", "first_at", "last_at", "sample_ids", F.col("newest.raw").alias("sample_raw")).orderBy(F.desc("n"), "group_key")
