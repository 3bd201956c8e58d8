"""Indicators of compromise: candidates of events joined with indicators, and the alerts that they raise."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.lineage import cut_lineage
from ..functions.security import candidates

SAMPLES, SAMPLE_CHARS = 5, 300
# Fixed value: the rule name of the alerts.
RULE = "IOC match"


def active(indicators: DataFrame, now: str | None = None) -> DataFrame:
    """Indicators that are enabled and, where the library has such a column, not expired by now."""
    found = indicators.filter(F.col("enabled"))
    if now is None or "expires_at" not in indicators.columns:
        return found
    return found.filter(F.col("expires_at").isNull() | (F.col("expires_at") > F.lit(now).cast("timestamp")))


def matches(events: DataFrame, indicators: DataFrame) -> DataFrame:
    """Event and indicator pairs: id, received_at, raw, key, source, severity. Each pair once.

    Whether the indicators are broadcast is Spark's choice by their size. Of several indicators of one key the one of the
    smallest source and severity names it.
    """
    each = events.select("id", "received_at", "raw", F.explode(candidates(F.col("raw"))).alias("key"))
    keys = active(indicators).select(F.concat("type", F.lit(":"), F.lower("value")).alias("key"), "source", "severity")
    keys = keys.groupBy("key").agg(F.min(F.struct("source", "severity")).alias("s")).select("key", "s.*")
    return each.join(keys, "key")


def matched(events: DataFrame, indicators: DataFrame) -> DataFrame:
    """Per indicator: n events, first_at, last_at and the first SAMPLES events in order of arrival.

    The pairs are found once and written, since counts and samples both read them.
    """
    found = cut_lineage(matches(events, indicators).withColumn("raw", F.left("raw", F.lit(SAMPLE_CHARS))))
    sample = F.struct("received_at", "id", "raw")
    counts = found.groupBy("key", "source", "severity").agg(F.count(F.lit(1)).alias("n"), F.min("received_at").alias("first_at"), F.max("received_at").alias("last_at"), F.min(sample).alias("first"))
    rank = F.row_number().over(Window.partitionBy("key").orderBy("received_at", "id"))
    some = found.select("key", "received_at", "id").withColumn("rank", rank).filter(F.col("rank") <= SAMPLES)
    ids = some.groupBy("key").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "id"))), lambda s: s["id"]).alias("sample_ids"))
    return counts.join(ids, "key").select("key", "source", "severity", "n", "first_at", "last_at", "sample_ids", F.col("first.raw").alias("sample_raw"))


def group_key(key: Column) -> Column:
    return F.concat(F.lit("ioc:"), key)


def changed(alerts: DataFrame, found: DataFrame, now: str) -> DataFrame:
    """The alerts that a scan (found: as `matched` gives) moves or makes, as they are after it.

    The hits of an indicator are added to the count of its open or acknowledged alert, the one of smallest id if there are
    several, whose last event moves; indicators without such an alert get a new one. `alerts` needs to hold only those of
    the groups found.
    """
    at = F.lit(now).cast("timestamp")
    mine = alerts.filter((F.col("rule_name") == RULE) & F.col("status").isin("open", "acknowledged"))
    mine = mine.groupBy(F.col("group_key").alias("open_key")).agg(F.min_by(F.struct(*alerts.columns), "id").alias("open"))
    hits = found.withColumn("open_key", group_key(F.col("key"))).join(mine, "open_key", "left")
    moved = {"event_count": F.col("open.event_count") + F.col("n"), "last_event_at": F.col("last_at")}
    new = {
        "id": F.sha2(F.concat_ws("|", F.lit(RULE), "open_key", F.lit(now)), 256), "rule_name": F.lit(RULE), "group_key": F.col("open_key"), "severity": F.col("severity"),
        "status": F.lit("open"), "event_count": F.col("n"), "first_event_at": F.col("first_at"), "last_event_at": F.col("last_at"), "created_at": at,
    }
    value = lambda c: F.when(F.col("open").isNotNull(), moved.get(c, F.col(f"open.{c}"))).otherwise(new.get(c, F.lit(None))).cast(alerts.schema[c].dataType)
    return hits.select(*[value(c).alias(c) for c in alerts.columns])


def alerted(alerts: DataFrame, found: DataFrame, now: str) -> tuple[DataFrame, DataFrame]:
    """All alerts after a scan, as `changed` has it, and the new ones among them."""
    rows = changed(alerts, found, now)
    new = rows.join(alerts.select("id"), "id", "left_anti").select(*alerts.columns)
    return alerts.join(rows.select("id"), "id", "left_anti").select(*alerts.columns).unionByName(rows), new
