"""What dashboards and jobs read from stored events: counts, ranges, pages, field statistics, retention."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.fields import event_time
from ..functions.lineage import cut_lineage
from ..sources.envelope import depth

MOST_GROUPS = 1000


def _at(t: str | Column) -> Column:
    return (F.lit(t) if isinstance(t, str) else t).cast("timestamp")


def filtered(events: DataFrame, since: str | None = None, until: str | None = None, source_type: str | None = None, collector_id: str | None = None) -> DataFrame:
    """By arrival: since included, until excluded."""
    for value, condition in (
        (since, lambda v: F.col("received_at") >= _at(v)),
        (until, lambda v: F.col("received_at") < _at(v)),
        (source_type, lambda v: F.col("source_type") == v),
        (collector_id, lambda v: F.col("collector_id") == v),
    ):
        if value is not None:
            events = events.filter(condition(value))
    return events


def day() -> Column:
    return F.date_format("received_at", "yyyy-MM-dd")


def group_counts(events: DataFrame, by: str) -> DataFrame:
    """key, n, first_at and last_at by collector_id, source_type or day; rows without a key are left out."""
    key = day() if by == "day" else F.col(by)
    found = events.select(key.alias("key"), "received_at").filter(F.col("key").isNotNull()).groupBy("key")
    found = found.agg(F.count(F.lit(1)).alias("n"), F.min("received_at").alias("first_at"), F.max("received_at").alias("last_at"))
    return found.orderBy("key") if by == "day" else found.orderBy(F.desc("n"), "key").limit(MOST_GROUPS)


def source_types(events: DataFrame, since: str, most: int = 100) -> DataFrame:
    return filtered(events, since).select("source_type").distinct().orderBy("source_type").limit(most)


def time_range(events: DataFrame) -> DataFrame:
    return events.agg(F.min("received_at").alias("first_at"), F.max("received_at").alias("last_at"))


def data_sources(events: DataFrame, recent_after: str) -> DataFrame:
    """Per source type and collector: total, recent (event time after the cutoff) and last_at; latest first."""
    recent = F.count_if(event_time() > _at(recent_after))
    found = events.groupBy("source_type", "collector_id").agg(F.count(F.lit(1)).alias("total"), recent.alias("recent"), F.max("received_at").alias("last_at"))
    return found.orderBy(F.desc("last_at"), "source_type", F.asc_nulls_last("collector_id")).limit(MOST_GROUPS)


def ingestion_totals(events: DataFrame, now: str) -> DataFrame:
    """Of the 24 hours before now: events, bytes of raw, events of the last hour by arrival, sources, collectors, last_at."""
    last = events.filter(event_time() > _at(now) - F.expr("interval 24 hours"))
    return last.agg(
        F.count(F.lit(1)).alias("events"),
        F.coalesce(F.sum(F.octet_length("raw").cast("long")), F.lit(0)).alias("bytes"),
        F.count_if(F.col("received_at") > _at(now) - F.expr("interval 1 hour")).alias("events_1h"),
        F.count_distinct("source_type").alias("sources"),
        F.count_distinct("collector_id").alias("collectors"),
        F.max("received_at").alias("last_at"),
    )


def hourly(events: DataFrame, now: str, hours: int = 24) -> DataFrame:
    """Events and bytes of each whole hour up to the one of now, zero where there are none."""
    end = F.date_trunc("hour", _at(now))
    first = end - F.make_dt_interval(F.lit(0), F.lit(hours - 1))
    spine = events.sparkSession.range(1).select(F.explode(F.sequence(first, end, F.expr("interval 1 hour"))).alias("hour"))
    found = events.filter(event_time() >= first).groupBy(F.date_trunc("hour", event_time()).alias("hour"))
    found = found.agg(F.count(F.lit(1)).alias("events"), F.sum(F.octet_length("raw").cast("long")).alias("bytes"))
    return F.broadcast(spine).join(found, "hour", "left").select("hour", F.coalesce("events", F.lit(0)).alias("events"), F.coalesce("bytes", F.lit(0)).alias("bytes"))


def daily(events: DataFrame, now: str, days: int = 14) -> DataFrame:
    """Events by arrival of each of the last days, zero where there are none."""
    end = F.to_date(_at(now))
    spine = events.sparkSession.range(1).select(F.explode(F.sequence(F.date_sub(end, days - 1), end)).alias("d"))
    spine = spine.select(F.date_format("d", "yyyy-MM-dd").alias("day"))
    found = events.filter(F.col("received_at") >= F.date_sub(end, days - 1).cast("timestamp")).groupBy(day().alias("day")).agg(F.count(F.lit(1)).alias("n"))
    return spine.join(found, "day", "left").select("day", F.coalesce("n", F.lit(0)).alias("n"))


def ingestion_groups(events: DataFrame, now: str, by: str, most: int = 12) -> DataFrame:
    last = events.filter(event_time() > _at(now) - F.expr("interval 24 hours"))
    found = last.groupBy(F.coalesce(by, F.lit("(none)")).alias("key")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("raw").cast("long")).alias("bytes"))
    return found.orderBy(F.desc("n"), "key").limit(most)


def field_keys(events: DataFrame, newest: int = 2000, most: int = 200) -> DataFrame:
    """Top-level keys of the newest documents and how many have them."""
    some = events.orderBy(F.desc("received_at"), F.desc("id")).limit(newest)
    keys = some.select(F.explode(F.json_object_keys("parsed")).alias("name"))
    return keys.groupBy("name").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "name").limit(most)


#: Levels of keys that are followed.
MOST_LEVELS = 20


def leaf_paths(events: DataFrame, root: str = "xdm", newest: int = 500, most: int = 500) -> DataFrame:
    """Dotted paths of leaves under a key of the newest documents that have an object there; arrays are leaves, empty objects have none.

    The documents are taken apart level by level as variants, as many levels as the deepest of these few has.
    """
    doc = F.get_json_object("parsed", f"$.{root}")
    some = events.filter(doc.startswith("{")).orderBy(F.desc("received_at"), F.desc("id")).limit(newest).select(doc.alias("doc"))
    some = cut_lineage(some)
    levels = min(some.agg(F.max(depth(F.col("doc")))).first()[0] or 0, MOST_LEVELS)
    spark, open_ = events.sparkSession, some.select(F.lit("").alias("at"), F.try_parse_json("doc").alias("v"))
    leaves = spark.createDataFrame([], "path string")
    for _ in range(levels):
        each = open_.lateralJoin(spark.tvf.variant_explode(F.col("v").outer())).select(F.concat("at", F.when(F.col("at") == "", "").otherwise("."), "key").alias("at"), F.col("value").alias("v"))
        each = each.withColumn("more", F.schema_of_variant("v").startswith("OBJECT"))
        leaves = leaves.unionByName(each.filter(~F.col("more")).select(F.col("at").alias("path")))
        open_ = each.filter("more").drop("more")
    return leaves.groupBy("path").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "path").limit(most)


def scan_page(events: DataFrame, after: tuple[str, str] | None, limit: int = 1000) -> DataFrame:
    """The next rows in order of arrival and id, after a (received_at, id) place."""
    if after is not None:
        at, i = _at(after[0]), F.lit(after[1])
        # The first condition alone can use the files' statistics.
        events = events.filter(F.col("received_at") >= at).filter((F.col("received_at") > at) | (F.col("id") > i))
    return events.orderBy("received_at", "id").limit(min(limit, 1000))


def list_events(events: DataFrame, text: str | None = None, start: str | None = None, end: str | None = None, offset: int = 0, limit: int = 100) -> DataFrame:
    """A page by event time and id, newest first; text is a literal part of raw, whatever its case."""
    if text:
        events = events.filter(F.contains(F.lower("raw"), F.lower(F.lit(text))))
    if start is not None:
        events = events.filter(event_time() >= _at(start))
    if end is not None:
        events = events.filter(event_time() <= _at(end))
    return events.orderBy(event_time().desc(), F.desc("id")).offset(min(offset, 100_000)).limit(min(limit, 500))


def by_ids(events: DataFrame, ids: list[str]) -> DataFrame:
    """The events of these ids, in their order."""
    wanted = events.sparkSession.range(1).select(F.posexplode(F.array(*[F.lit(i) for i in ids])).alias("pos", "id"))
    return events.join(F.broadcast(wanted), "id").orderBy("pos").drop("pos")


def retention(events: DataFrame, policy: DataFrame, default_days: int | None, now: str) -> DataFrame:
    """events with `expired`: arrived before now minus its source type's days (policy: source_type, days; null days: for ever)."""
    own = F.broadcast(policy.select(F.col("source_type").alias("of_type"), "days", F.lit(True).alias("listed")))  # one row a source type, set by hand
    days = F.when(F.col("listed"), F.col("days")).otherwise(F.lit(default_days).cast("int"))
    both = events.join(own, F.col("source_type") == F.col("of_type"), "left")
    expired = F.coalesce(F.col("received_at") < _at(now) - F.make_dt_interval(days), F.lit(False))
    return both.withColumn("expired", expired).drop("of_type", "days", "listed")


def expired_counts(events: DataFrame, policy: DataFrame, default_days: int | None, now: str) -> DataFrame:
    return retention(events, policy, default_days, now).filter("expired").groupBy("source_type").agg(F.count(F.lit(1)).alias("n"))


def storage_stats(events: DataFrame) -> DataFrame:
    """Rows and bytes of text of each day, newest first."""
    size = F.octet_length("raw").cast("long") + F.octet_length("parsed")
    return events.groupBy(day().alias("day")).agg(F.count(F.lit(1)).alias("n"), F.sum(size).alias("bytes")).orderBy(F.desc("day"))
