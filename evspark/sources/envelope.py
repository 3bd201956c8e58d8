"""The event envelope: its schema, checks on the way in, and a stand-in view over the test events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

SCHEMA = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("tenant_id", T.StringType()),
        T.StructField("source_type", T.StringType()),
        T.StructField("collector_id", T.StringType()),
        T.StructField("received_at", T.TimestampType()),
        T.StructField("event_time", T.TimestampType()),
        T.StructField("raw", T.StringType()),
        T.StructField("parsed", T.StringType()),
    ]
)
MOST_RAW, MOST_SOURCE, MOST_COLLECTOR, MOST_PARSED = 65_536, 100, 255, 1 << 20
#: Levels of objects and arrays in a document at most.
MOST_DEPTH = 32


def depth(document: Column) -> Column:
    """Levels of objects and arrays of a JSON text: brackets outside strings, counted as they open and close."""
    outside = F.regexp_replace(F.regexp_replace(document, r"(?s)\\.", ""), '"[^"]*"', "")  # escapes go first, so that quotes only bound strings
    brackets = F.regexp_replace(outside, r"[^\[\]{}]", "")
    steps = F.transform(F.filter(F.split(brackets, ""), lambda b: b != ""), lambda b: F.when(b.isin("[", "{"), 1).otherwise(-1))
    start = F.struct(F.lit(0).alias("now"), F.lit(0).alias("most"))
    return F.aggregate(steps, start, lambda a, x: F.struct((a["now"] + x).alias("now"), F.greatest(a["most"], a["now"] + x).alias("most")), lambda a: a["most"])


def cleaned(events: DataFrame) -> DataFrame:
    """Trimmed and lower-cased as the envelope wants it, with `rejected`: the reason why a row can't be stored, or null."""
    source, collector = F.trim("source_type"), F.nullif(F.trim("collector_id"), F.lit(""))
    raw = F.replace("raw", F.lit("\0"), F.lit(""))
    parsed = F.coalesce("parsed", F.lit("{}"))
    bad: list[tuple[Column, str]] = [
        (F.col("tenant_id").isNull(), "tenant_id is missing"),
        (F.col("id").isNotNull() & F.col("received_at").isNull(), "an id needs received_at"),
        (source.isNull() | (source == "") | (F.char_length(source) > MOST_SOURCE) | source.rlike(r"\p{Cntrl}"), "source_type"),
        (F.char_length(collector) > MOST_COLLECTOR, "collector_id"),
        (raw.isNull() | (raw == "") | (F.char_length(raw) > MOST_RAW), "raw"),
        (F.try_parse_json(parsed).isNull() | ~parsed.rlike(r"^\s*\{") | (F.octet_length(parsed) > MOST_PARSED), "parsed"),
        (depth(parsed) > MOST_DEPTH, "parsed is too deep"),
    ]
    reason = F.coalesce(*[F.when(c, F.lit(m)) for c, m in bad])
    return events.select(
        F.lower("id").alias("id"), F.lower("tenant_id").alias("tenant_id"), source.alias("source_type"), collector.alias("collector_id"), "received_at", "event_time", raw.alias("raw"), parsed.alias("parsed"), reason.alias("rejected")
    )


def stand_in(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Envelope rows made of the test table `events`."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    at = F.col("ts").cast("timestamp")
    return e.select(
        F.col("event_id").cast("string").alias("id"),
        F.lit("t").alias("tenant_id"),
        F.col("event_type").alias("source_type"),
        F.when(F.col("user_id") % 7 != 0, F.concat(F.lit("c"), (F.col("user_id") % 10).cast("string"))).alias("collector_id"),
        at.alias("received_at"),
        F.when(F.col("event_id") % 11 != 0, at - F.expr("interval 3 minutes")).alias("event_time"),
        F.concat("event_type", F.lit(" user="), F.col("user_id").cast("string")).alias("raw"),
        F.when(F.col("event_id") % 5 == 0, "{}").otherwise(F.col("props")).alias("parsed"),
    )


#: The same rows in DuckDB, as a common table expression.
STAND_IN_SQL = """e as (
  select cast(event_id as varchar) as id, event_type as source_type, case when user_id % 7 <> 0 then 'c' || (user_id % 10) end as collector_id,
    ts as received_at, case when event_id % 11 <> 0 then ts - interval 3 minute end as event_time,
    event_type || ' user=' || user_id as raw, case when event_id % 5 = 0 then '{}' else props end as parsed,
    coalesce(case when event_id % 11 <> 0 then ts - interval 3 minute end, ts) as evt,
    case when event_id % 5 = 0 then null else json_extract_string(props, '$.k') end as k
  from events)"""
