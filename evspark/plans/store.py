"""Queries over the stand-in events: dashboards, pages, retention; and over other tables as registries and series."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import store as S
from ..operators import watch as W
from ..sources.envelope import STAND_IN_SQL, stand_in
from .search import SECOND, SQL_SECOND

NOW = "2024-01-30 12:00:00"


def _seconds(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.date_format(n, SECOND) for n in names})


def _counts(by: str):
    return lambda spark, sf_dir: _seconds(S.group_counts(stand_in(spark, sf_dir), by), "first_at", "last_at")


def _counts_sql(key: str) -> str:
    return f"with {STAND_IN_SQL} select {key} as key, count(*) as n, strftime(min(received_at), {SQL_SECOND}) as first_at, strftime(max(received_at), {SQL_SECOND}) as last_at from e where {key} is not null group by 1"


def _policy(spark: SparkSession) -> DataFrame:
    return spark.sql("select * from values ('click', 10), ('error', cast(null as int)), ('view', 25) as p(source_type, days)")


def _registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as collectors: their last sighting and limits follow from the key."""
    s = spark.read.parquet(f"{sf_dir}/supplier.parquet")
    seen = F.lit(NOW).cast("timestamp") - F.make_dt_interval(F.lit(0), F.lit(0), F.pmod("s_suppkey", F.lit(40)).cast("int"))
    return s.select(F.concat(F.lit("c"), F.col("s_suppkey").cast("string")).alias("name"), seen.alias("last_seen"), F.when(F.col("s_suppkey") % 3 == 0, 30).alias("within_minutes"), F.when(F.col("s_suppkey") % 2 == 0, 10).alias("silent_minutes"))


_REGISTRY_SQL = f"""r as (select 'c' || s_suppkey as name, timestamp '{NOW}' - to_minutes(cast(s_suppkey % 40 as integer)) as last_seen,
  case when s_suppkey % 3 = 0 then 30 end as within_minutes, case when s_suppkey % 2 = 0 then 10 end as silent_minutes from supplier)"""


def _brokers(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = spark.read.parquet(f"{sf_dir}/customer.parquet")
    limit = F.when(F.col("c_custkey") % 11 != 0, 10 + F.pmod("c_custkey", F.lit(30)))
    return c.select(F.col("c_nationkey").alias("grp"), F.col("c_name").alias("name"), limit.alias("max_agents"), F.pmod(F.col("c_custkey") * 7, F.lit(25)).alias("enrolled"))


def raise_close(spark: SparkSession, sf_dir: str) -> DataFrame:
    registry = _registry(spark, sf_dir)
    down = W.disconnected(registry, NOW).select(F.col("name").alias("key"), F.col("last_seen").alias("since"))
    opened = registry.filter(F.col("silent_minutes").isNotNull()).select(F.col("name").alias("key"))
    return _seconds(W.raise_and_close(down, registry.select(F.col("name").alias("key")), opened), "since")


def trend(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    last = W.newest_per_day(o.withColumn("at", F.col("o_orderdate").cast("timestamp") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.pmod("o_orderkey", F.lit(50000)).cast("decimal(18,6)"))), "o_custkey", "at", "o_orderkey")
    return W.day_over_day(last, "o_custkey", "at", "o_orderkey").select("o_custkey", "o_orderkey", "previous", "change")


QUERIES = {
    "group_counts_source": _counts("source_type"),
    "group_counts_collector": _counts("collector_id"),
    "group_counts_day": _counts("day"),
    "source_types": lambda s, d: S.source_types(stand_in(s, d), "2024-01-20 00:00:00"),
    "time_range": lambda s, d: _seconds(S.time_range(stand_in(s, d)), "first_at", "last_at"),
    "count_filtered": lambda s, d: S.filtered(stand_in(s, d), "2024-01-05 00:00:00", "2024-01-06 00:00:00", "click", "c1").agg(F.count(F.lit(1)).alias("n")),
    "data_sources": lambda s, d: _seconds(S.data_sources(stand_in(s, d), "2024-01-29 00:00:00"), "last_at"),
    "ingestion_totals": lambda s, d: _seconds(S.ingestion_totals(stand_in(s, d), NOW), "last_at"),
    "ingestion_hourly": lambda s, d: _seconds(S.hourly(stand_in(s, d), NOW), "hour"),
    "ingestion_groups": lambda s, d: S.ingestion_groups(stand_in(s, d), NOW, "collector_id"),
    "ingest_per_minute": lambda s, d: W.per_minute(stand_in(s, d), NOW),
    "daily_zero_filled": lambda s, d: S.daily(stand_in(s, d), "2024-02-05 00:00:00"),
    "field_keys": lambda s, d: S.field_keys(stand_in(s, d), 500),
    "leaf_paths": lambda s, d: S.leaf_paths(stand_in(s, d).withColumn("parsed", F.concat(F.lit('{"xdm":{"a":'), "parsed", F.lit(',"b":[1]}}')))),
    "expired_counts": lambda s, d: S.expired_counts(stand_in(s, d), _policy(s), 20, NOW),
    "retention_keep": lambda s, d: S.retention(stand_in(s, d), _policy(s), None, NOW).filter("not expired").groupBy("source_type").agg(F.count(F.lit(1)).alias("n")),
    "storage_stats": lambda s, d: S.storage_stats(stand_in(s, d)),
    "scan_page": lambda s, d: _seconds(S.scan_page(stand_in(s, d), ("2024-01-10 00:00:00", "5"), 200).select("id", "received_at"), "received_at"),
    "list_events_page": lambda s, d: S.list_events(stand_in(s, d), "USER=1", "2024-01-02 00:00:00", "2024-01-28 00:00:00", 20, 50).select("id", "raw"),
    "events_by_ids": lambda s, d: S.by_ids(stand_in(s, d), ["7", "3", "11", "nothing"]).select("id", "raw"),
    "disconnected": lambda s, d: W.disconnected(_registry(s, d), NOW).select("name"),
    "silent_collectors": lambda s, d: _seconds(W.silent(_registry(s, d), stand_in(s, d), NOW).select("name", "newest"), "newest"),
    "raise_and_close": raise_close,
    "broker_groups": lambda s, d: W.broker_groups(_brokers(s, d)),
    "median_limit": lambda s, d: W.median_limit(_brokers(s, d)),
    "daily_growth": lambda s, d: W.daily_growth(S.group_counts(stand_in(s, d), "day").withColumnRenamed("key", "day"), NOW),
    "p95_by_key": lambda s, d: W.p95(s.read.parquet(f"{d}/lineitem.parquet"), "l_extendedprice", "l_returnflag", "l_linestatus"),
    "trend_day_over_day": trend,
}

_HOURS = f"(select unnest(generate_series(date_trunc('hour', timestamp '{NOW}') - interval 23 hour, date_trunc('hour', timestamp '{NOW}'), interval 1 hour)) as hour)"
ORACLE_SQL = {
    "group_counts_source": _counts_sql("source_type"),
    "group_counts_collector": _counts_sql("collector_id"),
    "group_counts_day": _counts_sql("strftime(received_at, '%Y-%m-%d')"),
    "source_types": f"with {STAND_IN_SQL} select distinct source_type from e where received_at >= timestamp '2024-01-20 00:00:00' order by 1 limit 100",
    "time_range": f"with {STAND_IN_SQL} select strftime(min(received_at), {SQL_SECOND}) as first_at, strftime(max(received_at), {SQL_SECOND}) as last_at from e",
    "count_filtered": f"with {STAND_IN_SQL} select count(*) as n from e where received_at >= timestamp '2024-01-05' and received_at < timestamp '2024-01-06' and source_type = 'click' and collector_id = 'c1'",
    "data_sources": f"with {STAND_IN_SQL} select source_type, collector_id, count(*) as total, count(*) filter (evt > timestamp '2024-01-29') as recent, strftime(max(received_at), {SQL_SECOND}) as last_at from e group by 1, 2",
    "ingestion_totals": f"with {STAND_IN_SQL} select count(*) as events, cast(coalesce(sum(strlen(raw)), 0) as bigint) as bytes, count(*) filter (received_at > timestamp '{NOW}' - interval 1 hour) as events_1h, count(distinct source_type) as sources, count(distinct collector_id) as collectors, strftime(max(received_at), {SQL_SECOND}) as last_at from e where evt > timestamp '{NOW}' - interval 24 hour",
    "ingestion_hourly": f"with {STAND_IN_SQL}, h as {_HOURS}, c as (select date_trunc('hour', evt) as hour, count(*) as events, sum(strlen(raw)) as bytes from e group by 1) select strftime(h.hour, {SQL_SECOND}) as hour, coalesce(events, 0) as events, cast(coalesce(bytes, 0) as bigint) as bytes from h left join c on h.hour = c.hour",
    "ingestion_groups": f"with {STAND_IN_SQL} select coalesce(collector_id, '(none)') as key, count(*) as n, cast(sum(strlen(raw)) as bigint) as bytes from e where evt > timestamp '{NOW}' - interval 24 hour group by 1 order by n desc, key limit 12",
    "ingest_per_minute": f"with {STAND_IN_SQL} select round(count(*) filter (received_at > timestamp '{NOW}' - interval 5 minute and received_at <= timestamp '{NOW}') / 5.0, 1)::double as per_minute from e",
    "daily_zero_filled": f"with {STAND_IN_SQL}, d as (select strftime(unnest(generate_series(timestamp '2024-01-23', timestamp '2024-02-05', interval 1 day)), '%Y-%m-%d') as day), c as (select strftime(received_at, '%Y-%m-%d') as day, count(*) as n from e group by 1) select d.day, coalesce(n, 0) as n from d left join c on d.day = c.day",
    "field_keys": f"with {STAND_IN_SQL} select name, count(*) as n from (select unnest(json_keys(parsed)) as name from (select parsed from e order by received_at desc, id desc limit 500)) group by 1",
    "leaf_paths": f"with {STAND_IN_SQL} select path, count(*) as n from (select unnest(case when k is null then ['b'] else ['a.k', 'b'] end) as path from (select k from e order by received_at desc, id desc limit 500)) group by 1",
    "expired_counts": f"with {STAND_IN_SQL} select source_type, count(*) as n from e where case source_type when 'click' then received_at < timestamp '{NOW}' - interval 10 day when 'error' then false when 'view' then received_at < timestamp '{NOW}' - interval 25 day else received_at < timestamp '{NOW}' - interval 20 day end group by 1",
    "retention_keep": f"with {STAND_IN_SQL} select source_type, count(*) as n from e where case source_type when 'click' then received_at >= timestamp '{NOW}' - interval 10 day when 'view' then received_at >= timestamp '{NOW}' - interval 25 day else true end group by 1",
    "storage_stats": f"with {STAND_IN_SQL} select strftime(received_at, '%Y-%m-%d') as day, count(*) as n, cast(sum(strlen(raw) + strlen(parsed)) as bigint) as bytes from e group by 1",
    "scan_page": f"with {STAND_IN_SQL} select id, strftime(received_at, {SQL_SECOND}) as received_at from (select id, received_at from e where received_at > timestamp '2024-01-10' or (received_at = timestamp '2024-01-10' and id > '5') order by received_at, id limit 200)",
    "list_events_page": f"with {STAND_IN_SQL} select id, raw from e where contains(lower(raw), 'user=1') and evt >= timestamp '2024-01-02' and evt <= timestamp '2024-01-28' order by evt desc, id desc limit 50 offset 20",
    "events_by_ids": f"with {STAND_IN_SQL} select id, raw from e where id in ('7', '3', '11')",
    "disconnected": f"with {_REGISTRY_SQL} select name from r where last_seen < timestamp '{NOW}' - to_minutes(coalesce(within_minutes, 15))",
    "silent_collectors": f"with {STAND_IN_SQL}, {_REGISTRY_SQL}, n as (select collector_id, max(received_at) as newest from e where received_at >= timestamp '{NOW}' - interval 7 day group by 1) select name, strftime(newest, {SQL_SECOND}) as newest from r left join n on name = collector_id where silent_minutes is not null and last_seen >= timestamp '{NOW}' - interval 15 minute and coalesce(newest < timestamp '{NOW}' - to_minutes(silent_minutes), true)",
    "raise_and_close": f"with {_REGISTRY_SQL}, d as (select name as key, last_seen as since from r where last_seen < timestamp '{NOW}' - to_minutes(coalesce(within_minutes, 15))), o as (select name as key from r where silent_minutes is not null) select key, action, strftime(since, {SQL_SECOND}) as since from (select * from (select key, 'raise' as action, since from d where key not in (select key from o) order by since, key limit 25) union all select key, 'close', null from o where key not in (select key from d))",
    "broker_groups": """with b as (select c_nationkey as grp, c_name as name, case when c_custkey % 11 <> 0 then 10 + c_custkey % 30 end as max_agents, (c_custkey * 7) % 25 as enrolled from customer),
g as (select grp, sum(max_agents) as m, sum(enrolled) filter (max_agents is not null) as n, count(*) filter (max_agents is null) as unknown from b group by 1),
x as (select grp, name, row_number() over (partition by grp order by enrolled / cast(max_agents as double), enrolled - max_agents, name) as rn from b where max_agents > enrolled)
select g.grp, cast(m as bigint) as max_agents, cast(n as bigint) as enrolled, cast(m - n as bigint) as free, unknown, cast(round(100 * n / cast(m as double)) as integer) as percent,
  case when n >= m then 'full' when round(100 * n / cast(m as double)) >= 80 then 'near' else 'ok' end as state, x.name as next from g left join x on g.grp = x.grp and rn = 1""",
    "median_limit": "select cast(floor(quantile_cont(cast(10 + c_custkey % 30 as double), 0.5)) as bigint) as median_limit from customer where c_custkey % 11 <> 0",
    "daily_growth": f"with {STAND_IN_SQL}, d as (select strftime(received_at, '%Y-%m-%d') as day, count(*) as n from e group by 1 having day < '2024-01-30' order by day desc limit 7) select case when count(*) >= 2 then cast(floor(avg(n)) as bigint) end as per_day from d",
    "p95_by_key": "select l_returnflag, l_linestatus, quantile_disc(l_extendedprice, 0.95) as p95 from lineitem group by 1, 2",
    "trend_day_over_day": "with o as (select o_custkey, o_orderkey, o_orderdate + to_seconds(o_orderkey % 50000) as evt from orders), l as (select * from (select *, row_number() over (partition by o_custkey, cast(evt as date) order by evt desc, o_orderkey desc) as rn from o) where rn = 1) select o_custkey, o_orderkey, lag(o_orderkey) over w as previous, o_orderkey - lag(o_orderkey) over w as change from l window w as (partition by o_custkey order by evt)",
}
