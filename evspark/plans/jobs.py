"""Queries that write as they run: tables of events, their deletes, copies and backups, rules over panes; and small reads around them."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import predicates as P
from ..functions import rules as R
from ..functions.lineage import cut_lineage, shared_folder
from ..functions.security import daily_id
from ..operators import alerts, indicators, lists, rulesets, watch
from ..operators.rulesets import Detection, DropRule
from ..sources import ingest
from ..sources.envelope import STAND_IN_SQL, stand_in
from ..sources.tables import EventTable, backup, copied, damaged, restored
from ..streaming.panes import Panes
from .rules import THEN, _hits_sql, _RULES_SQL, forty
from .search import SECOND, SQL_SECOND

TENANT, NOW = "t", "2024-01-31 00:00:00"


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def _number() -> Column:
    return F.col("id").cast("long")


def _by_day(events: DataFrame) -> DataFrame:
    return events.groupBy(F.date_format("received_at", "yyyy-MM-dd").alias("day"), "source_type").agg(F.count(F.lit(1)).alias("n"))


def line_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders' days as times of log lines, in forms that are trusted and others."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    k, day = F.col("o_orderkey"), F.date_format("o_orderdate", "yyyy-MM-dd")
    text = F.when(k % 4 == 0, F.concat(day, F.lit("T01:02:03+0100"))).when(k % 4 == 1, F.concat(F.lit(" "), day, F.lit(" 01:02:03 "))).when(k % 4 == 2, F.date_format("o_orderdate", "MMM d HH:mm:ss")).otherwise(F.concat(day, F.lit("Tbad")))
    return o.select(k, F.date_format(ingest.line_time(text), SECOND).alias("at"))


def table_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events stored in two batches, the second holding the first once more and rows twice."""
    e = stand_in(spark, sf_dir)
    table = EventTable(spark, _folder(spark, "table"))
    first = e.filter(_number() % 2 == 0)
    table.append(first, TENANT)
    table.append(e.unionByName(first), TENANT)
    return _by_day(table.read(TENANT))


def table_deletes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left after a delete before a time, one by retention, and one of whole days."""
    table = EventTable(spark, _folder(spark, "table"))
    table.append(stand_in(spark, sf_dir), TENANT)
    table.delete_before(TENANT, "2024-01-04 12:00:00")
    table.delete_expired(TENANT, 20, {"error": 5, "view": None}, NOW)
    table.drop_days_before("2024-01-06")
    return _by_day(table.read(TENANT))


def copy_verified(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A copy to a table that has a third of the events, some of them with another text."""
    e = stand_in(spark, sf_dir)
    table = EventTable(spark, _folder(spark, "table"))
    table.append(e.filter(_number() % 3 == 0).withColumn("raw", F.when(_number() % 30 == 0, "other").otherwise(F.col("raw"))), TENANT)
    bad = copied(e, table, TENANT).groupBy("source_type").agg(F.count(F.lit(1)).alias("n_differ"))
    return table.read(TENANT).groupBy("source_type").agg(F.count(F.lit(1)).alias("n")).join(bad, "source_type", "left").select("source_type", "n", F.coalesce("n_differ", F.lit(0)).alias("n_differ"))


def backup_restored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days of an encrypted backup, read back, and whether they are sound."""
    e, folder, secret = stand_in(spark, sf_dir), _folder(spark, "backup"), uuid.uuid4().hex
    manifest = backup(e, folder, secret=secret, now_day="2024-01-30")
    bad = damaged(spark, folder, manifest, secret).select("day", F.lit(True).alias("bad"))
    days = restored(spark, folder, manifest, secret).groupBy(F.date_format("received_at", "yyyy-MM-dd").alias("day")).agg(F.count(F.lit(1)).alias("n"))
    return days.join(bad, "day", "left").select("day", "n", F.col("bad").isNull().alias("sound"))


def over_panes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forty rules over events that come in three batches, late and repeated ones among them."""
    e = stand_in(spark, sf_dir)
    panes = Panes(spark, _folder(spark, "panes"), forty())
    for number, batch in enumerate([e.filter(_number() % 3 == 0), e.filter(_number() % 3 == 1), e.filter(_number() % 2 == 0).unionByName(e.filter(_number() % 3 == 2))]):
        panes.add(number, batch)
    found = cut_lineage(panes.hits(THEN))
    return found.select("rule_id", "group_key", "n", F.date_format("first_at", SECOND).alias("first_at"), F.date_format("last_at", SECOND).alias("last_at"), F.array_join("sample_ids", ",").alias("sample_ids"), "sample_raw")


def rule_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text functions of ingest rules over conversations."""
    c = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    padded = F.concat(F.lit("  "), "role", F.lit("  "))
    return c.select(
        "conv_id", "turn", F.lower("role").alias("low"), F.upper(F.left("text", F.lit(20))).alias("up"), R.trimmed(padded).alias("trimmed"),
        F.char_length(R.clamped(F.repeat("text", 3))).cast("long").alias("clamped"), F.concat("role", F.lit(":"), F.nullif(F.left("text", F.lit(1)), F.lit("a"))).alias("joined"),
    )


def due(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as feeds that ran at some time."""
    k = F.col("c_custkey")
    at = F.when(k % 5 > 0, F.lit(NOW).cast("timestamp") - F.make_dt_interval(F.lit(0), F.lit(0), (k % 90).cast("int")))
    return indicators.feeds_due(spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_name").alias("name"), at.alias("last_run"), (k % 7 * 10 + 10).cast("int").alias("every_minutes")), NOW).select("name")


def thinned(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return watch.thinned(e.select(F.col("ts").cast("timestamp").alias("at"), "event_id"), "at").select(F.date_format("at", SECOND).alias("at"), "event_id")


def policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A drop policy with ranges of ids, a pattern in the text and one in a field, and a channel's default."""
    rules = [DropRule("ERROR", ids=((0, 20), (25, 30))), DropRule(pattern="user=1"), DropRule(pattern="^9", in_field="k", action="keep")]
    e = stand_in(spark, sf_dir)
    kept = rulesets.kept_by_policy(e, rules, F.col("source_type"), P.field("k").try_cast("int"), {"View": "drop"}, erase=["user="])
    return kept.select("id", "raw")


def dry_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One rule tried out: its most frequent groups."""
    rule = Detection("try", "low", lambda: [P.equals("source_type", "error"), P.contains("raw", "USER="), P.differs("k", "7"), P.matches("raw", "=[0-4]")], r"user=(\d+)", 2, 10_080)
    return rulesets.hits(stand_in(spark, sf_dir), rule, THEN).orderBy(F.desc("n"), "group_key").limit(20).select("group_key", "n", F.array_join("sample_ids", ",").alias("sample_ids"))


def guards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as feeds that lost values, and the ids of their daily summaries."""
    s = spark.read.parquet(f"{sf_dir}/supplier.parquet")
    k = F.col("s_suppkey")
    return s.select(k, lists.shrank(k % 11, k % 60).alias("shrank"), daily_id(F.lit("summary"), k.cast("string"), F.lit("2024-01-31")).alias("id"))


_PAGES = (("active", None, False, 10, 0), ("all", 7, False, 50, 2), ("closed", None, True, 20, 5))


def case_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as cases, orders as their alerts, nations as users: three pages and their totals."""
    k = F.col("c_custkey")
    status = F.element_at(F.array(F.lit("open"), F.lit("closed"), F.lit("investigating")), (k % 3 + 1).cast("int"))
    c = spark.read.parquet(f"{sf_dir}/customer.parquet").select(k.alias("case_id"), k.alias("case_number"), status.alias("status"), F.when(k % 4 > 0, F.col("c_nationkey")).alias("owner_id"), F.date_add(F.lit("2024-01-01").cast("date"), (k % 50).cast("int")).alias("updated_at"))
    of = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_custkey").alias("case_id"), F.col("o_orderkey").alias("alert_id"))
    users = spark.read.parquet(f"{sf_dir}/nation.parquet").select(F.col("n_nationkey").alias("user_id"), F.col("n_name").alias("name"))
    out = None
    for i, (status_, owner, unowned, limit, offset) in enumerate(_PAGES):
        page, total = alerts.cases_page(c, of, users, status_, owner, unowned, limit, offset)
        rows = page.select(F.lit(i).alias("page"), F.col("case_id").cast("long").alias("case_id"), "owner", F.col("n_alerts").alias("n")).unionByName(total.select(F.lit(i).alias("page"), F.lit(None).cast("long").alias("case_id"), F.lit(None).cast("string").alias("owner"), F.col("total").alias("n")))
        out = rows if out is None else out.unionByName(rows)
    return out


def entry_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as entries of their nation's list."""
    k = F.col("c_custkey")
    expires = F.when(k % 3 > 0, F.date_add(F.lit("2024-01-31").cast("date"), (k % 9 - 4).cast("int")).cast("timestamp"))
    e = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_nationkey").alias("list_id"), F.col("c_name").alias("value"), expires.alias("expires_at"), (k % 40).alias("added_at"))
    out = None
    for i, (text, expired, limit, offset) in enumerate(_ENTRIES):
        page, total = lists.entries_page(e, 7, NOW, text, expired, limit, offset)
        rows = page.select(F.lit(i).alias("page"), "value", F.lit(None).cast("long").alias("total")).unionByName(total.select(F.lit(i).alias("page"), F.lit(None).cast("string").alias("value"), "total"))
        out = rows if out is None else out.unionByName(rows)
    return out


_ENTRIES = (("", False, 30, 0), ("CUSTOMER#", True, 10, 1), ("1", False, 500, 3))


def _case_pages_sql() -> str:
    base = "with c as (select c_custkey as k, (['open', 'closed', 'investigating'])[c_custkey % 3 + 1] as status, case when c_custkey % 4 > 0 then c_nationkey end as owner_id, c_custkey % 50 as updated from customer), n as (select o_custkey as k, count(*) as n from orders group by 1) "
    parts = []
    for i, (status, owner, unowned, limit, offset) in enumerate(_PAGES):
        where = {"active": "status in ('open', 'investigating')", "all": "true"}.get(status, f"status = '{status}'") + (" and owner_id is null" if unowned else f" and owner_id = {owner}" if owner is not None else "")
        parts.append(f"select {i} as page, p.k as case_id, n_name as owner, coalesce(n.n, 0) as n from (select * from c where {where} order by updated desc, k desc limit {limit} offset {offset}) p left join nation on n_nationkey = owner_id left join n on n.k = p.k")
        parts.append(f"select {i}, null, null, count(*) from c where {where}")
    return base + " union all ".join(parts)


def _entry_pages_sql() -> str:
    base = "with e as (select c_name as value, case when c_custkey % 3 > 0 then c_custkey % 9 - 4 end as days, c_custkey % 40 as added from customer where c_nationkey = 7) "
    parts = []
    for i, (text, expired, limit, offset) in enumerate(_ENTRIES):
        where = ("days <= 0" if expired else "coalesce(days > 0, true)") + f" and contains(lower(value), '{text.lower()}')"
        parts.append(f"select * from (select {i} as page, value, null::bigint as total from e where {where} order by added desc, value limit {limit} offset {offset})")
        parts.append(f"select {i}, null, count(*) from e where {where}")
    return base + " union all ".join(parts)


_CASE = "case source_type when 'error' then received_at >= timestamp '2024-01-31' - interval 5 day when 'view' then true else received_at >= timestamp '2024-01-31' - interval 20 day end"
_DAY = "strftime(received_at, '%Y-%m-%d')"
QUERIES = {
    "line_times": line_times,
    "table_days": table_days,
    "table_deletes": table_deletes,
    "copy_verified": copy_verified,
    "backup_restored": backup_restored,
    "rules_over_panes": over_panes,
    "rule_texts": rule_texts,
    "feeds_due": due,
    "samples_thinned": thinned,
    "drop_policy": policy,
    "rule_dry_run": dry_run,
    "feed_guards": guards,
    "case_pages": case_pages,
    "entry_pages": entry_pages,
}

ORACLE_SQL = {
    "line_times": f"select o_orderkey, strftime(case o_orderkey % 4 when 0 then o_orderdate + interval 2 minute + interval 3 second when 1 then o_orderdate + interval 1 hour + interval 2 minute + interval 3 second end, {SQL_SECOND}) as at from orders",
    "table_days": f"with {STAND_IN_SQL} select {_DAY} as day, source_type, count(*) as n from e group by 1, 2",
    "table_deletes": f"with {STAND_IN_SQL} select {_DAY} as day, source_type, count(*) as n from e where received_at >= timestamp '2024-01-06' and {_CASE} group by 1, 2",
    "copy_verified": f"with {STAND_IN_SQL} select source_type, count(*) as n, count(*) filter (cast(id as bigint) % 30 = 0) as n_differ from e group by 1",
    "backup_restored": f"with {STAND_IN_SQL} select {_DAY} as day, count(*) as n, true as sound from e group by 1",
    "rules_over_panes": f"with {_RULES_SQL}, {_hits_sql(THEN, 'h', 'true')} select rule_id, group_key, n, strftime(first_at, {SQL_SECOND}) as first_at, strftime(last_at, {SQL_SECOND}) as last_at, sample_ids, sample_raw from h",
    "rule_texts": "select conv_id, turn, lower(role) as low, upper(replace(left(text, 20), 'ß', 'SS')) as up, role as trimmed, least(4096, 3 * length(text)) as clamped, role || ':' || nullif(left(text, 1), 'a') as joined from conversations",
    "feeds_due": "select c_name as name from customer where c_custkey % 5 = 0 or c_custkey % 90 >= c_custkey % 7 * 10 + 10",
    "samples_thinned": f"""with b as (select epoch(min(ts)) as lo, epoch(max(ts)) as hi from events), s as (select ts, event_id, least(239, floor((epoch(ts) - lo) * 240 / greatest(1e-6, hi - lo))) as span from events, b)
select strftime(ts, {SQL_SECOND}) as at, event_id from s qualify row_number() over (partition by span order by ts desc, event_id desc) = 1""",
    "drop_policy": f"""with {STAND_IN_SQL} select id, replace(raw, 'user=', '') as raw from e where case when source_type = 'error' and (cast(k as int) between 0 and 20 or cast(k as int) between 25 and 30) then false when contains(raw, 'user=1') then false when k like '9%' then true
  when source_type = 'view' then false else true end""",
    "rule_dry_run": f"""with {STAND_IN_SQL}, m as (select regexp_extract(raw, 'user=(\\d+)', 1) as group_key, evt, id from e where source_type = 'error' and k is distinct from '7' and regexp_matches(raw, '=[0-4]') and evt > timestamp '{THEN}' - interval 7 day),
r as (select *, row_number() over (partition by group_key order by evt desc, id desc) as rn from m) select group_key, count(*) as n, string_agg(id, ',' order by rn) filter (rn <= 5) as sample_ids from r group by 1 having count(*) >= 2 order by n desc, group_key limit 20""",
    "case_pages": _case_pages_sql(),
    "entry_pages": _entry_pages_sql(),
    "feed_guards": """with h as (select s_suppkey as k, sha256('summary:' || s_suppkey || ':2024-01-31') as h from supplier)
select k as s_suppkey, 5 * (k % 11) < k % 60 and k % 60 >= 20 as shrank, h[1:8] || '-' || h[9:12] || '-5' || h[14:16] || '-a' || h[18:20] || '-' || h[21:32] as id from h""",
}
