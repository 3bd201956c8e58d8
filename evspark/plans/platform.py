"""Queries over other tables as log lines, registries, cases, policies and endpoint alerts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import rules as R
from ..operators import alerts as A
from ..operators import endpoints as E
from ..operators import indicators as N
from ..operators import ioc, lists, rulesets
from ..operators import watch as W
from ..sources import ingest, tables
from ..sources.envelope import STAND_IN_SQL, cleaned, stand_in
from .detect import _ALERTS_SQL, _alerts, _read
from .search import SECOND, SQL_SECOND

NOW = "1998-01-15 00:00:00"


def _fields(df: DataFrame, *names: str) -> DataFrame:
    return df.select("raw", F.date_format("event_time", SECOND).alias("evt"), *[F.get_json_object("parsed", f"$.{n}").alias(n) for n in names])


def text_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as lines of a log file in five forms."""
    o = _read(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    line = (
        F.when(k % 5 == 0, F.concat(day, F.lit("T01:02:03+0100 web"), (k % 7).cast("string"), F.lit(" sshd["), k.cast("string"), F.lit("]: "), F.col("o_orderpriority")))
        .when(k % 5 == 1, F.concat(F.lit("Oct  1 10:00:00 web sudo(pam): "), F.col("o_orderpriority")))
        .when(k % 5 == 2, F.concat(day, F.lit(" 01:02:03 web kernel:")))
        .when(k % 5 == 3, F.concat(F.lit("no form: "), F.col("o_orderpriority")))
        .otherwise(F.lit("   "))
    )
    return _fields(ingest.text_lines(o.select(line.alias("value")), "me"), "format", "host", "app_name", "proc_id", "message")


_TEXT_LINES_SQL = f"""with o as (select o_orderkey as k, strftime(o_orderdate, '%Y-%m-%d') as d, o_orderpriority as p from orders)
select d || 'T01:02:03+0100 web' || (k % 7) || ' sshd[' || k || ']: ' || p as raw, strftime(cast(d as timestamp) + interval 123 second, {SQL_SECOND}) as evt, 'syslog-file' as format, 'web' || (k % 7) as host, 'sshd' as app_name, cast(k as varchar) as proc_id, p as message from o where k % 5 = 0
union all select 'Oct  1 10:00:00 web sudo(pam): ' || p, null, 'syslog-file', 'web', 'sudo(pam)', null, p from o where k % 5 = 1
union all select d || ' 01:02:03 web kernel:', strftime(cast(d as timestamp) + interval 3723 second, {SQL_SECOND}), 'syslog-file', 'web', 'kernel', null, '' from o where k % 5 = 2
union all select 'no form: ' || p, null, 'plain', 'me', null, null, 'no form: ' || p from o where k % 5 = 3"""


def json_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _read(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    rows = c.select(
        F.when(k % 3 == 0, F.col("c_name")).alias("raw"),
        F.when(k % 4 != 0, F.concat(F.lit("m "), F.col("c_name"))).alias("message"),
        F.when(k % 2 == 0, F.lit("2024-01-02 03:04:05")).otherwise(F.lit("Jan 2 03:04:05")).alias("time"),
        F.when(k % 5 == 0, F.concat(F.lit("h"), (k % 10).cast("string"))).alias("host"),
        F.when(k % 2 == 0, F.concat(F.lit('{"n":'), k.cast("string"), F.lit(',"format":"no"}'))).when(k % 3 == 0, F.lit("[1]")).alias("fields"),
    )
    return _fields(ingest.json_batch(rows, "col"), "format", "host", "message", "n")


_JSON_BATCH_SQL = """with c as (select c_custkey as k, case when c_custkey % 3 = 0 then c_name end as r, case when c_custkey % 4 <> 0 then 'm ' || c_name end as m from customer)
select coalesce(r, m) as raw, case when k % 2 = 0 then '2024-01-02 03:04:05' end as evt, 'json' as format, case when k % 5 = 0 then 'h' || (k % 10) else 'col' end as host, coalesce(m, r) as message, case when k % 2 = 0 then cast(k as varchar) end as n
from c where coalesce(r, m) is not null"""


def feed_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _read(spark, sf_dir, "supplier")
    k = F.col("s_suppkey")
    line = F.when(k % 4 == 0, F.concat(F.lit('"a, b";"203[.]0.1.'), (k % 200).cast("string"), F.lit('",x # note'))).when(k % 4 == 1, F.concat(F.lit("name\thxxp://Evil"), k.cast("string"), F.lit("[.]example/p"))).when(k % 4 == 2, F.lit("# nothing")).otherwise(F.concat(F.lit('"say ""'), k.cast("string"), F.lit('""",'), F.md5(k.cast("string"))))
    return ingest.feed_values(s.select(line.alias("value")), "feed", "low")


_FEED_SQL = """with s as (select s_suppkey as k from supplier) select distinct type, value, 'feed' as source, 'low' as severity from (
select 'ip' as type, '203.0.1.' || (k % 200) as value from s where k % 4 = 0 union all select 'url', 'http://evil' || k || '.example/p' from s where k % 4 = 1 union all select 'md5', md5(cast(k as varchar)) from s where k % 4 = 3)"""


def feed_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _read(spark, sf_dir, "supplier")
    k = F.col("s_suppkey").cast("string")
    doc = F.concat(F.lit('{"count":1,"iocs":["'), F.md5(k), F.lit('",{"note":"x","ip":"203.0.2.'), (F.col("s_suppkey") % 99).cast("string"), F.lit('"},{"q":1},5]}'))
    return ingest.feed_values(s.select(doc.alias("value")), "feed", "low", form="json")


_FEED_JSON_SQL = """select distinct type, value, 'feed' as source, 'low' as severity from (select 'md5' as type, md5(cast(s_suppkey as varchar)) as value from supplier union all select 'ip', '203.0.2.' || (s_suppkey % 99) from supplier)"""


def envelope_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = stand_in(spark, sf_dir)
    n = F.col("id").cast("long")
    deep = F.concat(F.repeat(F.lit('{"a":['), 17), F.lit("1"), F.repeat(F.lit("]}"), 17))
    parsed = F.when(n % 10 == 0, F.lit("[1]")).when(n % 10 == 1, F.lit("{bad")).when(n % 10 == 2, deep).when(n % 10 == 3, F.concat(F.lit('{"t":"\\\\'), F.repeat(F.lit('\\"['), 40), F.lit('","[[{{":1}'))).otherwise(F.col("parsed"))
    hidden = F.concat(F.lit('{"\\\\":'), F.repeat(F.lit('{"\\"]}":'), 33), F.lit("1"), F.repeat(F.lit("}"), 34))
    parsed = F.when(n % 20 == 16, hidden).otherwise(parsed)
    raw = F.when(n % 10 == 4, F.lit("")).otherwise(F.col("raw"))
    source = F.when(n % 10 == 5, F.lit("  ")).otherwise(F.concat(F.lit(" "), F.col("source_type")))
    checked = cleaned(e.withColumns({"parsed": parsed, "raw": raw, "source_type": source}))
    return checked.groupBy(F.coalesce("rejected", F.concat(F.lit("stored "), "source_type")).alias("result")).agg(F.count(F.lit(1)).alias("n"))


_ENVELOPE_SQL = """select case when event_id % 20 = 16 then 'parsed is too deep' else case event_id % 10 when 0 then 'parsed' when 1 then 'parsed' when 2 then 'parsed is too deep' when 4 then 'raw' when 5 then 'source_type' else 'stored ' || event_type end end as result, count(*) as n from events group by 1"""


def timestamps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dates in several formats, as an ingest rule would read them."""
    o = _read(spark, sf_dir, "orders")
    at, k = F.col("o_orderdate").cast("timestamp"), F.col("o_orderkey")
    show = lambda c: F.date_format(c, SECOND)
    return o.select(
        "o_orderkey",
        show(R.parse_timestamp("%Y-%m-%d", F.concat(F.lit("  "), F.date_format(at, "yyyy-M-d"), F.lit(" ")))).alias("short"),
        show(R.parse_timestamp("%FT%T%z", F.concat(F.date_format(at, "yyyy-MM-dd"), F.lit("T12:00:00"), F.when(k % 2 == 0, "+02:00").otherwise("-0330")))).alias("zoned"),
        show(R.parse_timestamp("%d/%b/%Y:%H:%M:%S", F.concat(F.date_format(at, "dd/MMM/yyyy"), F.lit(":01:02:03")))).alias("month_name"),
        R.parse_timestamp("%Y-%m-%d", F.concat(F.date_format(at, "yyyy"), F.lit("-13-01"))).isNull().alias("bad_month"),
        F.date_format(R.parse_timestamp("%F %H:%M:%E*S", F.concat(F.date_format(at, "yyyy-MM-dd"), F.lit(" 01:02:03.4567"))), "ss.SSS").alias("fraction"),
    )


_TIMESTAMPS_SQL = f"""select o_orderkey, strftime(date_trunc('day', o_orderdate), {SQL_SECOND}) as short, strftime(date_trunc('day', o_orderdate) + interval 12 hour - case when o_orderkey % 2 = 0 then interval 120 minute else interval (-210) minute end, {SQL_SECOND}) as zoned,
  strftime(date_trunc('day', o_orderdate) + interval 3723 second, {SQL_SECOND}) as month_name, true as bad_month, '03.456' as fraction from orders"""


def rule_operators(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Comparisons of ingest rules: two-valued, by number where both sides look like one."""
    line = _read(spark, sf_dir, "lineitem")
    a, b = F.when(F.col("l_linenumber") != 4, F.col("l_partkey").cast("string")), F.when(F.col("l_linenumber") != 5, F.concat(F.col("l_suppkey").cast("string"), F.lit(".0")))
    mode = F.element_at(F.array(F.lit("AIR"), F.lit("RAIL"), F.lit("MAIL"), F.lit("SHIP")), (F.col("l_partkey") % 4 + 1).cast("int"))
    made = {
        "same": R.same(a, b), "differs": R.differs(a, b), "less": R.less(a, b), "more_or_equal": R.more(a, b, True), "text_less": R.less(mode, F.lit("MAIL")), "holds": R.holds(mode, F.lit("ai")),
        "fits": R.fits(mode, "^[A-M]"), "among": R.among(mode, F.lit("AIR"), F.lit("RAIL")), "negated": R.negated(R.same(a, F.lit(None).cast("string"))),
    }
    flags = line.select([c.cast("int").alias(n) for n, c in made.items()] + [R.length(mode).alias("chars"), R.array_length(F.split(mode, "A")).alias("parts"), R.to_string(F.struct("l_linenumber"), "json").alias("json")])
    return flags.groupBy("json").agg(*[F.sum(c).alias(c) for c in [*made, "chars", "parts"]])


_RULE_OPERATORS_SQL = """with x as (select l_linenumber as l, l_partkey as p, l_suppkey as s, (['AIR', 'RAIL', 'MAIL', 'SHIP'])[l_partkey % 4 + 1] as m from lineitem)
select '{"l_linenumber":' || l || '}' as json, sum(case when l in (4, 5) then 0 else cast(p = s as int) end)::bigint as same, sum(case when l in (4, 5) then 1 else cast(p <> s as int) end)::bigint as differs, sum(case when l in (4, 5) then 0 else cast(p < s as int) end)::bigint as less,
  sum(case when l in (4, 5) then 0 else cast(p >= s as int) end)::bigint as more_or_equal, sum(cast(m < 'MAIL' as int))::bigint as text_less, sum(cast(contains(lower(m), 'ai') as int))::bigint as holds, sum(cast(regexp_matches(m, '^[A-M]') as int))::bigint as fits,
  sum(cast(m in ('AIR', 'RAIL') as int))::bigint as among, sum(case when l = 4 then 0 else 1 end)::bigint as negated, sum(length(m))::bigint as chars, sum(len(string_split(m, 'A')))::bigint as parts from x group by l"""


def keep_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A rule that keeps named keys, and rows whose document can't be read."""
    e = stand_in(spark, sf_dir)
    n = F.col("id").cast("long")
    e = e.withColumn("parsed", F.when(n % 8 == 0, F.lit("{oops")).otherwise(F.concat(F.lit('{"host":"h","host_ip":"1","user":"u","n":'), (n % 5).cast("string"), F.lit("}"))))
    rule = rulesets.Rule("tidy", F.col("source_type") == "click", {"seen.by": F.col("collector_id")}, keep=("host*", "seen"))
    done = rulesets.parsed_or_kept(e, [rule])
    return done.groupBy("rule", "parsed").agg(F.count(F.lit(1)).alias("n"))


_KEEP_ONLY_SQL = f"""with {STAND_IN_SQL}, x as (select cast(id as bigint) as i, source_type, collector_id from e)
select case when i % 8 <> 0 and source_type = 'click' then 'tidy' end as rule,
  case when i % 8 = 0 then '{{"_parse_error":"PARSE_ERROR","_unparsed":"{{oops"}}' when source_type = 'click' then '{{"host":"h","host_ip":"1","seen":' || case when collector_id is null then '{{}}' else '{{"by":"' || collector_id || '"}}' end || '}}' else '{{"host":"h","host_ip":"1","user":"u","n":' || (i % 5) || '}}' end as parsed, count(*) as n from x group by 1, 2"""


def _cases(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    o = _read(spark, sf_dir, "orders")
    cases = _read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("case_id"), F.concat(F.lit("C-"), F.col("c_custkey").cast("string")).alias("case_number"))
    return cases, o.filter("o_orderstatus = 'O'").select(F.col("o_custkey").alias("case_id"), F.col("o_orderkey").cast("string").alias("alert_id"))


def inspected(spark: SparkSession, sf_dir: str) -> DataFrame:
    cases, of = _cases(spark, sf_dir)
    ids = _read(spark, sf_dir, "lineitem").select((F.col("l_orderkey") + F.col("l_linenumber") - 1).cast("string").alias("id"))
    return A.inspected(ids, _alerts(spark, sf_dir), of, cases, 7)


_INSPECTED_SQL = """with i as (select distinct l_orderkey + l_linenumber - 1 as id from lineitem)
select cast(id as varchar) as id, case when o_orderkey is not null then (['low', 'medium', 'high', 'critical', 'odd'])[cast(o_orderpriority[1] as integer)] end as severity,
  case when o_orderkey is null then 'missing' when o_orderstatus <> 'O' then 'free' when o_custkey = 7 then 'mine' else 'taken' end as state,
  case when o_orderstatus = 'O' then o_custkey end as case_id, case when o_orderstatus = 'O' then 'C-' || o_custkey end as case_number from i left join orders on o_orderkey = id"""


def _rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _read(spark, sf_dir, "supplier")
    k = F.col("s_suppkey")
    at = F.lit(NOW).cast("timestamp")
    return s.select(
        F.concat(F.lit("r"), k.cast("string")).alias("rule_id"), F.col("s_name").alias("name"), F.element_at(F.array(F.lit("low"), F.lit("high"), F.lit("odd")), (k % 3 + 1).cast("int")).alias("severity"), (k % 4 != 0).alias("enabled"),
        F.when(k % 5 != 0, at - F.make_dt_interval(F.lit(0), F.lit(0), (k % 90).cast("int"))).alias("last_run_at"), (at - F.make_dt_interval(F.lit(1))).alias("created_at"),
        F.when(k % 3 == 0, (k % 20).cast("int")).alias("run_every_minutes"), F.when(k % 6 == 0, "bad").alias("last_error"),
    )


_RULES_SQL = f"""r as (select 'r' || s_suppkey as rule_id, s_name as name, (['low', 'high', 'odd'])[s_suppkey % 3 + 1] as severity, s_suppkey % 4 <> 0 as enabled, case when s_suppkey % 5 <> 0 then timestamp '{NOW}' - to_minutes(cast(s_suppkey % 90 as integer)) end as last_run_at,
  timestamp '{NOW}' - interval 1 day as created_at, case when s_suppkey % 3 = 0 then s_suppkey % 20 end as run_every_minutes, case when s_suppkey % 6 = 0 then 'bad' end as last_error from supplier)"""


def rules_open(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.rules_with_open(_rules(spark, sf_dir).select("rule_id", "name", "severity"), _alerts(spark, sf_dir))


def rules_due(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.rules_due(_rules(spark, sf_dir), NOW).select("rule_id")


def rule_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.rule_health(_rules(spark, sf_dir), NOW)


def recovered(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = _alerts(spark, sf_dir)
    k = F.col("id").cast("long")
    alerts = a.withColumns({"updated_at": F.lit(NOW).cast("timestamp") - F.make_dt_interval(F.lit(0), (k % 30).cast("int")), "merged_into_id": F.when(k % 9 == 0, "x")})
    channels = spark.sql("select * from values ('mail', true, true, cast(null as timestamp)), ('chat', true, true, timestamp'1998-01-14 12:00:00'), ('off', false, true, null), ('mute', true, false, null) as c(channel_id, enabled, notify_recovered, notify_recovered_at)")
    names = F.explode(F.array(F.lit("mail"), F.lit("chat"), F.lit("off"), F.lit("mute")))
    sent = a.select("id", names.alias("channel_id")).select("channel_id", F.col("id").alias("alert_id"), F.when(k % 7 == 0, "failed").otherwise("sent").alias("status"))
    noted, already = a.filter(k % 2 == 0).select(F.col("id").alias("alert_id")), a.filter(k % 8 == 0).select(F.lit("mail").alias("channel_id"), F.col("id").alias("alert_id"))
    return A.recovered(alerts, sent, channels, noted, already, NOW, 6)


_RECOVERED_SQL = f"""with {_ALERTS_SQL}, x as (select id, cast(id as bigint) as k from a where status = 'closed' and rule_id is null), y as (select id, k, timestamp '{NOW}' - to_hours(cast(k % 30 as integer)) as u from x where k % 9 <> 0 and k % 30 < 24 and k % 7 <> 0 and (k % 2 = 0 or k % 30 < 6))
select 'mail' as channel_id, id as alert_id from y where k % 8 <> 0 union all select 'chat', id from y where u >= timestamp '1998-01-14 12:00:00'"""


def unparsed_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For several states of the watch: what it does with the events' unparsed counts."""
    e = stand_in(spark, sf_dir)
    reasons = e.groupBy(F.col("source_type").alias("reason")).agg(F.count(F.lit(1)).alias("n"))
    active = spark.sql("select * from values ('a1'), ('a2') as t(id)")
    none = active.filter("false")
    closed = spark.sql("select 'closed' as status, 'ann' as closed_by, 60 as age_s")
    cases = {"over": (none, closed.filter("false"), 10), "cooling": (none, closed, 10), "active": (active, closed, 10), "under": (active, closed, 10**9), "off": (active, closed, 0)}
    found = None
    for name, (ids, latest, threshold) in cases.items():
        each = A.unparsed_plan(reasons, ids, latest, threshold).withColumn("state", F.lit(name))
        found = each if found is None else found.unionByName(each)
    return found


_UNPARSED_SQL = """with n as (select count(*) as total from events) select 'raise' as action, cast(null as varchar) as id, total, 'over' as state from n
union all select 'close', id, total, state from n, (values ('a1'), ('a2')) t(id), (values ('under'), ('off')) s(state)"""


def default_watch(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _read(spark, sf_dir, "supplier")
    k = F.col("s_suppkey")
    c = s.select(
        F.col("s_name").alias("name"), (k % 4 == 0).alias("watch_disconnect"), F.when(k % 5 == 0, (k % 60).cast("int")).alias("watch_silent_min"), F.when(k % 3 == 0, k % 2 == 0).alias("watch_exclude"),
        F.when(k % 7 != 0, F.lit(NOW).cast("timestamp") - F.make_dt_interval((k % 14).cast("int"))).alias("last_seen"),
    )
    return W.with_default_watch(c, NOW, True, 45).select("name", "disconnect", "disconnect_by_default", "silent_minutes", "silent_by_default")


_DEFAULT_WATCH_SQL = """with c as (select s_name as name, s_suppkey % 4 = 0 as own, case when s_suppkey % 5 = 0 then s_suppkey % 60 end as mins, not coalesce(case when s_suppkey % 3 = 0 then s_suppkey % 2 = 0 end, false) and s_suppkey % 7 <> 0 and s_suppkey % 14 <= 7 as covered from supplier)
select name, own or covered as disconnect, not own and covered as disconnect_by_default, cast(coalesce(mins, case when covered then 45 end) as integer) as silent_minutes, mins is null and covered as silent_by_default from c"""


def retired(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _read(spark, sf_dir, "supplier")
    return W.retired(s.select(F.when(F.col("s_suppkey") % 7 != 0, F.lit(NOW).cast("timestamp") - F.make_dt_interval((F.col("s_suppkey") % 14).cast("int"))).alias("last_seen")), NOW)


def capacity(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _read(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    return W.capacity_findings(c.select(F.col("c_name").alias("host"), (k % 101).alias("mem_pct"), (k % 97).alias("cpu_pct"), (k % 40 / 10).alias("load_per_cpu"), (k % 83).alias("disk_free_pct"), F.when(k % 2 == 0, k % 61).alias("days_to_full")))


_CAPACITY_SQL = """with c as (select c_name as host, c_custkey as k from customer), m as (select host, unnest(['mem_pct', 'cpu_pct', 'load_per_cpu', 'disk_free_pct', 'days_to_full']) as measure, unnest([k % 101, k % 97, k % 40 / 10.0, k % 83, case when k % 2 = 0 then k % 61 end])::double as value from c),
s as (select *, case measure when 'mem_pct' then case when value >= 92 then 'critical' when value >= 85 then 'warning' end when 'cpu_pct' then case when value >= 85 then 'critical' when value >= 70 then 'warning' end when 'load_per_cpu' then case when value >= 3 then 'critical' when value >= 1.5 then 'warning' end
  when 'disk_free_pct' then case when value < 10 then 'critical' when value < 20 then 'warning' end else case when value < 14 then 'critical' when value < 30 then 'warning' end end as severity from m)
select host, measure, value, severity from s where severity is not null union all select host, null, null, 'ok' from s group by host having count(severity) = 0"""


def list_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = _read(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("list_id"), F.col("c_name").alias("value"), F.when(F.col("c_custkey") % 3 == 0, F.lit(NOW).cast("timestamp") + F.make_dt_interval((F.col("c_custkey") % 9 - 4).cast("int"))).alias("expires_at"))
    names = _read(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("list_id"), F.col("n_name").alias("name"))
    return lists.with_counts(names.unionByName(spark.sql("select cast(999 as bigint) as list_id, 'empty' as name")), entries, NOW)


_LIST_COUNTS_SQL = """select cast(n_nationkey as bigint) as list_id, n_name as name, (select count(*) from customer where c_nationkey = n_nationkey and (c_custkey % 3 <> 0 or c_custkey % 9 - 4 > 0)) as entry_count from nation union all select 999, 'empty', 0"""


def list_etag(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lists.etag(_read(spark, sf_dir, "supplier").select(F.col("s_name").alias("value"), F.when(F.col("s_suppkey") % 3 == 0, F.lit(NOW).cast("timestamp")).alias("expires_at")), NOW)


def ip6_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers' IPv6 and IPv4 addresses in suppliers' blocks."""
    k, n = F.col("c_custkey"), F.col("s_suppkey")
    hexa = lambda c: F.lower(F.hex(c))
    c = _read(spark, sf_dir, "customer").select(k, F.when(k % 4 == 0, F.concat(F.lit("10.0."), (k % 16).cast("string"), F.lit("."), (k % 200).cast("string"))).otherwise(F.concat(F.lit("2001:db8:"), hexa(k % 16), F.lit("::"), hexa(k % 50))).alias("ip"))
    s = _read(spark, sf_dir, "supplier").select(n, F.when(n % 5 == 0, F.concat(F.lit("10.0."), (n % 20).cast("string"), F.lit(".0/24"))).otherwise(F.concat(F.lit("2001:db8:"), hexa(n % 20), F.lit("::/"), F.when(n % 2 == 0, "48").otherwise("124"))).alias("block"))
    return lists.overlapping(c, s, "ip", "block").select("c_custkey", "s_suppkey")


_IP6_SQL = """select c_custkey, s_suppkey from customer join supplier on (c_custkey % 4 = 0 and s_suppkey % 5 = 0 and c_custkey % 16 = s_suppkey % 20)
  or (c_custkey % 4 <> 0 and s_suppkey % 5 <> 0 and c_custkey % 16 = s_suppkey % 20 and (s_suppkey % 2 = 0 or c_custkey % 50 < 16))"""


def safe_drop(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _read(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("string").alias("tenant_id"), F.lit(True).alias("auto_purge"), (F.col("n_nationkey") + 10).cast("int").alias("default_days"), F.array(F.lit(5), F.col("n_regionkey").cast("int") * 20).alias("overrides"))
    off = p.withColumn("auto_purge", F.col("tenant_id") != "3")
    ever = p.withColumn("overrides", F.when(F.col("tenant_id") == "3", F.array(F.lit(None).cast("int"))).otherwise(F.col("overrides")))
    cases = [("all", p), ("off", off), ("ever", ever), ("none", p.filter("false"))]
    found = [tables.safe_drop_day(q, NOW).withColumn("of", F.lit(name)) for name, q in cases]
    return found[0].unionByName(found[1]).unionByName(found[2]).unionByName(found[3])


_SAFE_DROP_SQL = f"""select strftime(timestamp '{NOW}' - to_days(cast(max(greatest(n_nationkey + 10, n_regionkey * 20)) as integer)), '%Y-%m-%d') as day, cast(null as varchar) as reason, 'all' as of from nation
union all select null, 'automatic purge is off for a tenant', 'off' union all select null, 'a tenant keeps something for ever', 'ever' union all select null, 'no tenants', 'none'"""


def ioc_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A scan's hits merged into the open alerts of their indicators."""
    c = _read(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    at = F.lit(NOW).cast("timestamp")
    key = F.concat(F.lit("ip:10.0.0."), (k % 90).cast("string"))
    hits = c.groupBy(key.alias("key")).agg(F.lit("feed").alias("source"), F.lit("high").alias("severity"), F.count(F.lit(1)).alias("n"), F.lit(NOW).cast("timestamp").alias("first_at"), F.lit(NOW).cast("timestamp").alias("last_at"))
    old = _read(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").cast("string").alias("id"), F.lit(None).cast("string").alias("rule_id"), F.lit(ioc.RULE).alias("rule_name"), F.concat(F.lit("ioc:ip:10.0.0."), (F.col("s_suppkey") % 120).cast("string")).alias("group_key"), F.lit("low").alias("severity"),
        F.element_at(F.array(F.lit("open"), F.lit("acknowledged"), F.lit("closed")), (F.col("s_suppkey") % 3 + 1).cast("int")).alias("status"), F.lit(5).cast("long").alias("event_count"), at.alias("first_event_at"), at.alias("last_event_at"), at.alias("created_at"),
    )
    after, _ = ioc.alerted(old, hits, NOW)
    return after.groupBy("group_key", "status", "severity").agg(F.count(F.lit(1)).alias("n"), F.sum("event_count").alias("event_count"))


_IOC_ALERTS_SQL = """with h as (select 'ioc:ip:10.0.0.' || (c_custkey % 90) as group_key, count(*) as n from customer group by 1),
o as (select cast(s_suppkey as varchar) as id, 'ioc:ip:10.0.0.' || (s_suppkey % 120) as group_key, (['open', 'acknowledged', 'closed'])[s_suppkey % 3 + 1] as status from supplier),
f as (select group_key, min(id) as id from o where status <> 'closed' group by 1),
u as (select o.group_key, status, 'low' as severity, 5 + coalesce(case when f.id = o.id then h.n end, 0) as event_count from o left join f using (group_key) left join h using (group_key)
  union all select group_key, 'open', 'high', n from h where group_key not in (select group_key from f))
select group_key, status, severity, count(*) as n, cast(sum(event_count) as bigint) as event_count from u group by 1, 2, 3"""


def _endpoint_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as endpoint alerts, with the document that the manager's alerts have."""
    n = F.col("id").cast("long")
    doc = F.struct(
        (n % 16).alias("alert_level"), F.element_at(F.array(F.lit("low"), F.lit("medium"), F.lit("high"), F.lit("critical")), (n % 4 + 1).cast("int")).alias("alert_severity"), F.when(n % 6 != 0, F.concat(F.lit("host"), (n % 9).cast("string"))).alias("agent_name"),
        (n % 30 + 500).cast("string").alias("rule_id"), F.when(n % 3 == 0, F.concat(F.lit("/etc/F"), (n % 8).cast("string"))).alias("file_path"), F.when(n % 5 == 0, "T1110.003, T1078").alias("mitre_ids"), F.when(n % 7 == 0, "not applicable").otherwise("failed").alias("data_sca_check_result"),
    )
    return stand_in(spark, sf_dir).withColumns({"parsed": F.to_json(doc), "source_type": F.when(n % 2 == 0, "endpoint").otherwise(F.col("source_type"))})


_START, _END = "2024-01-03 00:00:00", "2024-01-25 00:00:00"
_ENDPOINT_SQL = f"with {STAND_IN_SQL}, x as (select id, cast(id as bigint) as n from e where cast(id as bigint) % 2 = 0 and evt between timestamp '{_START}' and timestamp '{_END}')"


def endpoint_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = [
        ("a", E.AlertFilter(severity="high", exclude=("508", "510"))), ("b", E.AlertFilter(agent="host4", kind="file_integrity")), ("c", E.AlertFilter(technique="T1110", text="HOST")),
        ("d", E.AlertFilter(check_result="not_applicable", rule="514")), ("e", E.AlertFilter(text="/etc/f3")),
    ]
    events = _endpoint_events(spark, sf_dir)
    found = None
    for name, a in asked:
        each = E.listed(events, "endpoint", a, _START, _END).fields("_id").unlimited().frame().withColumn("asked", F.lit(name))
        found = each if found is None else found.unionByName(each)
    return found


_ENDPOINT_LIST_SQL = f"""{_ENDPOINT_SQL} select id as _id, 'a' as asked from x where n % 16 between 8 and 11 and n % 30 + 500 not in (508, 510) union all select id, 'b' from x where n % 9 = 4 and n % 6 <> 0 and n % 3 = 0
union all select id, 'c' from x where n % 5 = 0 and n % 6 <> 0 union all select id, 'd' from x where n % 7 = 0 and n % 30 = 14 union all select id, 'e' from x where n % 3 = 0 and n % 8 = 3"""


_REQUESTS = (
    ("a", {"severity": "high", "exclude_rule": "508,510,508", "window": "7d", "limit": "20", "offset": "3"}),
    ("b", {"agent": "host4", "kind": "file_integrity", "window": "30d", "q": ""}),
    ("c", {"mitre": "T1110", "q": "HOST", "window": "24h", "limit": "100"}),
)


def endpoint_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of endpoint alerts for requests as a client makes them."""
    events, found = _endpoint_events(spark, sf_dir), None
    for name, parameters in _REQUESTS:
        page = E.page(events, "endpoint", E.asked(parameters, _END), _END).select("_id", F.lit(name).alias("asked"))
        found = page if found is None else found.unionByName(page)
    return found


def _page_sql(name: str, where: str, days: int, limit: int, offset: int) -> str:
    return f"(select id as _id, '{name}' as asked from y where {where} and evt between timestamp '{_END}' - interval {days} day and timestamp '{_END}' order by evt desc, id desc limit {limit} offset {offset})"


_REQUESTS_SQL = f"with {STAND_IN_SQL}, y as (select id, evt, cast(id as bigint) as n from e where cast(id as bigint) % 2 = 0) " + " union all ".join(
    [
        _page_sql("a", "n % 16 between 8 and 11 and n % 30 + 500 not in (508, 510)", 7, 20, 3),
        _page_sql("b", "n % 9 = 4 and n % 6 <> 0 and n % 3 = 0", 30, 50, 0),
        _page_sql("c", "n % 5 = 0 and n % 6 <> 0", 1, 100, 0),
    ]
)


def scan_lag(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How long ago the latest customer's order was, as the lag of a scan, and orders as deliveries that are overdue."""
    o = _read(spark, sf_dir, "orders")
    scans = o.select(F.col("o_orderdate").cast("timestamp").alias("last_run_at"))
    ind = _read(spark, sf_dir, "customer").select((F.col("c_custkey") % 4 > 2).alias("enabled"))
    late = W.overdue(o.select(F.when(F.col("o_orderstatus") == "O", "pending").otherwise("sent").alias("status"), F.col("o_orderdate").cast("timestamp").alias("next_attempt_at")), NOW)
    return W.scan_lag(scans, ind, NOW).select(F.lit("lag_minutes").alias("measure"), F.col("lag_minutes").alias("value")).unionByName(late.select(F.lit("overdue").alias("measure"), F.col("overdue").cast("double").alias("value")))


_SCAN_LAG_SQL = f"""select 'lag_minutes' as measure, epoch_us(timestamp '{NOW}' - max(o_orderdate::timestamp)) / 60000000.0::double as value from orders
union all select 'overdue', count(*) filter (o_orderstatus = 'O' and o_orderdate < timestamp '{NOW}' - interval 10 minute)::double from orders"""


def endpoint_severities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.severities(_endpoint_events(spark, sf_dir), "endpoint", E.AlertFilter(severity="low", kind="file_integrity"), _START, _END)


def endpoint_machines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.by_machine(_endpoint_events(spark, sf_dir), "endpoint", _START, _END)


def library_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _read(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    kind = F.element_at(F.array(F.lit("ip"), F.lit("url"), F.lit("md5")), (k % 3 + 1).cast("int"))
    return N.by_type(c.select(kind.alias("type"), (k % 4 > 0).alias("enabled"), F.when(k % 5 == 0, F.lit(NOW).cast("timestamp")).alias("expires_at")), NOW)


def reconciled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two feeds imported at once beside a third."""
    c = _read(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    listed = c.select(F.lit("ip").alias("type"), k.cast("string").alias("value"), F.concat(F.lit("s"), (k % 3).cast("string")).alias("source"), F.lit("low").alias("severity"), (k % 7 > 0).alias("enabled"), F.when(k % 11 == 0, F.lit("1997-01-01").cast("timestamp")).alias("expires_at"))
    current = c.filter("c_acctbal > 0").select(F.lit("ip").alias("type"), F.when(k % 10 == 0, -k).otherwise(k).cast("string").alias("value"), F.concat(F.lit("s"), (k % 2).cast("string")).alias("source"), F.lit("high").alias("severity"))
    return lists.reconciled(listed, current, NOW).withColumn("expires_at", F.date_format("expires_at", SECOND))


_RECONCILED_SQL = f"""with l as (select cast(c_custkey as varchar) as value, 's' || (c_custkey % 3) as source, c_custkey % 7 > 0 as enabled, case when c_custkey % 11 = 0 then timestamp '1997-01-01' end as x from customer),
n as (select cast(case when c_custkey % 10 = 0 then -c_custkey else c_custkey end as varchar) as value, 's' || (c_custkey % 2) as source from customer where c_acctbal > 0)
select 'ip' as type, l.value, l.source, 'low' as severity, enabled or n.value is not null as enabled, strftime(case when n.value is not null then null when l.source <> 's2' and (x is null or x > timestamp '{NOW}') then timestamp '{NOW}' else x end, {SQL_SECOND}) as expires_at from l left join n on l.value = n.value and l.source = n.source
union all select 'ip', value, source, 'high', true, null from n where value not in (select value from l)"""

QUERIES = {
    "ingest_text_lines": text_lines,
    "ingest_json_batch": json_batch,
    "feed_csv": feed_csv,
    "feed_json": feed_json,
    "envelope_checks": envelope_checks,
    "rules_timestamps": timestamps,
    "rules_operators": rule_operators,
    "rules_keep_only": keep_only,
    "case_inspection": inspected,
    "rules_open_alerts": rules_open,
    "rules_due": rules_due,
    "rule_health": rule_health,
    "recovered_messages": recovered,
    "unparsed_watch": unparsed_plan,
    "default_watch": default_watch,
    "retired_collectors": retired,
    "capacity_findings": capacity,
    "list_counts": list_counts,
    "list_etag": list_etag,
    "ip6_overlap": ip6_overlap,
    "safe_drop_day": safe_drop,
    "ioc_alert_upsert": ioc_alerts,
    "endpoint_alert_list": endpoint_list,
    "endpoint_requests": endpoint_requests,
    "scan_lag": scan_lag,
    "endpoint_severities": endpoint_severities,
    "endpoint_machines": endpoint_machines,
    "indicator_types": library_types,
    "feed_reconciled": reconciled,
}

ORACLE_SQL = {
    "ingest_text_lines": _TEXT_LINES_SQL,
    "ingest_json_batch": _JSON_BATCH_SQL,
    "feed_csv": _FEED_SQL,
    "feed_json": _FEED_JSON_SQL,
    "envelope_checks": _ENVELOPE_SQL,
    "rules_timestamps": _TIMESTAMPS_SQL,
    "rules_operators": _RULE_OPERATORS_SQL,
    "rules_keep_only": _KEEP_ONLY_SQL,
    "case_inspection": _INSPECTED_SQL,
    "rules_open_alerts": f"with {_ALERTS_SQL}, {_RULES_SQL} select rule_id, name, severity, (select count(*) from a where a.rule_id = r.rule_id and status <> 'closed') as open_alerts from r",
    "rules_due": f"with {_RULES_SQL} select rule_id from r where enabled and (last_run_at is null or last_run_at <= timestamp '{NOW}' - to_seconds(greatest(coalesce(run_every_minutes, 1), 1) * 60 - 30))",
    "rule_health": f"with {_RULES_SQL} select count(*) filter (enabled and coalesce(last_run_at, created_at) < timestamp '{NOW}' - to_minutes(cast(greatest(10, 5 * coalesce(run_every_minutes, 1)) as integer))) as rules_behind, count(*) filter (enabled and last_error is not null) as rules_with_errors from r",
    "recovered_messages": _RECOVERED_SQL,
    "unparsed_watch": _UNPARSED_SQL,
    "default_watch": _DEFAULT_WATCH_SQL,
    "retired_collectors": "select count(*) as total, count(*) filter (s_suppkey % 7 = 0 or s_suppkey % 14 > 7) as retired from supplier",
    "capacity_findings": _CAPACITY_SQL,
    "list_counts": _LIST_COUNTS_SQL,
    "list_etag": "select sha256(string_agg(s_name, chr(10) order by s_name)) as etag from (select distinct s_name from supplier where s_suppkey % 3 <> 0)",
    "ip6_overlap": _IP6_SQL,
    "safe_drop_day": _SAFE_DROP_SQL,
    "ioc_alert_upsert": _IOC_ALERTS_SQL,
    "endpoint_alert_list": _ENDPOINT_LIST_SQL,
    "endpoint_requests": _REQUESTS_SQL,
    "scan_lag": _SCAN_LAG_SQL,
    "endpoint_severities": f"{_ENDPOINT_SQL} select (['low', 'medium', 'high', 'critical'])[n % 4 + 1] as alert_severity, count(*) as n from x where n % 3 = 0 group by 1",
    "endpoint_machines": f"{_ENDPOINT_SQL} select 'host' || (n % 9) as name, count(*) as n from x where n % 6 <> 0 group by 1",
    "indicator_types": "select (['ip', 'url', 'md5'])[c_custkey % 3 + 1] as type, count(*) as n, count(*) filter (c_custkey % 4 > 0 and c_custkey % 5 <> 0) as n_active from customer group by 1",
    "feed_reconciled": _RECONCILED_SQL,
}
