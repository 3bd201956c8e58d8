"""Queries over other tables as alerts, lists and log lines: alerts, indicators, lists, rule functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import rules as R
from ..functions import security as X
from ..operators import alerts as A
from ..operators import findings as D
from ..operators import indicators as N
from ..operators import ioc, lists
from ..sources import ingest
from ..sources.envelope import STAND_IN_SQL, stand_in
from .search import SECOND, SQL_SECOND


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as alerts: the customer's last digits are the rule, the priority is the severity."""
    o = _read(spark, sf_dir, "orders")
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    first = F.col("o_orderdate").cast("timestamp")
    return o.select(
        k.cast("string").alias("id"),
        F.when(c % 5 != 0, F.concat(F.lit("r"), (c % 20).cast("string"))).alias("rule_id"),
        F.concat(F.lit("rule "), (c % 20).cast("string")).alias("rule_name"),
        (c % 37).cast("string").alias("group_key"),
        F.element_at(F.array(F.lit("low"), F.lit("medium"), F.lit("high"), F.lit("critical"), F.lit("odd")), F.substring("o_orderpriority", 1, 1).cast("int")).alias("severity"),
        F.when(F.col("o_orderstatus") == "F", "closed").when(F.col("o_orderstatus") == "O", "open").otherwise("acknowledged").alias("status"),
        (k % 9 + 1).alias("event_count"),
        (k % 3).alias("merged_count"),
        F.when(k % 4 == 0, F.concat(F.lit("u"), (k % 6).cast("string"))).alias("assignee_id"),
        F.when(k % 10 != 0, first).alias("first_event_at"),
        (first + F.make_dt_interval((k % 5).cast("int"))).alias("last_event_at"),
        (first + F.make_dt_interval(F.lit(1))).alias("created_at"),
        F.concat(F.lit("t"), (c % 3).cast("string")).alias("tenant_id"),
    )


_ALERTS_SQL = """a as (select cast(o_orderkey as varchar) as id, case when o_custkey % 5 <> 0 then 'r' || (o_custkey % 20) end as rule_id, 'rule ' || (o_custkey % 20) as rule_name,
  cast(o_custkey % 37 as varchar) as group_key, (['low', 'medium', 'high', 'critical', 'odd'])[cast(o_orderpriority[1] as integer)] as severity,
  case o_orderstatus when 'F' then 'closed' when 'O' then 'open' else 'acknowledged' end as status, o_orderkey % 9 + 1 as event_count, o_orderkey % 3 as merged_count,
  case when o_orderkey % 4 = 0 then 'u' || (o_orderkey % 6) end as assignee_id, case when o_orderkey % 10 <> 0 then o_orderdate end as first_event_at,
  o_orderdate + to_days(cast(o_orderkey % 5 as integer)) as last_event_at, o_orderdate + interval 1 day as created_at, 't' || (o_custkey % 3) as tenant_id,
  coalesce('r' || case when o_custkey % 5 <> 0 then o_custkey % 20 end, 'rule ' || (o_custkey % 20)) as ident,
  case o_orderpriority[1] when '4' then 0 when '3' then 1 when '2' then 2 when '1' then 3 else 4 end as rank
  from orders)"""


def merge_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = A.merge_plan(_alerts(spark, sf_dir))
    return plan.withColumns({c: F.date_format(c, SECOND) for c in ("first_event_at", "last_event_at")})


def upserted(spark: SparkSession, sf_dir: str) -> DataFrame:
    alerts = _alerts(spark, sf_dir)
    now = "1998-01-15 00:00:00"
    hits = alerts.filter((F.col("created_at") < now) & F.col("rule_id").isNotNull()).groupBy("rule_id", "rule_name", "group_key")
    hits = hits.agg(F.lit("high").alias("severity"), F.count(F.lit(1)).alias("n"), F.min("created_at").alias("first_at"), F.max("created_at").alias("last_at"))
    old = alerts.filter(F.col("created_at") < now)
    after, _ = A.upserted(old, hits, now, 3 * 1440, 10 * 1440)
    return after.groupBy("rule_id", "status").agg(F.count(F.lit(1)).alias("n"), F.sum("event_count").alias("event_count"))


def notify(spark: SparkSession, sf_dir: str) -> DataFrame:
    channels = spark.sql(
        "select * from values ('mail', 't0', 'high', timestamp'1996-01-01', cast(null as string)), ('chat', 't1', 'low', timestamp'1998-01-01', 'RULE 1'), ('page', 't2', 'critical', timestamp'1992-01-01', null)"
        " as c(channel_id, tenant_id, min_severity, created_at, name_filter)"
    )
    alerts = _alerts(spark, sf_dir)
    sent = alerts.filter(F.col("id").cast("long") % 2 == 0).select(F.lit("mail").alias("channel_id"), F.col("id").alias("alert_id"))
    return A.to_notify(channels, alerts, sent).groupBy("channel_id").agg(F.count(F.lit(1)).alias("n"), F.min("alert_id").alias("least"), F.max("alert_id").alias("most"))


def techniques(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = _read(spark, sf_dir, "lineitem")
    of = lambda k: F.concat(F.lit("T1"), F.lpad((F.col(k) % 40).cast("string"), 3, "0"))
    samples = line.select(F.col("l_orderkey").cast("string").alias("alert_id"), (F.col("l_linenumber") * 100_000 + F.col("l_partkey")).alias("pos"), F.concat_ws(", ", of("l_partkey"), of("l_suppkey")).alias("techniques"))
    union = A.technique_union(_alerts(spark, sf_dir).select("id"), samples)
    return A.with_technique(union, "t101").select("id", F.array_join("techniques", ",").alias("techniques"))


def _indicators(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every candidate of the documents as an indicator."""
    found = _read(spark, sf_dir, "documents").select(F.explode(X.candidates(F.col("text"))).alias("key")).distinct()
    kind = F.substring_index("key", ":", 1)
    return found.select(kind.alias("type"), F.substr("key", F.char_length(kind) + 2).alias("value"), F.lit("test").alias("source"), F.lit("high").alias("severity"), F.lit(True).alias("enabled"))


def _doc_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _read(spark, sf_dir, "documents")
    at = F.timestamp_seconds(F.lit(1_700_000_000) + F.col("doc_id") % 1000)
    return d.select(F.col("doc_id").cast("string").alias("id"), at.alias("received_at"), F.col("text").alias("raw"))


def ioc_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ioc.matched(_doc_events(spark, sf_dir), _indicators(spark, sf_dir))
    return found.select("key", "n", F.date_format("first_at", SECOND).alias("first_at"), F.array_join("sample_ids", ",").alias("sample_ids"))


def ioc_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = _read(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text").union(_read(spark, sf_dir, "pages").select(-F.col("page_id") - 1, F.concat_ws(" ", "url", "html")))
    return texts.select("id", F.explode(X.candidates(F.col("text"))).alias("key"))


def url_prefixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "pages").select("page_id", F.explode(X.url_prefixes(F.lower("url"))).alias("prefix"))


def ioc_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _read(spark, sf_dir, "pages").select("page_id", F.explode(F.array("url", F.regexp_replace("url", "^http", "hXXp"), F.regexp_replace(F.regexp_extract("url", "//([^/?#]+)", 1), r"\.", "[.]"), F.md5("url"), F.sha2("url", 256), F.lit("10.0.0.1"), F.lit("a(at)b.example"), F.lit("no indicator"))).alias("v"))
    return p.select("page_id", X.refang(F.col("v")).alias("v"), X.classify(F.col("v")).alias("kind"))


def ip_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    c = _read(spark, sf_dir, "customer").select(k, F.concat_ws(".", F.lit("10"), (k % 4).cast("string"), (k % 16).cast("string"), (k % 200).cast("string")).alias("ip"))
    n = F.col("s_suppkey")
    s = _read(spark, sf_dir, "supplier").select(n, F.concat(F.lit("10."), (n % 6).cast("string"), F.lit("."), ((n * 3) % 32).cast("string"), F.lit(".0/"), (F.lit(20) + n % 6).cast("string")).alias("block"))
    return lists.overlapping(c, s, "ip", "block").select("c_custkey", "s_suppkey")


def domain_cover(spark: SparkSession, sf_dir: str) -> DataFrame:
    host = F.regexp_extract(F.lower("url"), r"//([^/?#:]+)", 1)
    hosts = _read(spark, sf_dir, "pages").select("page_id", host.alias("host"))
    allowed = _read(spark, sf_dir, "pages").select(F.regexp_replace(host, r"^[^.]+\.(?=[^.]+\.)", "").alias("domain")).distinct()
    return lists.covered_domains(hosts, allowed, "host", "domain").select("page_id", "domain")


def rules_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = _read(spark, sf_dir, "orders")
    at = F.col("o_orderdate").cast("timestamp")
    return o.select(
        "o_orderkey",
        F.date_format(R.parse_timestamp("%F %T", F.date_format(at, SECOND)), SECOND).alias("full"),
        F.date_format(R.parse_timestamp("%b %e %H:%M:%S", F.date_format(at, "MMM d HH:mm:ss"), 2000), SECOND).alias("yearless"),
        R.parse_timestamp("%F", F.col("o_orderpriority")).isNull().alias("bad"),
    )


def rules_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _read(spark, sf_dir, "conversations")
    words = R.regextract(F.col("text"), r"\b(\w)\w*ing\b")
    return c.select(
        "conv_id",
        "turn",
        R.if_chain(F.col("role") == "user", F.lit("u"), F.col("text").contains("the"), F.lit("the"), F.lit("other")).alias("chain"),
        R.first_filled(F.when(F.col("turn") % 2 == 0, ""), F.lit(None).cast("string"), F.col("role")).alias("filled"),
        R.to_integer(F.concat(F.lit(" "), F.col("turn").cast("string"), F.lit(".9 "))).alias("whole"),
        R.to_number(F.lit("0x10")).alias("hex"),
        F.array_join(F.slice(words, 1, 3), "").alias("ings"),
        R.arrayindex(F.split("text", " "), -1).alias("last"),
    )


_STRUCTURED = ('[x a="1"] ', "- ", r'[x a="\]\"\\" b="2"][y@1 c="[z"] ', "[no data] ")


def syslog(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = stand_in(spark, sf_dir)
    n = F.col("id").cast("long")
    text = lambda k: (n % k).cast("string")
    line = F.when(n % 3 == 0, F.concat(F.lit("<"), text(192), F.lit(">1 2024-01-02T03:04:05Z host"), text(5), F.lit(" app "), text(100), F.lit(" - "), F.element_at(F.array(*[F.lit(x) for x in _STRUCTURED]), (n % 4 + 1).cast("int")), F.col("raw")))
    line = line.when(n % 3 == 1, F.concat(F.lit("<"), text(192), F.lit(">Jan  2 03:04:05 host"), text(5), F.lit(" app["), text(100), F.lit("]: "), F.col("raw"))).otherwise(F.concat(F.lit(" "), F.col("raw"), F.lit(" ")))
    keys = ("format", "facility", "severity", "host", "app_name", "proc_id", "msg_id", "structured_data", "tag", "message")
    found = ingest.syslog(e.select(line.alias("value")), year=2024).select(*[F.get_json_object("parsed", f"$.{k}").alias(k) for k in keys], F.date_format("event_time", SECOND).alias("evt"))
    return found.groupBy(*found.columns).agg(F.count(F.lit(1)).alias("n"))


def duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.duplicates(_alerts(spark, sf_dir)).select("id", "ident", "group_key", "n", "rn")


def latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.latest_per_key(_alerts(spark, sf_dir), "group_key", F.desc("created_at"), F.asc("id")).select("group_key", "id")


def no_case(spark: SparkSession, sf_dir: str) -> DataFrame:
    in_case = _read(spark, sf_dir, "lineitem").filter("l_quantity > 45").select(F.col("l_orderkey").cast("string").alias("alert_id"))
    return A.unassigned(_alerts(spark, sf_dir), in_case).select("id")


def cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("case_id"), F.when(F.col("c_custkey") % 6 != 0, F.col("c_nationkey")).alias("owner_id"))
    ca = _read(spark, sf_dir, "orders").filter("o_orderstatus = 'O'").select(F.col("o_custkey").alias("case_id"), F.col("o_orderkey").alias("alert_id"))
    u = _read(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("user_id"), F.col("n_name").alias("name"))
    return A.cases_with_counts(c, ca, u).select("case_id", "owner", "n_alerts")


def ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.ranked_by_severity(_alerts(spark, sf_dir)).limit(100).select("id", "severity")


def bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _read(spark, sf_dir, "part")
    return p.groupBy(X.severity_of_level(F.pmod("p_size", F.lit(16))).alias("severity")).agg(F.count(F.lit(1)).alias("n"))


def machines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.by_machine_and_severity(_alerts(spark, sf_dir), "group_key", "severity", ["critical", "high", "medium", "low"])


def _findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = _alerts(spark, sf_dir)
    return a.select("severity", F.col("group_key").alias("agent"), F.col("rule_name").alias("package"), F.col("created_at").alias("detected_at"))


def daily_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.daily_summary(_findings(spark, sf_dir))


DAYS = (("1993-01-31", "1993-01-01"), ("1995-06-30", "1995-06-29"), ("1998-07-01", "1993-01-01"))


def summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings up to three days, each with those new since another day, and the changes from one to the next."""
    f, found = _findings(spark, sf_dir).withColumn("cve", F.col("package")), None
    for day, since in DAYS:
        one = D.summary(f.filter(F.col("detected_at") <= day), day, f"{since} 00:00:00")
        found = one if found is None else found.unionByName(one)
    return D.with_changes(found)


def _summaries_sql() -> str:
    names = ("critical", "high", "medium", "low")
    each = ", ".join(f"count(*) filter (severity = '{s}') as {s}, count(*) filter (severity = '{s}' and fresh) as new_{s}" for s in names)
    days = " union all ".join(f"select '{d}' as day, created_at >= timestamp '{s}' as fresh, a.* from (select 1) left join a on created_at <= timestamp '{d}'" for d, s in DAYS)
    changes = ", ".join(f"{s} - lag({s}) over (order by day) as {s}_change" for s in names)
    return f"""with {_ALERTS_SQL}, x as ({days}), s as (select day, count(id) as findings_total, count(distinct group_key) as machines, count(distinct rule_name) as distinct_cves, count(*) filter (severity = 'odd') as unknown, count(*) filter (fresh) as new_total, {each} from x group by day)
select *, findings_total - lag(findings_total) over (order by day) as total_change, {changes} from s"""


RANGES = (("1993-02-01", "1993-02-28"), ("1994-01-01", "1996-12-31"), ("1992-01-01", "1998-12-31"))


def sketched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct parts and suppliers by return flag for some ranges of days, exactly, and whether the days' sketches say so within three hundredths."""
    line, columns, by = _read(spark, sf_dir, "lineitem"), ["l_partkey", "l_suppkey"], "l_returnflag"
    day = F.date_format("l_shipdate", "yyyy-MM-dd")
    days = D.sketches(line, day, columns, by)
    close = lambda a, b: F.abs(F.col(a) - F.col(b)) <= 0.03 * F.col(b)
    out = None
    for first, last in RANGES:
        exact = line.filter(day.between(first, last)).groupBy(by).agg(*[F.count_distinct(c).alias(c) for c in columns])
        about = D.distinct_between(days, columns, first, last, by).select(by, F.col("l_partkey").alias("p"), F.col("l_suppkey").alias("s"))
        one = exact.join(about, by).select(F.lit(first).alias("first"), by, F.col("l_partkey").alias("parts"), F.col("l_suppkey").alias("suppliers"), close("p", "l_partkey").alias("parts_close"), close("s", "l_suppkey").alias("suppliers_close"))
        out = one if out is None else out.unionByName(one)
    return out


def disk_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = stand_in(spark, sf_dir)
    n = F.col("id").cast("long")
    samples = e.filter("collector_id is not null").select(F.col("collector_id").alias("host"), F.col("received_at").alias("at"), (n % 100).alias("used"), F.lit(100).alias("size"))
    return D.disk_health(samples, "2024-01-20 00:00:00").withColumn("at", F.date_format("at", SECOND))


def overview(spark: SparkSession, sf_dir: str) -> DataFrame:
    registry = _read(spark, sf_dir, "supplier").select(F.concat(F.lit("c"), F.col("s_suppkey").cast("string")).alias("name"), F.lit("2024-01-29 00:00:00").cast("timestamp").alias("last_seen"))
    return D.collector_overview(registry, stand_in(spark, sf_dir), "2024-01-30 00:00:00").withColumn("last_at", F.date_format("last_at", SECOND))


def packs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.range(24).select(F.concat(F.lit("r"), F.col("id").cast("string")).alias("rule_id"), F.concat(F.lit("pack"), (F.col("id") % 4).cast("string")).alias("pack"))
    return D.pack_usage(rules, _alerts(spark, sf_dir))


def unparsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = stand_in(spark, sf_dir)
    reason = F.when(F.col("id").cast("long") % 4 == 0, '{"_parse_error":"timeout"}').when(F.col("id").cast("long") % 9 == 0, '{"_parse_error":"other"}').otherwise(F.col("parsed"))
    return D.unparsed(e.withColumn("parsed", reason), ["timeout", "too long"])


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = _read(spark, sf_dir, "orders")
    ids = F.concat_ws(", ", "o_orderstatus", F.when(F.col("o_orderkey") % 2 == 0, "X"))
    p = D.paired_lists(ids, F.col("o_orderpriority"))
    return o.select("o_orderkey", F.size(p).alias("n"), F.get(p, F.lit(0))["id"].alias("id"), F.get(p, F.lit(0))["name"].alias("name"))


def _library(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _read(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    ip = F.concat_ws(".", F.lit("203"), (k % 5).cast("string"), (k % 7).cast("string"), (k % 250).cast("string"))
    return c.select(F.lit("ip").alias("type"), ip.alias("value"), F.concat(F.lit("s"), (k % 3).cast("string")).alias("source"), F.lit("low").alias("severity"), (k % 4 > 0).alias("enabled")).dropDuplicates(["type", "value"])


def _sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as indicators of three sources, of several types, not all of them enabled."""
    k = F.col("c_custkey")
    kind = F.element_at(F.array(*[F.lit(t) for t in ("ip", "url", "md5", "email")]), (F.floor(k % 12 / 3) % 3 + k % 2 + 1).cast("int"))
    return _read(spark, sf_dir, "customer").select(kind.alias("type"), F.concat(F.lit("s"), (k % 3).cast("string")).alias("source"), (k % 4 > 0).alias("enabled"))


def library_import(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _read(spark, sf_dir, "supplier").select(F.explode(F.array(F.concat(F.lit(" 203[.]1.1."), (F.col("s_suppkey") % 250).cast("string")), F.lit("not one"), F.lit("Bad[.]example"))).alias("value"))
    keep = _library(spark, sf_dir).select("type", "value", F.lit("old").alias("source"), "severity", F.lit(False).alias("enabled"))
    return N.imported(keep, lines, "new", "high")


def checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _read(spark, sf_dir, "supplier")
    k = F.col("s_suppkey")
    block = F.concat_ws(".", (k % 256).cast("string"), ((k * 5) % 256).cast("string"), F.lit("0"), F.concat(F.lit("0/"), (k % 25 + 4).cast("string")))
    return s.select(k, N.refusal(block).alias("refused"), N.normal_value(F.lit("domain"), F.concat(F.lit("*.Host"), k.cast("string"), F.lit("[.]Example."))).alias("domain"), N.normal_value(F.lit("hash"), F.upper(F.md5(k.cast("string")))).alias("hash"), N.normal_value(F.lit("url"), F.lit("HTTPS://no")).alias("url"))


QUERIES = {
    "finding_facets": lambda s, d: D.facets(_findings(s, d), ["severity", "agent", "package"]),
    "finding_cardinality": lambda s, d: D.cardinalities(_findings(s, d), ["agent", "package"], exact=True),
    "findings_since": lambda s, d: D.detected_since(_findings(s, d), "1998-01-01 00:00:00"),
    "findings_daily": daily_summary,
    "finding_sketches": sketched,
    "finding_summaries": summaries,
    "disk_health": disk_health,
    "collector_overview": overview,
    "pack_usage": packs,
    "unparsed_by_reason": unparsed,
    "paired_lists": pairs,
    "indicator_import": library_import,
    "indicator_listing": lambda s, d: N.listing(_library(s, d), "ip", None, "203.1", 10, 50).select("type", "value"),
    "indicator_sources": lambda s, d: N.by_source(_sources(s, d)).withColumn("types", F.array_join("types", ",")),
    "list_value_checks": checks,
    "dup_groups_ranked": duplicates,
    "merge_plan": merge_plan,
    "latest_per_key": latest,
    "alert_upsert": upserted,
    "candidates_anti": no_case,
    "cases_with_counts": cases,
    "notify_theta": notify,
    "severity_rank_list": ranked,
    "severity_summary": lambda s, d: A.severity_summary(_alerts(s, d)),
    "severity_buckets": lambda s, d: A.severity_buckets(_alerts(s, d)),
    "severity_bands": bands,
    "my_alerts": lambda s, d: A.mine(_alerts(s, d), "u4").withColumn("oldest_open", F.date_format("oldest_open", SECOND)),
    "pivot_severity": machines,
    "top_lists": lambda s, d: A.top_list(_alerts(s, d), F.col("rule_id")),
    "technique_union": techniques,
    "ioc_candidates": ioc_candidates,
    "ioc_match": ioc_match,
    "ioc_classify": ioc_classify,
    "url_prefixes": url_prefixes,
    "ip_range_overlap": ip_overlap,
    "domain_cover": domain_cover,
    "rules_functions": rules_functions,
    "rules_parse_ts": rules_parse,
    "syslog_parse": syslog,
}

# The same kinds of candidates in the other engine's pattern language, where \\b is a border between ASCII word characters and others.
_OCTET = "(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
_DOMAIN = "(?:[a-z0-9](?:[a-z0-9-]{0,61}[a-z0-9])?\\.)+[a-z]{2,24}"


def _keys_sql(texts: str) -> str:
    """Common table expressions ending in k(id, key), from a query of id and t (lower-cased text)."""
    return f"""t as ({texts}), u as (select id, regexp_replace(unnest(regexp_extract_all(t, '\\bhttps?://[^\\s"''<>]+')), '[.,;)\\]]+$', '') as url from t),
v as (select id, url, regexp_replace(url, '[?#].*$', '') as bare, regexp_extract(url, '^(https?://[^/?#\\s]+)', 1) as origin from u where regexp_matches(url, '^https?://[^/?#]')),
s as (select *, list_filter(string_split(substr(bare, length(origin) + 1), '/'), lambda x: x <> '') as path from v),
d as (select id, string_split(unnest(regexp_extract_all(t, '\\b{_DOMAIN}\\b')), '.') as labels from t),
h as (select id, unnest(regexp_extract_all(t, '\\b(?:[0-9a-f]{{64}}|[0-9a-f]{{40}}|[0-9a-f]{{32}})\\b')) as h from t),
k as (select distinct id, key from (
  select id, 'ip:' || unnest(regexp_extract_all(t, '\\b{_OCTET}(?:\\.{_OCTET}){{3}}\\b')) as key from t
  union all select id, 'email:' || unnest(regexp_extract_all(t, '\\b[a-z0-9._%+-]+@[a-z0-9.-]+\\.[a-z]{{2,}}')) from t
  union all select id, (case length(h) when 32 then 'md5:' when 40 then 'sha1:' else 'sha256:' end) || h from h
  union all select id, 'url:' || unnest([url, bare, origin, origin || '/'] || list_transform(range(1, len(path) + 1), lambda i: origin || '/' || array_to_string(path[1:i], '/'))) from s
  union all select id, 'domain:' || array_to_string(labels[unnest(range(1, len(labels))) : len(labels)], '.') from d))"""


_CANDIDATES_SQL = _keys_sql("select doc_id as id, lower(text) as t from documents")
_ALL_CANDIDATES_SQL = _keys_sql("select doc_id as id, lower(text) as t from documents union all select -page_id - 1, lower(concat_ws(' ', url, html)) from pages")
_LIBRARY_SQL = "lib as (select distinct '203.' || (c_custkey % 5) || '.' || (c_custkey % 7) || '.' || (c_custkey % 250) as value from customer)"
ORACLE_SQL = {
    "finding_facets": f"with {_ALERTS_SQL}, f as (select facet, value, count(*) as n from (select unnest(['severity', 'agent', 'package']) as facet, unnest([severity, group_key, rule_name]) as value from a) group by 1, 2), r as (select *, row_number() over (partition by facet order by n desc, value) as rn from f) select facet, value, n from r where rn <= 10",
    "finding_cardinality": f"with {_ALERTS_SQL} select count(distinct group_key) as agent, count(distinct rule_name) as package from a",
    "findings_since": f"with {_ALERTS_SQL} select severity, count(*) as n from a where created_at >= timestamp '1998-01-01' group by 1",
    "findings_daily": f"with {_ALERTS_SQL}, d as (select strftime(created_at, '%Y-%m-%d') as day, count(*) filter (rank = 0) as critical, count(*) filter (rank = 1) as high, count(*) filter (rank = 2) as medium, count(*) filter (rank = 3) as low, count(*) as total from a group by 1) select *, total - lag(total) over (order by day) as change from d",
    "finding_summaries": _summaries_sql(),
    "finding_sketches": " union all ".join(
        f"select '{a}' as first, l_returnflag, count(distinct l_partkey) as parts, count(distinct l_suppkey) as suppliers, true as parts_close, true as suppliers_close from lineitem where strftime(l_shipdate, '%Y-%m-%d') between '{a}' and '{b}' group by l_returnflag" for a, b in RANGES
    ),
    "disk_health": f"with {STAND_IN_SQL}, h as (select collector_id as host, arg_max(cast(id as bigint) % 100, received_at) as used, max(received_at) as m from e where collector_id is not null and received_at <= timestamp '2024-01-20' and received_at >= timestamp '2024-01-20' - interval 6 hour group by 1) select host, strftime(m, {SQL_SECOND}) as at, cast(used as integer) as percent, m < timestamp '2024-01-20' - interval 15 minute as stale, used >= 90 as full from h",
    "collector_overview": f"with {STAND_IN_SQL}, r as (select 'c' || s_suppkey as name, timestamp '2024-01-29' as last_seen from supplier), c as (select collector_id as seen, count(*) as n_week, count(*) filter (received_at >= timestamp '2024-01-29') as n_day, max(received_at) as m from e where received_at >= timestamp '2024-01-23' and collector_id is not null group by 1) select coalesce(name, seen) as name, name is not null as registered, coalesce(n_week, 0) as n_week, coalesce(n_day, 0) as n_day, strftime(greatest(last_seen, m), {SQL_SECOND}) as last_at from r full join c on name = seen",
    "pack_usage": f"with {_ALERTS_SQL}, r as (select 'r' || i as rule_id, 'pack' || (i % 4) as pack from (select unnest(range(24)) as i)) select pack, count(distinct r.rule_id) as n_rules, count(id) as n_alerts from r left join a on a.rule_id = r.rule_id group by 1",
    "unparsed_by_reason": "select 'timeout' as reason, count(*) filter (event_id % 4 = 0) as n from events union all select 'too long', 0 union all select 'other', count(*) filter (event_id % 4 <> 0 and event_id % 9 = 0) from events",
    "paired_lists": "select o_orderkey, case when o_orderkey % 2 = 0 then 2 else 1 end as n, o_orderstatus as id, case when o_orderkey % 2 = 1 then o_orderpriority end as name from orders",
    "indicator_import": f"with {_LIBRARY_SQL}, n as (select distinct '203.1.1.' || (s_suppkey % 250) as value from supplier) select 'ip' as type, value, 'old' as source, 'low' as severity, false as enabled from lib where value not in (select value from n) union all select 'ip', value, 'new', 'high', true from n union all select 'domain', 'bad.example', 'new', 'high', true",
    "indicator_listing": f"with {_LIBRARY_SQL} select 'ip' as type, value from lib where contains(value, '203.1') order by value limit 50 offset 10",
    "indicator_sources": "select 's' || (c_custkey % 3) as source, count(*) as n, count(*) filter (c_custkey % 4 > 0) as n_enabled, string_agg(distinct type, ',' order by type) as types from (select c_custkey, (['ip', 'url', 'md5', 'email'])[c_custkey % 12 // 3 % 3 + c_custkey % 2 + 1] as type from customer) group by 1",
    "list_value_checks": """with s as (select s_suppkey as k, s_suppkey % 25 + 4 as bits, (s_suppkey % 256) * 16777216 + ((s_suppkey * 5) % 256) * 65536 as ip from supplier), r as (select *, ip - ip % cast(pow(2, 32 - bits) as bigint) as lo, ip - ip % cast(pow(2, 32 - bits) as bigint) + cast(pow(2, 32 - bits) as bigint) - 1 as hi from s),
p(a, b) as (values (167772160, 184549375), (2886729728, 2887778303), (3232235520, 3232301055), (2130706432, 2147483647), (2851995648, 2852061183), (1681915904, 1686110207), (0, 16777215), (3758096384, 4026531839), (4026531840, 4294967295))
select k as s_suppkey, case when bits < 8 then 'too wide' when exists (select 1 from p where lo <= b and a <= hi) then 'private' end as refused, 'host' || k || '.example' as domain, md5(cast(k as varchar)) as hash, cast(null as varchar) as url from r""",
    "dup_groups_ranked": f"with {_ALERTS_SQL}, d as (select id, ident, group_key, count(*) over (partition by ident, group_key) as n, cast(row_number() over (partition by ident, group_key order by coalesce(first_event_at, created_at), id) as integer) as rn from a) select * from d where n > 1 and rn <= 50",
    "merge_plan": f"""with {_ALERTS_SQL}, p as (select *, row_number() over (partition by ident, group_key order by coalesce(first_event_at, created_at), id) as rn from a)
select ident, group_key, max(id) filter (rn = 1) as primary_id, count(*) as n, (['critical', 'high', 'medium', 'low'])[min(rank) + 1] as severity, case when bool_or(status = 'open') then 'open' else 'acknowledged' end as status,
  coalesce(max(assignee_id) filter (rn = 1), arg_max(assignee_id, (last_event_at, id)) filter (assignee_id is not null)) as assignee_id, cast(sum(event_count) as bigint) as event_count, cast(sum(merged_count + 1) as bigint) as merged_count,
  strftime(min(first_event_at), {SQL_SECOND}) as first_event_at, strftime(max(last_event_at), {SQL_SECOND}) as last_event_at from p group by ident, group_key having count(*) > 1""",
    "latest_per_key": f"with {_ALERTS_SQL} select group_key, id from (select group_key, id, row_number() over (partition by group_key order by created_at desc, id) as rn from a) where rn = 1",
    "alert_upsert": f"""with {_ALERTS_SQL}, o as (select * from a where created_at < timestamp '1998-01-15'),
h as (select rule_id, rule_name, group_key, count(*) as n, max(created_at) as last_at from o where rule_id is not null group by all),
w as (select * from (select *, row_number() over (partition by rule_id, group_key order by created_at desc, id desc) as rn from o where status <> 'closed' and rule_id is not null and last_event_at >= timestamp '1998-01-15' - interval 6 day) where rn = 1),
m as (select w.id, h.n from h join w using (rule_id, group_key)),
f as (select * from h where (rule_id, group_key) not in (select (rule_id, group_key) from w) and (rule_id, group_key) not in (select (rule_id, group_key) from o where rule_id is not null and created_at > timestamp '1998-01-15' - interval 10 day)),
u as (select rule_id, status, greatest(event_count, coalesce(m.n, event_count)) as event_count from o left join m using (id) union all select rule_id, 'open', n from f)
select rule_id, status, count(*) as n, cast(sum(event_count) as bigint) as event_count from u group by 1, 2""",
    "candidates_anti": f"with {_ALERTS_SQL} select id from a where id not in (select cast(l_orderkey as varchar) from lineitem where l_quantity > 45)",
    "cases_with_counts": "select c_custkey as case_id, n_name as owner, (select count(*) from orders where o_custkey = c_custkey and o_orderstatus = 'O') as n_alerts from customer left join nation on c_nationkey = n_nationkey and c_custkey % 6 <> 0",
    "notify_theta": f"""with {_ALERTS_SQL}, c(channel_id, tenant_id, worst, since, f) as (values ('mail', 't0', 1, timestamp '1996-01-01', null), ('chat', 't1', 3, timestamp '1998-01-01', 'rule 1'), ('page', 't2', 0, timestamp '1992-01-01', null))
select channel_id, count(*) as n, min(id) as least, max(id) as most from a join c on a.tenant_id = c.tenant_id and rank <= worst and created_at >= since and (f is null or contains(lower(rule_name), f)) where not (channel_id = 'mail' and cast(id as bigint) % 2 = 0) group by 1""",
    "severity_rank_list": f"with {_ALERTS_SQL} select id, severity from a order by rank, last_event_at desc, id limit 100",
    "severity_summary": f"with {_ALERTS_SQL} select s as severity, (select count(*) from a where severity = s) as n from (select unnest(['critical', 'high', 'medium', 'low']) as s)",
    "severity_buckets": f"with {_ALERTS_SQL} select case when rank < 4 then severity else 'unknown' end as severity, count(*) as n from a group by 1",
    "severity_bands": "select case when p_size % 16 >= 12 then 'critical' when p_size % 16 >= 8 then 'high' when p_size % 16 >= 5 then 'medium' else 'low' end as severity, count(*) as n from part group by 1",
    "my_alerts": f"with {_ALERTS_SQL} select severity, status, count(*) as n, strftime(min(created_at) filter (status = 'open'), {SQL_SECOND}) as oldest_open from a where assignee_id = 'u4' group by 1, 2",
    "pivot_severity": f"with {_ALERTS_SQL} select group_key, count(*) filter (severity = 'critical') as critical, count(*) filter (severity = 'high') as high, count(*) filter (severity = 'medium') as medium, count(*) filter (severity = 'low') as low from a group by 1",
    "top_lists": f"with {_ALERTS_SQL} select rule_id as key, count(*) as n from a where rule_id is not null group by 1 order by n desc, key limit 10",
    "technique_union": """with s as (select l_orderkey, l_linenumber * 100000 + l_partkey as pos, unnest([l_partkey, l_suppkey]) as k, unnest([0, 1]) as evt from lineitem),
t as (select l_orderkey, 'T1' || lpad(cast(k % 40 as varchar), 3, '0') as t, min((pos, evt)) as place from s group by 1, 2), r as (select *, row_number() over (partition by l_orderkey order by place, t) as rn from t)
select cast(l_orderkey as varchar) as id, string_agg(t, ',' order by rn) as techniques from r where rn <= 20 and l_orderkey in (select o_orderkey from orders) group by 1 having bool_or(t like 'T101%')""",
    "ioc_candidates": f"with {_ALL_CANDIDATES_SQL} select id, key from k",
    "ioc_match": f"""with {_CANDIDATES_SQL}, m as (select key, id as doc_id, row_number() over (partition by key order by id % 1000, cast(id as varchar)) as rn from k)
select key, count(*) as n, strftime(make_timestamp(cast((1700000000 + min(doc_id % 1000)) * 1000000 as bigint)), {SQL_SECOND}) as first_at, string_agg(cast(doc_id as varchar), ',' order by rn) filter (rn <= 5) as sample_ids from m group by key""",
    "ioc_classify": """with v as (select page_id, unnest([url, url, regexp_extract(url, '//([^/?#]+)', 1), md5(url), sha256(url), '10.0.0.1', 'a@b.example', 'no indicator']) as v, unnest(['url', 'url', 'domain', 'md5', 'sha256', 'ip', 'email', null]) as kind from pages) select page_id, v, kind from v""",
    "url_prefixes": """with u as (select page_id, lower(url) as url, regexp_replace(lower(url), '[?#].*$', '') as bare, regexp_extract(lower(url), '^(https?://[^/?#]+)', 1) as origin from pages),
p as (select *, list_filter(string_split(substr(bare, length(origin) + 1), '/'), lambda x: x <> '') as path from u),
x as (select page_id, unnest(list_distinct([url, bare, origin || '/', origin] || list_transform(range(1, len(path) + 1), lambda i: origin || '/' || array_to_string(path[1:i], '/')))) as prefix from p) select * from x""",
    "ip_range_overlap": """with c as (select c_custkey, (10 * 256 + c_custkey % 4) * 65536 + (c_custkey % 16) * 256 + c_custkey % 200 as ip from customer),
s as (select s_suppkey, (10 * 256 + s_suppkey % 6) * 65536 + ((s_suppkey * 3) % 32) * 256 as ip, cast(pow(2, 12 - s_suppkey % 6) as bigint) as size from supplier)
select c_custkey, s_suppkey from c join s on c.ip between s.ip - s.ip % size and s.ip - s.ip % size + size - 1""",
    "domain_cover": """with h as (select page_id, regexp_extract(lower(url), '//([^/?#:]+)', 1) as host from pages),
d as (select distinct case when len(string_split(host, '.')) >= 3 then substr(host, position('.' in host) + 1) else host end as domain from h)
select page_id, domain from h join d on host = domain or ends_with(host, '.' || domain) or ends_with(domain, '.' || host)""",
    "rules_functions": """select conv_id, turn, case when role = 'user' then 'u' when contains(text, 'the') then 'the' else 'other' end as chain, role as filled, cast(turn as bigint) as whole, 16.0::double as hex,
  array_to_string(regexp_extract_all(text, '\\b(\\w)\\w*ing\\b', 1)[1:3], '') as ings, string_split(text, ' ')[-1] as last from conversations""",
    "rules_parse_ts": f"select o_orderkey, strftime(o_orderdate, {SQL_SECOND}) as full, strftime(make_timestamp(2000, month(o_orderdate), day(o_orderdate), hour(o_orderdate), minute(o_orderdate), second(o_orderdate)), {SQL_SECOND}) as yearless, true as bad from orders",
    "syslog_parse": f"""with f as (select n, raw, (['kern', 'user', 'mail', 'daemon', 'auth', 'syslog', 'lpr', 'news', 'uucp', 'cron', 'authpriv', 'ftp', 'ntp', 'security', 'console', 'solaris-cron', 'local0', 'local1', 'local2', 'local3', 'local4', 'local5', 'local6', 'local7'])[(n % 192) // 8 + 1] as facility,
  (['emerg', 'alert', 'crit', 'err', 'warning', 'notice', 'info', 'debug'])[n % 8 + 1] as severity from (select event_id as n, event_type || ' user=' || user_id as raw from events))
select case n % 3 when 0 then 'rfc5424' when 1 then 'rfc3164' else 'unstructured' end as format, case when n % 3 < 2 then facility end as facility, case when n % 3 < 2 then severity end as severity,
  case when n % 3 < 2 then 'host' || (n % 5) end as host, case when n % 3 = 0 then 'app' end as app_name, case when n % 3 = 0 then cast(n % 100 as varchar) end as proc_id, cast(null as varchar) as msg_id,
  case when n % 3 = 0 then (['[x a="1"]', null, '[x a="\\]\\"\\\\" b="2"][y@1 c="[z"]', null])[n % 4 + 1] end as structured_data, case when n % 3 = 1 then 'app[' || (n % 100) || ']' end as tag, case when n % 12 = 3 then '[no data] ' || raw else raw end as message, case when n % 3 < 2 then '2024-01-02 03:04:05' end as evt, count(*) as n
from f group by all""",
}
