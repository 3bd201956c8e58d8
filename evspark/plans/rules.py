"""Queries that run many rules: one scan for forty of them, and two cycles with merging and suppression."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import predicates as P
from ..operators import cycle
from ..operators.rulesets import Detection
from ..sources.envelope import STAND_IN_SQL, stand_in
from .search import SECOND, SQL_SECOND

FIRST, THEN = "2024-01-24 00:00:00", "2024-01-28 00:00:00"
ALERTS = (
    "id string, rule_id string, rule_name string, group_key string, severity string, status string, event_count long, first_event_at timestamp, last_event_at timestamp, created_at timestamp"
)
SOURCES, GROUPS, WINDOWS = ("view", "click", "error", "purchase", "signup"), ("none", "field:collector_id", r"user=(\d)"), (60, 720, 1440, 10_080)


def forty() -> list[Detection]:
    """Rules over all kinds of events, with each kind of group and several windows, thresholds and suppressions."""

    def rule(i: int) -> Detection:
        conditions = lambda: [P.dataset(SOURCES[i % 5]), P.above("k", i * 7 % 60)]
        return Detection(f"rule {i:02d}", "high" if i % 2 else "low", conditions, GROUPS[i % 3], 1 + i % 6, WINDOWS[i % 4], suppress_minutes=i % 5 * 1440 or None)

    return [rule(i) for i in range(40)]


def one_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = cycle.hits(stand_in(spark, sf_dir), forty(), THEN)
    return found.select("rule_id", "group_key", "severity", "n", F.date_format("first_at", SECOND).alias("first_at"), F.date_format("last_at", SECOND).alias("last_at"), F.array_join("sample_ids", ",").alias("sample_ids"), "sample_raw")


def two_cycles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A cycle over what had arrived by FIRST, and another by THEN."""
    events = stand_in(spark, sf_dir)
    none = spark.createDataFrame([], ALERTS)
    run = lambda alerts, now: cycle.changes(alerts, cycle.hits(events.filter(F.col("received_at") <= now), forty(), now), now)
    alerts = cycle.applied(none, run(none, FIRST))
    show = [F.date_format(c, SECOND).alias(c) for c in ("first_event_at", "last_event_at", "created_at")]
    return run(alerts, THEN).select("rule_id", "group_key", "change", "event_count", *show)


_RULES_SQL = f"""{STAND_IN_SQL}, rules as (select i, 'rule ' || lpad(cast(i as varchar), 2, '0') as rule_id, case when i % 2 = 1 then 'high' else 'low' end as severity, ({list(SOURCES)})[i % 5 + 1] as source,
  i * 7 % 60 as least, 1 + i % 6 as threshold, ({list(WINDOWS)})[i % 4 + 1] as win, i % 5 * 1440 as quiet from (select unnest(range(40)) as i))"""


def _hits_sql(now: str, name: str, arrived: str) -> str:
    key = "case i % 3 when 0 then 'all' when 1 then coalesce(collector_id, 'unknown') else coalesce(nullif(regexp_extract(raw, 'user=(\\d)', 1), ''), 'unknown') end"
    return f"""{name}_m as (select rules.*, {key} as group_key, evt, id, raw from e join rules on source_type = source and cast(k as double) > least where evt > timestamp '{now}' - to_minutes(cast(win as integer)) and {arrived}),
{name}_r as (select *, row_number() over (partition by rule_id, group_key order by evt desc, id desc) as rn from {name}_m),
{name} as (select rule_id, group_key, severity, threshold, win, quiet, count(*) as n, min(evt) as first_at, max(evt) as last_at, string_agg(id, ',' order by rn) filter (rn <= 5) as sample_ids, max(raw) filter (rn = 1) as sample_raw
  from {name}_r group by all having count(*) >= threshold)"""


QUERIES = {"rules_one_scan": one_scan, "rules_cycle": two_cycles}

ORACLE_SQL = {
    "rules_one_scan": f"with {_RULES_SQL}, {_hits_sql(THEN, 'h', 'true')} select rule_id, group_key, severity, n, strftime(first_at, {SQL_SECOND}) as first_at, strftime(last_at, {SQL_SECOND}) as last_at, sample_ids, sample_raw from h",
    "rules_cycle": f"""with {_RULES_SQL}, {_hits_sql(FIRST, "a", f"received_at <= timestamp '{FIRST}'")}, {_hits_sql(THEN, "b", f"received_at <= timestamp '{THEN}'")},
j as (select b.*, a.n as old_n, a.first_at as old_first, a.last_at > timestamp '{THEN}' - to_minutes(cast(2 * b.win as integer)) as active, a.rule_id is not null and b.quiet > 0 and timestamp '{FIRST}' > timestamp '{THEN}' - to_minutes(cast(b.quiet as integer)) as recent
  from b left join a on a.rule_id = b.rule_id and a.group_key = b.group_key)
select rule_id, group_key, case when active then 'updated' when recent then 'suppressed' else 'created' end as change, case when active then greatest(n, old_n) else n end as event_count,
  strftime(case when active then old_first else first_at end, {SQL_SECOND}) as first_event_at, strftime(last_at, {SQL_SECOND}) as last_event_at, case when active then '{FIRST}' else '{THEN}' end as created_at from j""",
}
