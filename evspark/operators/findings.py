"""Findings of scanners and machine health: facets, daily summaries, disks; and registries joined with counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.security import SEVERITIES


def facets(findings: DataFrame, columns: list[str], most: int = 10) -> DataFrame:
    """The most frequent values of each column: facet, value, n. One pass with grouping sets for all columns."""
    sets = findings.select(F.explode(F.array(*[F.struct(F.lit(c).alias("facet"), F.col(c).cast("string").alias("value")) for c in columns])).alias("f")).select("f.*")
    n = sets.filter(F.col("value").isNotNull()).groupBy("facet", "value").agg(F.count(F.lit(1)).alias("n"))
    rank = F.row_number().over(Window.partitionBy("facet").orderBy(F.desc("n"), "value"))
    return n.withColumn("rn", rank).filter(F.col("rn") <= most).drop("rn")


def cardinalities(findings: DataFrame, columns: list[str], exact: bool = False) -> DataFrame:
    """Distinct values of each column, approximate unless exact is asked for."""
    return findings.agg(*[(F.count_distinct(c) if exact else F.approx_count_distinct(c)).alias(c) for c in columns])


#: Logarithm of the slots of a sketch: a relative error of 0.8 % (one deviation), in some 16 kB.
SKETCH_LOG = 14


def sketches(rows: DataFrame, day: Column, columns: list[str], *by: str) -> DataFrame:
    """A sketch of the distinct values of each column for each day, to be stored: days are summed up without the rows. Null values don't count."""
    return rows.groupBy(*by, day.alias("day")).agg(*[F.hll_sketch_agg(c, F.lit(SKETCH_LOG)).alias(c) for c in columns])


def distinct_between(sketched: DataFrame, columns: list[str], first: str, last: str, *by: str) -> DataFrame:
    """About how many distinct values each column has from one day to another, both included, from `sketches`."""
    days = sketched.filter(F.col("day").between(first, last))
    merged = [F.hll_sketch_estimate(F.hll_union_agg(c)).alias(c) for c in columns]
    return days.groupBy(*by).agg(*merged) if by else days.agg(*merged)


def detected_since(findings: DataFrame, since: str) -> DataFrame:
    return findings.filter(F.col("detected_at") >= F.lit(since).cast("timestamp")).groupBy("severity").agg(F.count(F.lit(1)).alias("n"))


def daily_summary(findings: DataFrame) -> DataFrame:
    """Per day of detection: findings by severity, all, and the change of all since the day before that had any."""
    days = findings.groupBy(F.date_format("detected_at", "yyyy-MM-dd").alias("day")).agg(*[F.count_if(F.col("severity") == s).alias(s) for s in SEVERITIES], F.count(F.lit(1)).alias("total"))
    return days.withColumn("change", F.col("total") - F.lag("total").over(Window.orderBy("day")))  # one row a day


def summary(findings: DataFrame, day: str, since: str) -> DataFrame:
    """One row for the findings as they are: day, findings_total, machines (column agent), distinct_cves (column cve, where there is one), counts by
    severity with `unknown` for any other, and with new_ before them those first detected at `since` or later."""
    at = F.col("detected_at") >= F.lit(since).cast("timestamp")
    known = F.coalesce(F.col("severity").isin(*SEVERITIES), F.lit(False))
    cves = [F.count_distinct("cve").alias("distinct_cves")] if "cve" in findings.columns else []
    each = [f(s) for s in SEVERITIES for f in (lambda s: F.count_if(F.col("severity") == s).alias(s), lambda s: F.count_if(at & (F.col("severity") == s)).alias(f"new_{s}"))]
    return findings.agg(F.lit(day).alias("day"), F.count(F.lit(1)).alias("findings_total"), F.count_distinct("agent").alias("machines"), *cves, F.count_if(~known).alias("unknown"), F.count_if(at).alias("new_total"), *each)


def with_changes(summaries: DataFrame) -> DataFrame:
    """Summaries, a row a day, with total_change and a change for each severity since the day before that has one; null for the first."""
    before = Window.orderBy("day")  # one row a day
    change = lambda c, name: (F.col(c) - F.lag(c).over(before)).alias(name)
    return summaries.select("*", change("findings_total", "total_change"), *[change(s, f"{s}_change") for s in SEVERITIES])


def disk_health(samples: DataFrame, now: str, hours: int = 6, stale_minutes: int = 15, full_percent: int = 90) -> DataFrame:
    """Newest sample of each host within the last hours: percent used, whether it is stale, whether the disk is nearly full."""
    at = F.lit(now).cast("timestamp")
    recent = samples.filter((F.col("at") <= at) & (F.col("at") >= at - F.make_dt_interval(F.lit(0), F.lit(hours))))
    last = recent.groupBy("host").agg(F.max(F.struct("at", "used", "size")).alias("s"))
    percent = F.floor(100 * F.col("s.used") / F.nullif(F.col("s.size"), F.lit(0))).cast("int")
    return last.select("host", F.col("s.at").alias("at"), percent.alias("percent"), (F.col("s.at") < at - F.make_dt_interval(F.lit(0), F.lit(0), F.lit(stale_minutes))).alias("stale"), (percent >= full_percent).alias("full"))


def collector_overview(registry: DataFrame, events: DataFrame, now: str) -> DataFrame:
    """Registered collectors and those only seen in events, with counts of seven days and of one, first and last arrival."""
    at = F.lit(now).cast("timestamp")
    week = events.filter((F.col("received_at") >= at - F.expr("interval 7 days")) & F.col("collector_id").isNotNull())
    counts = week.groupBy(F.col("collector_id").alias("seen")).agg(
        F.count(F.lit(1)).alias("n_week"), F.count_if(F.col("received_at") >= at - F.expr("interval 1 day")).alias("n_day"), F.min("received_at").alias("first_at"), F.max("received_at").alias("last_at")
    )
    both = registry.join(counts, F.col("name") == F.col("seen"), "full_outer")
    return both.select(F.coalesce("name", "seen").alias("name"), F.col("name").isNotNull().alias("registered"), F.coalesce("n_week", F.lit(0)).alias("n_week"), F.coalesce("n_day", F.lit(0)).alias("n_day"), F.greatest("last_seen", "last_at").alias("last_at"))


def pack_usage(rules: DataFrame, alerts: DataFrame) -> DataFrame:
    """Per pack: its rules (rule_id, pack) and the alerts that they have."""
    n = alerts.groupBy("rule_id").agg(F.count(F.lit(1)).alias("n"))
    return rules.join(n, "rule_id", "left").groupBy("pack").agg(F.count(F.lit(1)).alias("n_rules"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_alerts"))


def unparsed(events: DataFrame, reasons: list[str]) -> DataFrame:
    """Events by the reason why they were stored unparsed (`_parse_error` in the document), zero for reasons without any."""
    reason = F.get_json_object("parsed", "$['_parse_error']")
    n = events.select(reason.alias("reason")).filter(F.col("reason").isNotNull()).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))
    spine = events.sparkSession.range(1).select(F.explode(F.array(*[F.lit(r) for r in reasons])).alias("reason"))
    return spine.join(n, "reason", "full_outer").select("reason", F.coalesce("n", F.lit(0)).alias("n"))


def paired_lists(ids: Column, names: Column) -> Column:
    """Comma-separated ids with their names, which are only trusted if there are as many."""
    split = lambda c: F.filter(F.split(F.coalesce(c, F.lit("")), r"\s*,\s*"), lambda x: x != "")
    a, b = split(ids), split(names)
    return F.when(F.size(a) == F.size(b), F.zip_with(a, b, lambda x, y: F.struct(x.alias("id"), y.alias("name")))).otherwise(F.transform(a, lambda x: F.struct(x.alias("id"), F.lit(None).cast("string").alias("name"))))
