"""Alerts as tables: duplicates and their merge plan, upserts of new hits, summaries and top lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.security import SEVERITIES, severity_of_rank, severity_rank

MOST_MEMBERS = 50
#: Who closed an alert that no person did.
PLATFORM = "platform"


def identity() -> Column:
    return F.coalesce("rule_id", "rule_name")


def duplicates(alerts: DataFrame) -> DataFrame:
    """Alerts that share rule and group with others: n of them, and rn, their place by first event, creation and id.

    Groups are counted by partial aggregation, and of the ranks only the first MOST_MEMBERS of each task are shuffled, so a group may be of any size.
    """
    named = alerts.withColumn("ident", identity())
    n = named.groupBy("ident", "group_key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1)
    place = Window.partitionBy("ident", "group_key").orderBy(F.coalesce("first_event_at", "created_at"), "id")
    first = named.withColumn("rn", F.row_number().over(place)).filter(F.col("rn") <= MOST_MEMBERS)
    n = n.select(F.col("ident").alias("n_ident"), F.col("group_key").alias("n_key"), "n")
    found = first.join(n, (F.col("ident") == F.col("n_ident")) & F.col("group_key").eqNullSafe(F.col("n_key"))).drop("n_ident", "n_key")
    return found.orderBy(F.desc("n"), "ident", "group_key", "rn")


def merge_plan(alerts: DataFrame) -> DataFrame:
    """One row for each group of duplicates: the primary alert's id and what it becomes.

    Worst severity; open if any is open; the primary's assignee, else that of the latest active; sums and time bounds.
    """
    primary = F.struct(F.coalesce("first_event_at", "created_at").alias("at"), "id")
    latest = F.max_by("assignee_id", F.when(F.col("assignee_id").isNotNull(), F.struct("last_event_at", "id")))
    plan = alerts.groupBy(identity().alias("ident"), "group_key").agg(
        F.count(F.lit(1)).alias("n"),
        F.min(primary).alias("first"),
        F.min_by("assignee_id", primary).alias("own"),
        latest.alias("other"),
        F.min(severity_rank(F.col("severity"))).alias("rank"),
        F.max((F.col("status") == "open").cast("int")).alias("any_open"),
        F.sum("event_count").alias("event_count"),
        F.sum(F.coalesce("merged_count", F.lit(0)) + 1).alias("merged_count"),
        F.min("first_event_at").alias("first_event_at"),
        F.max("last_event_at").alias("last_event_at"),
    )
    return plan.filter(F.col("n") > 1).select(
        "ident", "group_key", F.col("first.id").alias("primary_id"), "n", severity_of_rank(F.col("rank")).alias("severity"),
        F.when(F.col("any_open") == 1, "open").otherwise("acknowledged").alias("status"), F.coalesce("own", "other").alias("assignee_id"),
        "event_count", "merged_count", "first_event_at", "last_event_at",
    )


def latest_per_key(rows: DataFrame, key: str, *order: Column) -> DataFrame:
    """The first row of each key in the given order."""
    return rows.withColumn("rn", F.row_number().over(Window.partitionBy(key).orderBy(*order))).filter("rn = 1").drop("rn")


def upserted(alerts: DataFrame, hits: DataFrame, now: str, window_minutes: int, suppress_minutes: int = 0) -> tuple[DataFrame, DataFrame]:
    """Alerts after a detection run, and the new ones among them.

    hits: rule_id, rule_name, group_key, severity, n, first_at, last_at. A hit joins the newest alert of its
    rule and group that isn't closed and had an event within twice the window: its count becomes the larger
    one. Others become new alerts unless one of the same rule and group was made within suppress_minutes.
    """
    at = F.lit(now).cast("timestamp")
    open_ones = alerts.filter((F.col("status") != "closed") & (F.col("last_event_at") >= at - F.make_dt_interval(F.lit(0), F.lit(0), F.lit(2 * window_minutes))))
    key = F.struct("rule_id", "group_key")
    open_ones = latest_per_key(open_ones.withColumn("key", key), "key", F.desc("created_at"), F.desc("id")).select("key", F.col("id").alias("open_id"))
    found = hits.withColumn("key", key).join(open_ones, "key", "left")
    merged = found.filter(F.col("open_id").isNotNull()).select(F.col("open_id").alias("id"), F.col("n").alias("hit_n"), F.col("last_at").alias("hit_last"))
    fresh = found.filter(F.col("open_id").isNull())
    if suppress_minutes:
        recent = alerts.filter(F.col("created_at") > at - F.make_dt_interval(F.lit(0), F.lit(0), F.lit(suppress_minutes))).select(key.alias("key")).distinct()
        fresh = fresh.join(recent, "key", "left_anti")
    after = alerts.join(merged, "id", "left").withColumns(
        {"event_count": F.greatest("event_count", F.coalesce("hit_n", "event_count")), "last_event_at": F.greatest("last_event_at", F.coalesce("hit_last", "last_event_at"))}
    )
    new = fresh.select(
        F.sha2(F.concat_ws("|", "rule_id", "group_key", F.lit(now)), 256).alias("id"), "rule_id", "rule_name", "group_key", "severity", F.lit("open").alias("status"),
        F.col("n").alias("event_count"), F.col("first_at").alias("first_event_at"), F.col("last_at").alias("last_event_at"), at.alias("created_at"),
    )
    return after.drop("hit_n", "hit_last").unionByName(new, allowMissingColumns=True), new


def severity_summary(alerts: DataFrame) -> DataFrame:
    """Count of each severity, zero where there is none."""
    spine = alerts.sparkSession.range(1).select(F.explode(F.array(*[F.lit(s) for s in SEVERITIES])).alias("severity"))
    return spine.join(alerts.groupBy("severity").agg(F.count(F.lit(1)).alias("n")), "severity", "left").select("severity", F.coalesce("n", F.lit(0)).alias("n"))


def severity_buckets(alerts: DataFrame) -> DataFrame:
    """Counts by severity; any that isn't one of them counts as unknown."""
    known = F.when(F.col("severity").isin(*SEVERITIES), F.col("severity")).otherwise("unknown")
    return alerts.groupBy(known.alias("severity")).agg(F.count(F.lit(1)).alias("n"))


def mine(alerts: DataFrame, assignee: str) -> DataFrame:
    """Counts of one's alerts by severity and status, and the oldest open one."""
    own = alerts.filter(F.col("assignee_id") == assignee)
    return own.groupBy("severity", "status").agg(F.count(F.lit(1)).alias("n"), F.min(F.when(F.col("status") == "open", F.col("created_at"))).alias("oldest_open"))


def ranked_by_severity(alerts: DataFrame) -> DataFrame:
    return alerts.orderBy(severity_rank(F.col("severity")), F.desc("last_event_at"), "id")


def top_list(rows: DataFrame, key: Column, most: int = 10) -> DataFrame:
    """Most frequent keys; rows without one are left out."""
    found = rows.select(key.alias("key")).filter(F.col("key").isNotNull() & (F.col("key") != ""))
    return found.groupBy("key").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "key").limit(most)


def by_machine_and_severity(rows: DataFrame, machine: str, severity: str, severities: list[str]) -> DataFrame:
    return rows.groupBy(machine).pivot(severity, severities).agg(F.count(F.lit(1))).na.fill(0, severities)


def unassigned(alerts: DataFrame, case_alerts: DataFrame) -> DataFrame:
    """Alerts in no case."""
    return alerts.join(case_alerts.select(F.col("alert_id").alias("id")), "id", "left_anti")


def cases_with_counts(cases: DataFrame, case_alerts: DataFrame, users: DataFrame) -> DataFrame:
    n = case_alerts.groupBy("case_id").agg(F.count(F.lit(1)).alias("n_alerts"))
    owners = users.select(F.col("user_id").alias("owner_id"), F.col("name").alias("owner"))
    return cases.join(n, "case_id", "left").join(owners, "owner_id", "left").withColumn("n_alerts", F.coalesce("n_alerts", F.lit(0)))


#: Rows of a page of cases at most.
MOST_CASES = 200


def cases_page(cases: DataFrame, case_alerts: DataFrame, users: DataFrame, status: str = "active", owner: str | int | None = None, unowned: bool = False, limit: int = 50, offset: int = 0) -> tuple[DataFrame, DataFrame]:
    """A page of cases with their owners and numbers of alerts, latest update first, and one row with the total of all pages.

    status: `active` (open or under investigation), `all`, or one status. Alerts are counted for the cases of the page only.
    """
    found = cases.filter(F.col("status").isin("open", "investigating")) if status == "active" else cases if status == "all" else cases.filter(F.col("status") == status)
    if unowned:
        found = found.filter(F.col("owner_id").isNull())
    elif owner is not None:
        found = found.filter(F.col("owner_id") == F.lit(owner))
    page = found.orderBy(F.desc("updated_at"), F.desc("case_number")).offset(offset).limit(min(limit, MOST_CASES))
    mine = case_alerts.join(F.broadcast(page.select("case_id")), "case_id", "left_semi")  # at most MOST_CASES rows
    return cases_with_counts(page, mine, users).orderBy(F.desc("updated_at"), F.desc("case_number")), found.agg(F.count(F.lit(1)).alias("total"))


def to_notify(channels: DataFrame, alerts: DataFrame, sent: DataFrame) -> DataFrame:
    """Channel and alert pairs still to be sent: same tenant, at least as severe, not older than the channel, and its text filter fits.

    An equal join: a channel is a row for each severity that it wants and each month from its creation to the newest alert's, so
    that an alert meets only the channels that want it (but for those created within its month), and a tenant with many
    alerts is divided by severity and month.
    """
    month = lambda c: F.trunc(c, "month")
    newest = alerts.agg(F.max("created_at")).first()[0]
    c = channels.select("channel_id", "tenant_id", F.col("created_at").alias("since"), F.lower("name_filter").alias("part"), "min_severity").filter(F.col("since") <= F.lit(newest))
    c = c.withColumn("rank", F.explode(F.sequence(F.lit(0), severity_rank(F.col("min_severity"))))).withColumn("month", F.explode(F.sequence(month("since"), month(F.lit(newest)), F.expr("interval 1 month"))))
    a = alerts.select(F.col("id").alias("alert_id"), "tenant_id", severity_rank(F.col("severity")).alias("rank"), month("created_at").alias("month"), "created_at", F.lower("rule_name").alias("name"))
    pairs = a.join(c.drop("min_severity"), ["tenant_id", "rank", "month"]).filter((F.col("created_at") >= F.col("since")) & (F.col("part").isNull() | F.contains("name", "part")))
    return pairs.select("channel_id", "alert_id").join(sent.select("channel_id", "alert_id"), ["channel_id", "alert_id"], "left_anti")


#: Techniques and tactics of an alert at most.
MOST_TECHNIQUES, MOST_TACTICS = 20, 14


def _first_seen(samples: DataFrame, column: str, most: int) -> DataFrame:
    """Per alert_id, the distinct values of a comma-separated column in order of first sight; of each alert only the first `most` are gathered."""
    each = samples.select("alert_id", "pos", F.posexplode(F.split(column, r"\s*,\s*")).alias("at", "value")).filter(F.col("value") != "")
    first = each.groupBy("alert_id", "value").agg(F.min(F.struct("pos", "at")).alias("place"))
    rank = F.row_number().over(Window.partitionBy("alert_id").orderBy("place", "value"))
    some = first.withColumn("rank", rank).filter(F.col("rank") <= most)
    return some.groupBy("alert_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "value"))), lambda t: t["value"]).alias(column))


def technique_union(alerts: DataFrame, samples: DataFrame, most: int = MOST_TECHNIQUES) -> DataFrame:
    """Alerts with the techniques, and where samples have such a column the tactics, of their sample events in order of first sight (samples: alert_id, pos, techniques[, tactics])."""
    for column, limit in (("techniques", most), ("tactics", MOST_TACTICS)):
        if column in samples.columns:
            alerts = alerts.join(_first_seen(samples, column, limit).withColumnRenamed("alert_id", "id"), "id", "left")
    return alerts


def with_technique(alerts: DataFrame, prefix: str) -> DataFrame:
    return alerts.filter(F.exists("techniques", lambda t: F.upper(t).startswith(prefix.upper())))


def inspected(ids: DataFrame, alerts: DataFrame, case_alerts: DataFrame, cases: DataFrame, case_id: str | int | None = None) -> DataFrame:
    """For each asked id (column id): `missing`, `free`, `mine` (in the given case) or `taken`, and the case that has the alert."""
    of_case = case_alerts.select(F.col("alert_id").alias("c_alert"), F.col("case_id")).join(cases.select("case_id", "case_number"), "case_id", "left")
    found = ids.select("id").distinct().join(alerts.select(F.col("id").alias("a_id"), "severity"), F.col("id") == F.col("a_id"), "left")
    found = found.join(of_case, F.col("a_id") == F.col("c_alert"), "left")
    own = F.lit(False) if case_id is None else F.coalesce(F.col("case_id") == F.lit(case_id), F.lit(False))
    state = F.when(F.col("a_id").isNull(), "missing").when(F.col("case_id").isNull(), "free").when(own, "mine").otherwise("taken")
    return found.select("id", "severity", state.alias("state"), "case_id", "case_number")


def rules_with_open(rules: DataFrame, alerts: DataFrame) -> DataFrame:
    """Rules (rule_id, name, severity and others) with their alerts that aren't closed, worst severity first, then by name."""
    n = alerts.filter(F.col("status") != "closed").groupBy("rule_id").agg(F.count(F.lit(1)).alias("open_alerts"))
    found = rules.join(n, "rule_id", "left").withColumn("open_alerts", F.coalesce("open_alerts", F.lit(0)))
    return found.orderBy(F.least(severity_rank(F.col("severity")), F.lit(len(SEVERITIES) - 1)), "name")


def recovered(alerts: DataFrame, deliveries: DataFrame, channels: DataFrame, noted: DataFrame, already: DataFrame, now: str, manual_hours: int | None = None) -> DataFrame:
    """Channel and alert pairs that are to hear that an alert is over.

    Alerts closed within a day that no rule made and that aren't merged, whose message was sent to a channel that is on and wants
    to know; closed by the platform (noted: alert_id) or, with manual_hours, by a person within so many hours. Channels switched
    on later hear only of alerts closed after that; pairs in `already` are left out.
    """
    at = F.lit(now).cast("timestamp")
    hours = lambda n: at - F.make_dt_interval(F.lit(0), F.lit(n))
    closed = alerts.filter((F.col("status") == "closed") & F.col("rule_id").isNull() & F.col("merged_into_id").isNull() & (F.col("updated_at") > hours(24)))
    closed = closed.select(F.col("id").alias("alert_id"), "updated_at").join(noted.select("alert_id").distinct().withColumn("noted", F.lit(True)), "alert_id", "left")
    by_hand = F.lit(False) if manual_hours is None else F.col("updated_at") > hours(manual_hours)
    closed = closed.filter(F.col("noted").isNotNull() | by_hand).select("alert_id", "updated_at")
    sent = deliveries.filter(F.col("status") == "sent").select("channel_id", "alert_id").distinct()
    on = channels.filter(F.col("enabled") & F.col("notify_recovered")).select("channel_id", F.col("notify_recovered_at").alias("since"))
    pairs = closed.join(sent, "alert_id").join(on, "channel_id").filter(F.col("since").isNull() | (F.col("updated_at") >= F.col("since")))
    return pairs.select("channel_id", "alert_id").join(already.select("channel_id", "alert_id"), ["channel_id", "alert_id"], "left_anti")


def unparsed_plan(reasons: DataFrame, active: DataFrame, latest: DataFrame, threshold: int, cooldown_minutes: int = 60) -> DataFrame:
    """What the watch over unparsed events does: one row to raise an alert, or a row for each to close.

    reasons: reason, n in the window; active: id of open or acknowledged alerts; latest: at most one row of status, closed_by and age_s.
    Raised at the threshold if none is active, but not within the cool-down of one that a person closed; a threshold of 0 turns the watch off.
    """
    by_hand = (F.col("status") == "closed") & ~F.coalesce(F.col("closed_by") == PLATFORM, F.lit(False))
    rows = reasons.agg(F.lit("reasons").alias("kind"), F.lit(None).cast("string").alias("id"), F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("n"), F.lit(False).alias("cooling"))
    cooling = F.coalesce(F.max(by_hand & (F.col("age_s") < cooldown_minutes * 60)), F.lit(False))
    rows = rows.unionByName(latest.agg(F.lit("raise").alias("kind"), F.lit(None).cast("string").alias("id"), F.lit(0).cast("long").alias("n"), cooling.alias("cooling")))
    rows = rows.unionByName(active.select(F.lit("close").alias("kind"), F.col("id").cast("string").alias("id"), F.lit(0).cast("long").alias("n"), F.lit(False).alias("cooling")))
    every = Window.partitionBy(F.lit(1))  # a row for the counts, one for the cool-down, and one for each active alert
    rows = rows.withColumns({"total": F.sum("n").over(every), "quiet": F.max("cooling").over(every), "n_active": F.count_if(F.col("kind") == "close").over(every)})
    over = F.lit(threshold > 0) & (F.col("total") >= threshold)
    wanted = F.when(F.col("kind") == "close", ~over).when(F.col("kind") == "raise", over & ~F.col("quiet") & (F.col("n_active") == 0)).otherwise(False)
    return rows.filter(wanted).select(F.col("kind").alias("action"), "id", "total")
