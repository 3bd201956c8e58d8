"""Watches over collectors and machines, and time series of findings and capacity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.lineage import cut_lineage
from ..functions.sizes import if_small


def _ago(now: str, minutes: Column | int) -> Column:
    m = F.lit(minutes) if isinstance(minutes, int) else minutes
    return F.lit(now).cast("timestamp") - F.make_dt_interval(F.lit(0), F.lit(0), m.cast("int"))


def disconnected(collectors: DataFrame, now: str, default_minutes: int = 15) -> DataFrame:
    """Collectors (name, last_seen, within_minutes) last seen longer ago than allowed."""
    return collectors.filter(F.col("last_seen") < _ago(now, F.coalesce("within_minutes", F.lit(default_minutes))))


def silent(collectors: DataFrame, events: DataFrame, now: str, look_back_days: int = 7, default_minutes: int = 15) -> DataFrame:
    """Collectors that are connected but whose newest event of the look-back is older than silent_minutes, or missing."""
    recent = events.filter(F.col("received_at") >= _ago(now, look_back_days * 1440)).groupBy(F.col("collector_id").alias("name")).agg(F.max("received_at").alias("newest"))
    alive = collectors.filter(F.col("silent_minutes").isNotNull() & (F.col("last_seen") >= _ago(now, default_minutes)))
    return alive.join(recent, "name", "left").filter(F.coalesce(F.col("newest") < _ago(now, F.col("silent_minutes")), F.lit(True)))


def raise_and_close(down: DataFrame, known: DataFrame, open_alerts: DataFrame, most: int = 25) -> DataFrame:
    """What a watch does: `raise` for keys that are down without an open alert (longest first, at most `most`), `close` for open alerts whose key is known and not down.

    down: key, since; known: key; open_alerts: key.
    """
    new = down.join(open_alerts.select("key"), "key", "left_anti").orderBy("since", "key").limit(most)
    raised = new.select("key", F.lit("raise").alias("action"), "since")
    over = open_alerts.select("key").join(known.select("key"), "key", "left_semi").join(down.select("key"), "key", "left_anti")
    return raised.unionByName(over.select("key", F.lit("close").alias("action"), F.lit(None).cast("timestamp").alias("since")))


def newest_per_day(rows: DataFrame, key: str, at: str, *ties: str) -> DataFrame:
    """The last row of each key and day; of equal times the one of the largest `ties`, else of all columns."""
    others = ties or tuple(c for c in rows.columns if c not in (key, at))
    w = Window.partitionBy(key, F.to_date(at)).orderBy(F.desc(at), *[F.desc(c) for c in others])
    return rows.withColumn("rn", F.row_number().over(w)).filter("rn = 1").drop("rn")


def day_over_day(rows: DataFrame, key: str, day: str, value: str) -> DataFrame:
    """Each row with the value of the key's previous row by day, and the change."""
    before = F.lag(value).over(Window.partitionBy(key).orderBy(day))
    return rows.withColumn("previous", before).withColumn("change", F.col(value) - F.col("previous"))


#: Ranges of values for each doubling, in which a percentile is looked for.
RANGES = 64


def p95(rows: DataFrame, value: str, *by: str) -> DataFrame:
    """Nearest-rank 95th percentile, exact.

    Two passes over the rows. The first counts them by ranges of values, some for each doubling, so that what is shuffled are
    partial counts of ranges, however many values there are; running counts tell each group's range and the place in it. The
    second takes the rows of that range only. Nulls are left out, and groups without a value; not-a-number is the largest value.
    """
    v = F.col(value).cast("double")
    # Ranges in the order of their values; a range is the values of a sign with the same whole part of RANGES times the logarithm.
    at = F.floor(F.log2(F.greatest(F.abs(v), F.lit(1e-300))) * RANGES) + 1100 * RANGES
    at = F.when(F.isnan(v), 1 << 40).when(F.abs(v) == float("inf"), F.signum(v) * (1 << 39)).when(v == 0, 0).otherwise(F.signum(v) * at)
    ranged = rows.filter(v.isNotNull()).select(*by, v.alias("_v"), at.cast("long").alias("_r"))
    key = [F.col(c) for c in by]
    of = Window.partitionBy(*key)
    sums = ranged.groupBy(*by, "_r").agg(F.count(F.lit(1)).alias("_n"))
    sums = sums.withColumns({"_upto": F.sum("_n").over(of.orderBy("_r")), "_all": F.sum("_n").over(of)}).withColumn("_place", F.ceil(F.lit(0.95) * F.col("_all")))
    found = sums.filter((F.col("_upto") >= F.col("_place")) & (F.col("_upto") - F.col("_n") < F.col("_place")))  # one range of each group
    found = cut_lineage(found.select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(by)], F.col("_r").alias("_q"), (F.col("_place") - F.col("_upto") + F.col("_n")).alias("_place")))
    same = F.col("_r") == F.col("_q")
    for i, c in enumerate(by):
        same &= F.col(c).eqNullSafe(F.col(f"_k{i}"))
    counts = ranged.join(if_small(found), same).groupBy(*by, "_v").agg(F.count(F.lit(1)).alias("_n"), F.first("_place").alias("_place"))
    return counts.withColumn("_upto", F.sum("_n").over(of.orderBy("_v"))).filter(F.col("_upto") >= F.col("_place")).groupBy(*by).agg(F.min("_v").alias("p95"))


def daily_growth(days: DataFrame, now: str, most: int = 7) -> DataFrame:
    """Mean rows a day of the last complete days (day, n), floored; null with fewer than two."""
    past = days.filter(F.col("day") < F.date_format(F.lit(now).cast("timestamp"), "yyyy-MM-dd")).orderBy(F.desc("day")).limit(most)
    return past.agg(F.when(F.count(F.lit(1)) >= 2, F.floor(F.avg("n")).cast("long")).alias("per_day"))


def per_minute(events: DataFrame, now: str) -> DataFrame:
    """Events a minute over the last five minutes, to a tenth."""
    n = F.count_if((F.col("received_at") > _ago(now, 5)) & (F.col("received_at") <= F.lit(now).cast("timestamp")))
    return events.agg(F.round(n / 5, 1).alias("per_minute"))


def broker_groups(brokers: DataFrame, near: int = 80) -> DataFrame:
    """Per group of brokers (grp, name, max_agents, enrolled): sums over the ones that know both, rounded percent, state, and the broker to use next."""
    knows = F.col("max_agents").isNotNull() & F.col("enrolled").isNotNull()
    free = F.col("max_agents") - F.col("enrolled")
    best = F.min(F.when(knows & (free > 0), F.struct((F.col("enrolled") / F.col("max_agents")).alias("load"), (-free).alias("less"), "name")))
    g = brokers.groupBy("grp").agg(
        F.sum(F.when(knows, F.col("max_agents"))).alias("max_agents"), F.sum(F.when(knows, F.col("enrolled"))).alias("enrolled"), F.count_if(~knows).alias("unknown"), best.alias("best")
    )
    percent = F.round(100 * F.col("enrolled") / F.nullif("max_agents", F.lit(0))).cast("int")
    state = F.when(F.col("enrolled") >= F.col("max_agents"), "full").when(percent >= near, "near").otherwise("ok")
    return g.select("grp", "max_agents", "enrolled", (F.col("max_agents") - F.col("enrolled")).alias("free"), "unknown", percent.alias("percent"), state.alias("state"), F.col("best.name").alias("next"))


def median_limit(brokers: DataFrame) -> DataFrame:
    return brokers.agg(F.floor(F.percentile("max_agents", 0.5)).alias("median_limit"))


def thinned(samples: DataFrame, at: str, points: int = 240) -> DataFrame:
    """The newest sample of each of `points` equal spans of the time that the samples cover."""
    bounds = samples.agg(F.min(at).cast("double").alias("lo"), F.max(at).cast("double").alias("hi")).first()  # one row
    if bounds.lo is None:
        return samples
    lo, hi = F.lit(bounds.lo), F.lit(bounds.hi)
    place = F.least(F.lit(points - 1), F.floor((F.col(at).cast("double") - lo) * points / F.greatest(F.lit(1e-6), hi - lo)))
    row = F.struct(at, *[c for c in samples.columns if c != at])
    spans = samples.groupBy(place.alias("span")).agg(F.max(row).alias("r"))
    return spans.select("r.*").orderBy(at)


def retired(collectors: DataFrame, now: str, days: int = 7) -> DataFrame:
    """One row: all collectors, and those not seen for so many days, or never."""
    return collectors.agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("last_seen").isNull() | (F.col("last_seen") < _ago(now, days * 1440))).alias("retired"))


def with_default_watch(collectors: DataFrame, now: str, disconnect: bool, silent_minutes: int | None, days: int = 7) -> DataFrame:
    """Collectors (watch_disconnect, watch_silent_min, watch_exclude, last_seen) with what they are watched for.

    A collector's own setting wins; else the default holds, unless the collector is excluded or was not seen for so many days.
    """
    covered = ~F.coalesce("watch_exclude", F.lit(False)) & F.coalesce(F.col("last_seen") >= _ago(now, days * 1440), F.lit(False))
    own = F.coalesce("watch_disconnect", F.lit(False))
    watched = own | (F.lit(disconnect) & covered)
    minutes = F.coalesce("watch_silent_min", F.when(covered, F.lit(silent_minutes).cast("int")))
    return collectors.withColumns({"disconnect": watched, "disconnect_by_default": watched & ~own, "silent_minutes": minutes, "silent_by_default": F.col("watch_silent_min").isNull() & minutes.isNotNull()})


def rules_due(rules: DataFrame, now: str) -> DataFrame:
    """Enabled rules (last_run_at, run_every_minutes) whose next run has come, with half a minute of grace."""
    every = F.greatest(F.coalesce("run_every_minutes", F.lit(1)), F.lit(1))
    due = F.col("last_run_at").isNull() | (F.col("last_run_at") <= F.lit(now).cast("timestamp") - F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), (every * 60 - 30).cast("decimal(18,6)")))
    return rules.filter(F.col("enabled") & due)


def rule_health(rules: DataFrame, now: str) -> DataFrame:
    """One row: enabled rules that are behind by more than five of their intervals (ten minutes at least), and those with an error."""
    wait = F.greatest(F.lit(10), 5 * F.coalesce("run_every_minutes", F.lit(1)))
    behind = F.col("enabled") & (F.coalesce("last_run_at", "created_at") < _ago(now, wait))
    return rules.agg(F.count_if(behind).alias("rules_behind"), F.count_if(F.col("enabled") & F.col("last_error").isNotNull()).alias("rules_with_errors"))


def scan_lag(scans: DataFrame, indicators: DataFrame, now: str) -> DataFrame:
    """One row: lag_minutes, how long ago the latest indicator scan (last_run_at) ended; null if none did, or no indicator is enabled."""
    lag = (F.unix_micros(F.lit(now).cast("timestamp")) - F.unix_micros(F.max("last_run_at"))) / 60_000_000
    both = scans.select("last_run_at", F.lit(False).alias("enabled")).unionByName(indicators.select(F.lit(None).cast("timestamp").alias("last_run_at"), "enabled"))
    return both.agg(F.when(F.max("enabled"), lag).alias("lag_minutes"))


def overdue(deliveries: DataFrame, now: str, minutes: int = 10) -> DataFrame:
    """One row: overdue, the pending deliveries whose next attempt should have been that long ago."""
    late = (F.col("status") == "pending") & (F.col("next_attempt_at") < _ago(now, minutes))
    return deliveries.agg(F.count_if(F.coalesce(late, F.lit(False))).alias("overdue"))


# Measures of capacity, from which value on (or below which) they are a warning and critical.
CAPACITY_ABOVE = {"mem_pct": (85, 92), "cpu_pct": (70, 85), "load_per_cpu": (1.5, 3)}
CAPACITY_BELOW = {"disk_free_pct": (20, 10), "days_to_full": (30, 14)}


def capacity_findings(measures: DataFrame) -> DataFrame:
    """host, measure, value and severity of the measures of each host that are beyond their limits, and of hosts without any `ok`."""
    have = [c for c in (*CAPACITY_ABOVE, *CAPACITY_BELOW) if c in measures.columns]
    each = measures.select("host", F.inline(F.array(*[F.struct(F.lit(c).alias("measure"), F.col(c).cast("double").alias("value")) for c in have])))
    severity = F.lit(None).cast("string")
    for c, (warn, critical) in CAPACITY_ABOVE.items():
        severity = F.when((F.col("measure") == c) & (F.col("value") >= critical), "critical").when((F.col("measure") == c) & (F.col("value") >= warn), "warning").otherwise(severity)
    for c, (warn, critical) in CAPACITY_BELOW.items():
        severity = F.when((F.col("measure") == c) & (F.col("value") < critical), "critical").when((F.col("measure") == c) & (F.col("value") < warn), "warning").otherwise(severity)
    rated = each.withColumn("severity", severity)
    found = rated.filter(F.col("severity").isNotNull())
    fine = rated.groupBy("host").agg(F.count("severity").alias("n")).filter(F.col("n") == 0).select("host", F.lit(None).cast("string").alias("measure"), F.lit(None).cast("double").alias("value"), F.lit("ok").alias("severity"))
    return found.unionByName(fine)
