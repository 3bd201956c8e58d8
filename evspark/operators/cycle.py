"""All rules in one cycle: the events are read once, and the hits of every rule become changes of alerts.

Each event gets an array of the rules that it fits, with its group for each of them; the array is exploded once into
pairs, which are written, since counts and samples both read them. What a rule has besides its conditions (threshold,
window, suppression) comes from a small table beside the pairs, so that the plan doesn't grow with it.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.fields import event_time
from ..functions.lineage import cut_lineage
from ..functions.sizes import if_small
from .match import MOST_GROUPS, SAMPLES
from .rulesets import Detection, conditions_of, group_of

#: Code points of an event's text that are kept for an alert.
SAMPLE_CHARS = 500
#: Bound of the table of rules that is broadcast.
MOST_RULES = 10_000
PAIR = "rule_id string, group_key string, at timestamp, id string, raw string"


def minutes(n: Column | int) -> Column:
    return F.make_dt_interval(F.lit(0), F.lit(0), F.lit(n) if isinstance(n, int) else n)


def settings(spark: SparkSession, rules: Sequence[Detection]) -> DataFrame:
    """rule_id, rule_name, severity, threshold, window_minutes and suppress_minutes (0: none) of each rule."""
    if len({r.name for r in rules}) < len(rules) or len(rules) > MOST_RULES:
        raise ValueError(f"rules need names of their own, and are {MOST_RULES} at most")
    rows = [(r.name, r.name, r.severity, r.threshold, r.window_minutes, r.suppress_minutes or 0) for r in rules]
    return F.broadcast(spark.createDataFrame(rows, "rule_id string, rule_name string, severity string, threshold int, window_minutes int, suppress_minutes int"))


def _pairs(events: DataFrame, rules: Sequence[Detection], now: str | None = None) -> tuple[DataFrame, Column]:
    """The events that may fit a rule, and an array of rule_id and group_key of each that they fit, in the order of the rules."""
    at = event_time()

    def pair(rule: Detection) -> Column:
        # The window first, since it costs least: of an event that isn't in it nothing else is looked at.
        inside = F.lit(True) if now is None else at > F.lit(now).cast("timestamp") - minutes(rule.window_minutes)
        holds = reduce(lambda a, b: a & b, conditions_of(rule), inside)
        return F.when(holds, F.struct(F.lit(rule.name).alias("rule_id"), group_of(rule).alias("group_key")))

    pairs = F.filter(F.array(*[pair(r) for r in rules]), lambda p: p.isNotNull())
    if now is not None:  # older events fit no rule
        events = events.filter(at > F.lit(now).cast("timestamp") - minutes(max(r.window_minutes for r in rules)))
    return events, pairs


def fitting(events: DataFrame, rules: Sequence[Detection]) -> DataFrame:
    """at, id, raw and pairs: a row for each event that fits a rule, with the rule_id and group_key of each that it fits."""
    events, pairs = _pairs(events, rules)
    # A generator makes the pairs once; a filter on them would make them again.
    made = F.filter(F.array(pairs), lambda p: F.size(p) > 0)
    return events.select(event_time().alias("at"), "id", F.left("raw", F.lit(SAMPLE_CHARS)).alias("raw"), F.explode(made).alias("pairs"))


def matched(events: DataFrame, rules: Sequence[Detection], now: str | None = None) -> DataFrame:
    """rule_id, group_key, at, id and raw: a row for each event and rule that it fits, of all times or in the rules' windows before now.

    Works on streams too. A condition that is null doesn't hold.
    """
    if not rules:
        return events.sparkSession.createDataFrame([], PAIR)
    events, pairs = _pairs(events, rules, now)
    each = events.select(event_time().alias("at"), "id", F.left("raw", F.lit(SAMPLE_CHARS)).alias("raw"), F.explode(pairs).alias("pair"))
    return each.select("pair.rule_id", "pair.group_key", "at", "id", "raw")


def over_threshold(counts: DataFrame, rules: DataFrame, limit: int = MOST_GROUPS) -> DataFrame:
    """counts (rule_id, group_key, n and others) of the groups that reach their rule's threshold, the most frequent `limit` of each rule."""
    rank = F.row_number().over(Window.partitionBy("rule_id").orderBy(F.desc("n"), "group_key"))
    found = counts.join(rules, "rule_id").filter(F.col("n") >= F.col("threshold"))
    return found.withColumn("place", rank).filter(F.col("place") <= limit).drop("place", "threshold")


def newest(pairs: DataFrame, most: int = SAMPLES) -> DataFrame:
    """rule_id, group_key and sample_ids: the newest events of each group, by rank."""
    rank = F.row_number().over(Window.partitionBy("rule_id", "group_key").orderBy(F.desc("at"), F.desc("id")))
    some = pairs.select("rule_id", "group_key", "at", "id").withColumn("rank", rank).filter(F.col("rank") <= most)
    return some.groupBy("rule_id", "group_key").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "id"))), lambda s: s["id"]).alias("sample_ids"))


def hits(events: DataFrame, rules: Sequence[Detection], now: str, limit: int = MOST_GROUPS) -> DataFrame:
    """What `rulesets.hits` gives for each rule, for all of them: rule_id, rule_name, group_key, severity, n, first_at, last_at, sample_ids and sample_raw, window_minutes and suppress_minutes.

    Events of the rules' windows are dealt by id before they meet the rules: stored in order of time, they lie in few parts of a table.
    """
    pairs = cut_lineage(matched(events.repartition("id"), rules, now))
    counts = pairs.groupBy("rule_id", "group_key").agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("first_at"), F.max("at").alias("last_at"), F.max(F.struct("at", "id", "raw")).alias("newest"))
    found = cut_lineage(over_threshold(counts, settings(events.sparkSession, rules), limit).withColumn("sample_raw", F.col("newest.raw")).drop("newest"))
    # Keys that are broadcast leave the pairs where they are, so that only the newest of each task are shuffled.
    samples = newest(pairs.join(if_small(found.select("rule_id", "group_key")), ["rule_id", "group_key"], "left_semi"))
    return found.join(samples, ["rule_id", "group_key"])


def changes(alerts: DataFrame, hits: DataFrame, now: str) -> DataFrame:
    """What a cycle's hits do: rows of the alerts as they are after it, with `change`: created, updated or suppressed.

    A hit updates the alert of its rule and group that isn't closed and has the latest event, if that is later than twice
    the rule's window ago: the larger count holds, and the hit's last event. Else it creates one, unless the rule is
    suppressed and an alert of the same rule and group was created within so many minutes; such a row has no id. Alerts that no
    hit meets are not among the rows.
    """
    at = F.lit(now).cast("timestamp")
    alert = F.struct(*alerts.columns)
    mine = alerts.select(F.col("rule_id").alias("a_rule"), F.col("group_key").alias("a_group"), alert.alias("alert"))
    found = hits.join(mine, (F.col("rule_id") == F.col("a_rule")) & (F.col("group_key") == F.col("a_group")), "left")
    active = (F.col("alert.status") != "closed") & (F.col("alert.last_event_at") > at - minutes(2 * F.col("window_minutes")))
    place = F.struct("alert.last_event_at", "alert.id")
    key = ["rule_id", "rule_name", "group_key", "severity", "n", "first_at", "last_at", "window_minutes", "suppress_minutes"]
    state = found.groupBy(*key).agg(F.max_by("alert", F.when(active, place)).alias("open"), F.max("alert.created_at").alias("created"))
    quiet = F.coalesce((F.col("suppress_minutes") > 0) & (F.col("created") > at - minutes(F.col("suppress_minutes"))), F.lit(False))
    change = F.when(F.col("open").isNotNull(), "updated").when(quiet, "suppressed").otherwise("created")
    state = state.withColumn("change", change)
    new = {
        "id": F.when(F.col("change") == "created", F.sha2(F.concat_ws("|", "rule_id", "group_key", F.date_format(at, "yyyy-MM-dd HH:mm:ss")), 256)),
        "rule_id": F.col("rule_id"), "rule_name": F.col("rule_name"), "group_key": F.col("group_key"), "severity": F.col("severity"),
        "status": F.lit("open"), "event_count": F.col("n"), "first_event_at": F.col("first_at"), "last_event_at": F.col("last_at"), "created_at": at,
    }
    moved = {"event_count": F.greatest("open.event_count", "n"), "last_event_at": F.col("last_at")}
    none = F.lit(None)
    value = lambda c: F.when(F.col("open").isNotNull(), moved.get(c, F.col(f"open.{c}"))).otherwise(new.get(c, none)).cast(alerts.schema[c].dataType)
    return state.select(*[value(c).alias(c) for c in alerts.columns], "change")


def applied(alerts: DataFrame, changed: DataFrame) -> DataFrame:
    """The alerts after these changes."""
    rows = changed.filter(F.col("id").isNotNull()).select(*alerts.columns)
    return alerts.join(rows.select("id"), "id", "left_anti").select(*alerts.columns).unionByName(rows)
