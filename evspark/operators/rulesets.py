"""Rule sets over events as Column expressions: parsing (first match wins), data model (all add up), drop policies, detection packs."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import predicates as P
from ..functions.fields import event_time
from ..functions.rules import nest
from .match import MOST_GROUPS, by_capture, by_field, match_groups

#: Keys of a document, and code points of a value, that rules may leave at most.
MOST_KEYS, MOST_CHARS = 200, 8192
#: Conditions of a detection at most: ten filters beside a text, a source type and an expression.
MOST_CONDITIONS = 13


@dataclass(frozen=True)
class Rule:
    """Where `when` holds, set fields (a dotted name nests), and remove document keys by pattern (`*` for anything).

    With `keep` only the keys that fit one of its patterns stay, of those that the document had and those that are set.
    """

    name: str
    when: Column
    fields: dict[str, Column]
    remove: tuple[str, ...] = ()
    source_type: str | None = None
    keep: tuple[str, ...] = ()

    def applies(self) -> Column:
        own = F.lit(True) if self.source_type is None else F.lower("source_type") == self.source_type.lower()
        return F.coalesce(own & self.when, F.lit(False))


def _fits(key: Column, globs: Sequence[str]) -> Column:
    patterns = ["^" + "".join(".*" if c == "*" else f"\\Q{c}\\E" for c in g) + "$" for g in globs]
    return reduce(lambda a, b: a | b, [key.rlike(p) for p in patterns], F.lit(False))


def merged(document: Column, fields: dict[str, Column], remove: Sequence[str] = (), keep: Sequence[str] = ()) -> Column:
    """The JSON document with these fields set; values that are not touched keep their types."""
    as_map = lambda c: F.from_json(c, "map<string,variant>")
    new = as_map(nest({k: F.left(v, F.lit(MOST_CHARS)) for k, v in fields.items()}))
    old = F.map_filter(as_map(document), lambda k, v: ~_fits(k, remove) & ~F.map_contains_key(new, k))
    all_keys = F.map_concat(old, new)
    return F.to_json(F.map_filter(all_keys, lambda k, v: _fits(k, keep)) if keep else all_keys)


def altered(events: DataFrame, *sets: dict[str, Column]) -> DataFrame:
    """Columns set stage by stage, so that later ones see what earlier ones made."""
    for fields in sets:
        events = events.withColumns(fields)
    return events


def parsed_or_kept(events: DataFrame, rules: Sequence[Rule], error: str = "PARSE_ERROR") -> DataFrame:
    """As `parsed`, but a row whose document can't be read keeps it as text under `_unparsed`, with `_parse_error`, instead of failing the batch."""
    broken = F.try_parse_json(F.col("parsed")).isNull() & F.col("parsed").isNotNull()
    kept = F.to_json(F.struct(F.lit(error).alias("_parse_error"), F.col("parsed").alias("_unparsed")))
    marked = events.withColumns({"_kept": F.when(broken, kept), "parsed": F.when(broken, F.lit("{}")).otherwise(F.col("parsed"))})
    done = parsed(marked, rules)
    return done.withColumns({"parsed": F.coalesce("_kept", "parsed"), "rule": F.when(F.col("_kept").isNull(), F.col("rule"))}).drop("_kept")


def parsed(events: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """events with `parsed` as the first rule that applies leaves it, and `rule`, its name (null: none did)."""
    if not rules:
        return events.withColumn("rule", F.lit(None).cast("string"))
    which = reduce(lambda c, r: c.when(r.applies(), F.lit(r.name)), rules[1:], F.when(rules[0].applies(), F.lit(rules[0].name)))
    events = events.withColumn("rule", which)
    document = reduce(
        lambda c, r: c.when(F.col("rule") == r.name, merged(F.col("parsed"), r.fields, r.remove, r.keep)), rules[1:], F.when(F.col("rule") == rules[0].name, merged(F.col("parsed"), rules[0].fields, rules[0].remove, rules[0].keep))
    )
    return events.withColumn("parsed", document.otherwise(F.col("parsed")))


def modelled(events: DataFrame, rules: Sequence[Rule], under: str = "xdm") -> DataFrame:
    """events with `under` in the document made by all rules that apply; of a name, the last one's value holds, and an empty one removes it."""
    names = list(dict.fromkeys(n for r in rules for n in r.fields))
    values: dict[str, Column] = {}
    for n in names:
        own = [r for r in rules if n in r.fields][::-1]
        chain = reduce(lambda c, r: c.when(r.applies(), r.fields[n]), own[1:], F.when(own[0].applies(), own[0].fields[n]))
        values[f"{under}.{n}"] = F.nullif(chain, F.lit(""))
    return events.withColumn("parsed", merged(F.col("parsed"), values)) if values else events


@dataclass(frozen=True)
class DropRule:
    """Of a channel (whatever its case): event ids within ranges, and a case-sensitive pattern in a field or in raw; what happens then."""

    channel: str | None = None
    ids: tuple[tuple[int, int], ...] = ()
    pattern: str | None = None
    in_field: str | None = None
    action: str = "drop"


def kept_by_policy(events: DataFrame, rules: Sequence[DropRule], channel: Column, event_id: Column, channels: dict[str, str] | None = None, default: str = "keep", erase: Sequence[str] = ()) -> DataFrame:
    """Events that the first matching rule, else their channel's default, else the policy's, keeps; `erase` patterns are cut out of raw, in order."""

    def holds(r: DropRule) -> Column:
        c = F.lit(True) if r.channel is None else F.lower(channel) == r.channel.lower()
        if r.ids:
            c &= reduce(lambda a, b: a | b, [event_id.between(lo, hi) for lo, hi in r.ids])
        if r.pattern:
            c &= (F.col("raw") if r.in_field is None else P.field(r.in_field)).rlike(r.pattern)
        return F.coalesce(c, F.lit(False))

    action = F.lit(default)
    for name, what in (channels or {}).items():
        action = F.when(F.lower(channel) == name.lower(), F.lit(what)).otherwise(action)
    for r in reversed(rules):
        action = F.when(holds(r), F.lit(r.action)).otherwise(action)
    raw = reduce(lambda c, p: F.regexp_replace(c, p, ""), erase, F.col("raw"))
    return events.filter(action == "keep").withColumn("raw", raw)


@dataclass(frozen=True)
class Detection:
    """A threshold rule: conditions made when it runs, a group (`none`, `field:x` or a pattern), and how often in which window."""

    name: str
    severity: str
    conditions: Callable[[], list[Column]]
    group: str = "none"
    threshold: int = 1
    window_minutes: int = 60
    techniques: tuple[str, ...] = field(default=())
    run_every_minutes: int = 1
    suppress_minutes: int | None = None

    def __post_init__(self):
        for name, most in (("threshold", 100_000), ("window_minutes", 10_080), ("run_every_minutes", 1440)):
            if not 1 <= getattr(self, name) <= most:
                raise ValueError(f"{name} is 1 to {most}")
        if self.suppress_minutes is not None and not 1 <= self.suppress_minutes <= 10_080:
            raise ValueError("suppress_minutes is 1 to 10080")


def conditions_of(rule: Detection) -> list[Column]:
    made = rule.conditions()
    if len(made) > MOST_CONDITIONS:
        raise ValueError(f"{rule.name} has more than {MOST_CONDITIONS} conditions")
    return made


def group_of(rule: Detection) -> Column:
    if rule.group == "none":
        return F.lit("all")
    return by_field(rule.group.removeprefix("field:")) if rule.group.startswith("field:") else by_capture(rule.group)


def hits(events: DataFrame, rule: Detection, now: str) -> DataFrame:
    """rule_id, rule_name, group_key, severity, n, first_at and last_at of the groups that reach the threshold in the window before now."""
    since = F.lit(now).cast("timestamp") - F.make_dt_interval(F.lit(0), F.lit(0), F.lit(rule.window_minutes))
    found = match_groups(events.filter(event_time() > since), *conditions_of(rule), group=group_of(rule), threshold=rule.threshold, limit=MOST_GROUPS)
    return found.select(F.lit(rule.name).alias("rule_id"), F.lit(rule.name).alias("rule_name"), "group_key", F.lit(rule.severity).alias("severity"), "n", "first_at", "last_at", "sample_ids", "sample_raw")


#: A small pack for Linux hosts, to start from.
LINUX_PACK = (
    Detection("many failed logins", "high", lambda: [P.contains("_raw", "failed password")], r"from (\S+)", 5, 10, ("T1110",)),
    Detection("login as root", "medium", lambda: [P.matches("_raw", r"accepted \w+ for root\b")], "field:host", 1, 60, ("T1078",)),
    Detection("new account", "medium", lambda: [P.contains("_raw", "new user: name=")], "field:host", 1, 60, ("T1136",)),
    Detection("sudo refused", "medium", lambda: [P.matches("_raw", r"sudo.*(not in sudoers|incorrect password)")], r"sudo:\s+(\S+)", 3, 30, ("T1548",)),
    Detection("log was cleared", "critical", lambda: [P.matches("_raw", r"(rm|truncate|>)\s.*\/var\/log\/")], "field:host", 1, 60, ("T1070",)),
)
