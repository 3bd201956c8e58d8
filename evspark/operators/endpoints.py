"""Endpoint alerts: the list's filter, and how many alerts each machine has."""

from __future__ import annotations

import re
from dataclasses import dataclass
from datetime import datetime, timedelta
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import predicates as P
from .search import Search

# Levels of each severity, results of checks as they are asked for and stored, and windows in minutes.
LEVELS = {"low": (0, 4), "medium": (5, 7), "high": (8, 11), "critical": (12, 15)}
CHECK_RESULTS = {"passed": "passed", "failed": "failed", "not_applicable": "not applicable"}
WINDOW_MINUTES = {"1h": 60, "24h": 1440, "7d": 10_080, "30d": 43_200}
FILE_EVENTS = ("added", "modified", "deleted")
MOST_MACHINES, MOST_NAME = 5000, 200
#: Bounds of what the list can be asked for: code points of a text, ids to leave out, rows of a page, rows before it.
MOST_TEXT, MOST_EXCLUDED, MOST_ROWS, MOST_OFFSET = 200, 20, 100, 900
_ID, _TECHNIQUE, _LINE = r"[0-9]{1,10}", r"T[0-9]{4}(?:\.[0-9]{3})?", r"[^\x00-\x1f\x7f]+"


@dataclass(frozen=True)
class AlertFilter:
    """What the list of endpoint alerts is asked for; all that is given has to hold."""

    severity: str | None = None
    agent: str | None = None
    rule: str | None = None
    exclude: tuple[str, ...] = ()
    technique: str | None = None
    text: str | None = None
    kind: str | None = None
    file_event: str | None = None
    check_result: str | None = None
    policy: str | None = None

    def __post_init__(self):
        for value, known in ((self.severity, LEVELS), (self.check_result, CHECK_RESULTS), (self.kind, ("file_integrity", "configuration")), (self.file_event, FILE_EVENTS)):
            if value is not None and value not in known:
                raise ValueError(f"{value!r} is none of {', '.join(known)}")
        forms = [(self.rule, _ID), *((x, _ID) for x in self.exclude), (self.technique, _TECHNIQUE), *((x, _LINE) for x in (self.agent, self.text, self.policy))]
        for value, form in forms:
            if value is not None and (len(value) > MOST_TEXT or not re.fullmatch(form, value)):
                raise ValueError(f"{value[:40]!r} is not of the form asked for")
        if len(self.exclude) > MOST_EXCLUDED:
            raise ValueError(f"at most {MOST_EXCLUDED} rules can be left out")

    def conditions(self, with_severity: bool = True) -> list[Column]:
        """Without severity for the summary, whose counts by severity are a breakdown of the rest."""
        made = []
        if with_severity and self.severity:
            lo, hi = LEVELS[self.severity]
            made += [P.at_least("@alert_level", lo), P.at_most("@alert_level", hi)]
        for name, value in (("@agent_name", self.agent), ("@rule_id", self.rule), ("@file_event", self.file_event), ("@data_sca_policy", self.policy)):
            if value:
                made.append(P.equals(name, value))
        if self.exclude:
            made.append(~P.one_of("@rule_id", list(self.exclude)))
        if self.check_result:
            made.append(P.equals("@data_sca_check_result", CHECK_RESULTS[self.check_result]))
        if self.kind:
            made.append(P.present("@file_path" if self.kind == "file_integrity" else "@data_sca_policy"))
        if self.technique:
            made.append(P.contains("@mitre_ids", self.technique))
        if self.text:
            names = ["@rule_description", "@agent_name", "@user", "@file_path", "@src_ip"] + ["@data_sca_check_title", "@data_sca_policy"] * (self.kind == "configuration")
            made.append(reduce(lambda a, b: a | b, [P.contains(n, self.text) for n in names]))
        return made


#: What a request can name, and the field of the filter that it fills.
PARAMETERS = {"severity": "severity", "agent": "agent", "rule": "rule", "exclude_rule": "exclude", "mitre": "technique", "q": "text", "kind": "kind", "file_event": "file_event", "check_result": "check_result", "policy": "policy"}


@dataclass(frozen=True)
class Asked:
    """A request that was checked: the filter, from when on, and the page."""

    filter: AlertFilter
    start: str
    limit: int = 50
    offset: int = 0


def asked(parameters: dict[str, str], now: str) -> Asked:
    """The request that text parameters make; ValueError for names that are unknown and values that are not allowed. Empty values ask for nothing."""
    page = {"limit": (1, MOST_ROWS), "offset": (0, MOST_OFFSET)}
    if unknown := [k for k in parameters if k not in {*PARAMETERS, *page, "window"}]:
        raise ValueError(f"unknown parameter {unknown[0]!r}")
    given = {PARAMETERS[k]: v for k, v in parameters.items() if k in PARAMETERS and v != ""}
    if "exclude" in given:
        given["exclude"] = tuple(dict.fromkeys(given["exclude"].split(",")))
    window = parameters.get("window", "24h")
    if window not in WINDOW_MINUTES:
        raise ValueError(f"window is one of {', '.join(WINDOW_MINUTES)}")
    numbers = {}
    for name, (least, most) in page.items():
        if name in parameters:
            if not re.fullmatch("[0-9]{1,6}", parameters[name]) or not least <= int(parameters[name]) <= most:
                raise ValueError(f"{name} is a whole number from {least} to {most}")
            numbers[name] = int(parameters[name])
    start = datetime.fromisoformat(now) - timedelta(minutes=WINDOW_MINUTES[window])
    return Asked(AlertFilter(**given), start.isoformat(sep=" "), **numbers)


def page(events: DataFrame, dataset: str, request: Asked, now: str) -> DataFrame:
    """The page of endpoint alerts that a request asks for, newest first."""
    found = listed(events, dataset, request.filter, request.start, now).unlimited().frame()
    return found.offset(request.offset).limit(request.limit)


def listed(events: DataFrame, dataset: str, asked: AlertFilter, start: str, end: str) -> Search:
    """The search for the alerts that are asked for, newest first."""
    return Search(events).where(P.dataset(dataset), *asked.conditions()).between(start, end)


def severities(events: DataFrame, dataset: str, asked: AlertFilter, start: str, end: str) -> DataFrame:
    """alert_severity and n, whatever severity is asked for."""
    found = Search(events).where(P.dataset(dataset), *asked.conditions(with_severity=False)).between(start, end)
    return found.comp("alert_severity", n="count").limit(20).frame()


def by_machine(events: DataFrame, dataset: str, start: str, end: str) -> DataFrame:
    """name and n of the machines with the most alerts, names cut to MOST_NAME code points; alerts without a machine are left out."""
    name = F.left(P.field("@agent_name"), F.lit(MOST_NAME))
    found = Search(events).where(P.dataset(dataset)).between(start, end)
    rows = reduce(DataFrame.filter, found.conditions, events).select(name.alias("name")).filter(F.col("name") != "")
    return rows.groupBy("name").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "name").limit(MOST_MACHINES)
