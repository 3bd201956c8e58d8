"""Merging and suppression of alerts as keyed state of a stream, forgotten when its time is over."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

_TIMES = ["first_event_at", "last_event_at", "created_at", "at"]
#: Times are microseconds in the state, so that no time zone comes in between.
STATE = "id string, rule_name string, severity string, status string, event_count long, first_event_at long, last_event_at long, created_at long"
CHANGE = "rule_id string, group_key string, " + STATE + ", change string, at long"
_NAMES = [f.split()[0] for f in STATE.split(", ")]
_MINUTE = 60_000_000
#: RocksDB holds the state, which grows with the groups that are hit within their rule's times.
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class AlertState(StatefulProcessor):
    """The newest alert of a rule and group: hits update it while it is active, or create the next one unless that is suppressed."""

    def __init__(self, ttl_minutes: int):
        self.ttl_minutes = ttl_minutes

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.alert = handle.getValueState("alert", STATE, self.ttl_minutes * 60_000)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        held = dict(zip(_NAMES, self.alert.get(), strict=True)) if self.alert.exists() else None
        for r in sorted(rows, key=lambda r: (r.at, r.kind)):
            if r.kind == "close":
                if held is None or held["status"] == "closed":
                    continue
                shown = held = held | {"status": "closed"}
                change = "closed"
            elif held and held["status"] != "closed" and held["last_event_at"] > r.at - 2 * r.window_minutes * _MINUTE:
                shown = held = held | {"event_count": max(held["event_count"], r.n), "last_event_at": r.last_at}
                change = "updated"
            else:
                quiet = held and r.suppress_minutes and held["created_at"] > r.at - r.suppress_minutes * _MINUTE
                name = None if quiet else hashlib.sha256(f"{key[0]}|{key[1]}|{r.run}".encode()).hexdigest()
                shown = dict(zip(_NAMES, (name, r.rule_name, r.severity, "open", r.n, r.first_at, r.last_at, r.at), strict=True))
                change = "suppressed" if quiet else "created"
                held = held if quiet else shown
            yield Row(rule_id=key[0], group_key=key[1], **shown, change=change, at=r.at)
        if held:
            self.alert.update(tuple(held[n] for n in _NAMES))

    def close(self) -> None:
        pass


def alert_changes(hits: DataFrame, ttl_minutes: int) -> DataFrame:
    """Changes of alerts from a stream of hits and closings: the alert as it is after it, change (created, updated, suppressed, closed) and at.

    hits: kind (`hit` or `close`), at (when the cycle ran or a person closed), rule_id, group_key, and for hits rule_name, severity, n,
    first_at, last_at, window_minutes and suppress_minutes. A batch's rows of a group are taken in order of time. The state of a group
    goes ttl_minutes after its last change: to be longer than twice the longest window and than the longest suppression. The session's
    state store has to be PROVIDER, and with a trigger that ends, like availableNow, spark.sql.streaming.noDataMicroBatches.enabled
    has to be false: state with time-outs asks for empty batches without end.
    """
    rows = hits.withColumn("run", F.date_format("at", "yyyy-MM-dd HH:mm:ss")).withColumns({c: F.unix_micros(c) for c in ("at", "first_at", "last_at")})
    found = rows.groupBy("rule_id", "group_key").transformWithState(AlertState(ttl_minutes), CHANGE, "append", "processingTime")
    return found.withColumns({c: F.timestamp_micros(c) for c in _TIMES})
