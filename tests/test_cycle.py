"""Forty rules in one scan against forty runs, cycles with merging and suppression, change logs, panes and keyed state of streams."""

import glob
import os
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from evspark.functions import predicates as P
from evspark.operators import cycle, ioc, rulesets
from evspark.operators.rulesets import Detection
from evspark.plans.rules import ALERTS, forty
from evspark.sources.changes import ChangeLog
from evspark.sources.envelope import SCHEMA, stand_in
from evspark.streaming import detect
from evspark.streaming.panes import Panes
from evspark.streaming.state import PROVIDER, alert_changes

SF = "/root/testdata/sf0.001"
COLUMNS = ["rule_id", "rule_name", "group_key", "severity", "n", "first_at", "last_at", "sample_ids", "sample_raw"]
T0 = datetime(2026, 10, 1)


def plain(df, columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


def test_one_scan_equals_a_run_for_each_rule(spark):
    events, now = stand_in(spark, SF), "2024-01-20 00:00:00"
    want = [row for r in forty() for row in plain(rulesets.hits(events, r, now), COLUMNS)]
    assert len(want) > 50 and plain(cycle.hits(events, forty(), now), COLUMNS) == sorted(want, key=repr)


def test_events_are_read_once(spark):
    plan = cycle.matched(stand_in(spark, SF), forty(), "2024-01-20 00:00:00")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and plan.count("Generate") == 1 and "Exchange" not in plan and "Python" not in plan


def test_events_of_the_windows_are_dealt_and_pairs_stay(spark, monkeypatch):
    """Events of one part and time are many tasks' work, older ones aren't shuffled, and of the pairs only the newest of each task are."""
    written, cut = [], cycle.cut_lineage
    monkeypatch.setattr(cycle, "cut_lineage", lambda df: written.append(df._jdf.queryExecution().executedPlan().toString()) or cut(df))
    found = cycle.hits(stand_in(spark, SF).coalesce(1), forty(), "2024-01-20 00:00:00")
    dealt = written[0].index("Exchange hashpartitioning(id")
    assert written[0].index("Generate") < dealt < written[0].index("Filter") and written[0].count("Exchange") == 1
    plan = found._jdf.queryExecution().executedPlan().toString()
    semi = plan.index("LeftSemi")
    assert plan.index("Exchange hashpartitioning(rule_id") < plan.index("Partial", plan.index("WindowGroupLimit")) < semi and "SortMergeJoin" not in plan[plan.rindex("\n", 0, semi) : semi]


def test_rules_without_hits_or_names(spark):
    events = stand_in(spark, SF)
    assert cycle.hits(events, [], "2024-01-20 00:00:00").count() == 0
    assert cycle.hits(events.limit(0), forty(), "2024-01-20 00:00:00").count() == 0
    with pytest.raises(ValueError):
        cycle.hits(events, forty()[:1] * 2, "2024-01-20 00:00:00")
    many = Detection("many", "low", lambda: [F.lit(True)] * 14)
    with pytest.raises(ValueError):
        cycle.hits(events, [many], "2024-01-20 00:00:00")
    with pytest.raises(ValueError):
        rulesets.hits(events, many, "2024-01-20 00:00:00")
    null = Detection("null", "low", lambda: [P.equals("nothing", "x")])  # null is no match
    assert cycle.hits(events, [null], "2024-01-20 00:00:00").count() == 0


HIT = "rule_id string, rule_name string, group_key string, severity string, n long, first_at timestamp, last_at timestamp, window_minutes int, suppress_minutes int"


def hit(spark, minute, group="g", n=5, window=10, quiet=60):
    at = T0 + timedelta(minutes=minute)
    return spark.createDataFrame([("r", "rule", group, "high", n, at - timedelta(minutes=5), at, window, quiet)], HIT)


def test_merge_and_suppression(spark):
    alerts, seen = spark.createDataFrame([], ALERTS), []
    for minute, n in ((0, 5), (15, 9), (30, 3), (51, 4), (61, 4), (70, 2)):  # active for 20 minutes, then quiet for an hour after the first
        now = str(T0 + timedelta(minutes=minute))
        changed = cycle.changes(alerts, hit(spark, minute, n=n), now)
        row = changed.first()
        seen.append((row.change, row.event_count))
        alerts = spark.createDataFrame(cycle.applied(alerts, changed).collect(), ALERTS)
    assert seen == [("created", 5), ("updated", 9), ("updated", 9), ("suppressed", 4), ("created", 4), ("updated", 4)]
    closed = alerts.withColumn("status", F.lit("closed"))
    assert cycle.changes(closed, hit(spark, 71, quiet=0), str(T0 + timedelta(minutes=71))).first().change == "created"
    assert cycle.changes(closed, hit(spark, 71), str(T0 + timedelta(minutes=71))).first().change == "suppressed"
    assert cycle.changes(alerts, hit(spark, 71).limit(0), str(T0)).count() == 0


def test_change_log(spark, tmp_path):
    log = ChangeLog(spark, str(tmp_path / "log"), "id string, g string, v long", ["id", "g"], ["g"], parts=8)
    make = lambda *rows: spark.createDataFrame(rows, "id string, g string, v long")
    assert log.latest().count() == 0 and log.compact() == 0
    log.append(0, make(("a", "x", 1), ("b", "y", 1), ("c", None, 1)))
    log.append(1, make(("a", "x", 2)))
    log.append(2, make(("d", "x", 3)))
    log.append(2, make(("d", "x", 4)))  # the batch comes again
    want = [("a", "x", 2), ("b", "y", 1), ("c", None, 1), ("d", "x", 4)]
    every = lambda df: plain(df, ["id", "g", "v"])
    assert every(log.latest()) == sorted(want, key=repr)
    assert every(log.latest(2)) == sorted(want[:3], key=repr) and every(log.latest(1)) == sorted([("a", "x", 1), *want[1:3]], key=repr)
    assert every(log.latest(among=make(("?", "x", 0)))) == [want[0], want[3]] and every(log.latest(among=make(("?", None, 0)))) == [want[2]]
    # What a batch writes follows its rows.
    assert spark.read.parquet(f"{tmp_path}/log/changes/1").count() == 1
    assert log.compact() > 0 and sorted(os.listdir(tmp_path / "log/changes")) == ["1", "2"]
    assert every(log.latest()) == sorted(want, key=repr) and every(log.latest(2)) == sorted(want[:3], key=repr)
    log.append(3, make(("b", "y", 7)))
    log.append(4, make(("b", "y", 8)))
    log.append(5, make(("e", "z", 1)))
    parts = {p for v in (1, 2, 3) for p in os.listdir(tmp_path / f"log/changes/{v}") if p.startswith("part")}
    assert log.compact() == len(parts)  # others aren't written
    assert every(log.latest()) == sorted([want[0], ("b", "y", 8), *want[2:], ("e", "z", 1)], key=repr)
    assert log.compact(0) > 0 and os.listdir(tmp_path / "log/changes") == []
    assert every(log.latest()) == sorted([want[0], ("b", "y", 8), *want[2:], ("e", "z", 1)], key=repr)
    # A batch that didn't end is not read.
    os.makedirs(tmp_path / "log/changes/9")
    assert log.latest().count() == 5


RULES = [
    Detection("by host", "high", lambda: [P.contains("_raw", "fail")], "field:host", 2, 60, suppress_minutes=30),
    Detection("all", "low", list, "none", 3, 10_080),
    Detection("user", "medium", lambda: [P.matches("_raw", "user=")], r"user=(\w)", 1, 5),
]


def stream_events(n, seed, start=0):
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        at = T0 + timedelta(seconds=rnd.choice([60 * rnd.randrange(600), rnd.randrange(36_000)]))
        rows.append((f"e{start + i}", "a", "syslog", None, at, None, rnd.choice(["fail user=a", "ok user=b", "fail", "x"]), '{"host":"h%d"}' % rnd.randrange(3)))
    return rows


def test_panes_equal_a_full_evaluation(spark, tmp_path):
    """After late and repeated events, batches that come again, and compaction."""
    panes = Panes(spark, str(tmp_path / "p"), RULES)
    batches = [stream_events(40, 1), stream_events(30, 2, 40)]
    batches.append(stream_events(10, 3, 70) + batches[0][:15])  # repeats of an earlier batch
    batches.append(batches[1][:5] + batches[1][:5])
    every = {}
    columns = [*COLUMNS, "window_minutes", "suppress_minutes"]
    for number, rows in enumerate(batches):
        batch = spark.createDataFrame(rows, SCHEMA)
        if number == 1:
            panes.add(number, batch.limit(7))  # ended before all of it was there
        panes.add(number, batch)
        every |= {r[0]: r for r in rows}
        full = spark.createDataFrame(list(every.values()), SCHEMA)
        for now in (str(T0 + timedelta(minutes=601)), str(T0 + timedelta(minutes=200))):
            assert plain(panes.hits(now), columns) == plain(cycle.hits(full, RULES, now), columns)
        if number == 2:
            panes.forget("2026-10-01", 1)
            assert len(os.listdir(tmp_path / "p/panes/changes")) == 1
    # A batch writes the panes that it changes: the last one changes none.
    assert spark.read.parquet(*glob.glob(f"{tmp_path}/p/panes/changes/2")).count() > 0
    assert not glob.glob(f"{tmp_path}/p/panes/changes/3/part=*")
    panes.forget("2026-10-09", 0)
    assert panes.hits(str(T0 + timedelta(minutes=601))).count() == 0


def test_pairs_of_panes_are_dealt_once(spark):
    """Counts and newest events of a batch's panes come from one exchange, and older panes are added without another one."""
    from evspark.streaming.panes import _KEY, added, combined, panes_of

    rows = [("r", "g%d" % (i % 2), T0 + timedelta(seconds=i * 7 % 130), f"e{i}", f"x{i}") for i in range(60)]
    first, second = (spark.createDataFrame(part, cycle.PAIR) for part in (rows[:25], rows[25:]))
    assert panes_of(first)._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    both = added(panes_of(second), panes_of(first))
    assert both._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 2
    columns = [*_KEY, "n", "first_at", "last_at", "newest"]
    want = combined(panes_of(first).unionByName(panes_of(second)), _KEY).join(panes_of(second).select(*_KEY), _KEY, "left_semi")
    assert plain(both, columns) == plain(want, columns)


def test_rule_alerts_over_a_stream(spark, tmp_path):
    """Each batch's hits move or make alerts; a restart goes on where the last batch ended."""
    alerts = ChangeLog(spark, str(tmp_path / "alerts"), ALERTS, ["group_key", "id"], ["group_key"])
    panes = Panes(spark, str(tmp_path / "p"), RULES[1:2])
    source = str(tmp_path / "in")
    now = spark.range(1).select(F.current_timestamp()).first()[0]

    def run(number):
        rows = [(f"e{number}-{i}", "a", "syslog", None, now, None, "x", "{}") for i in range(2)]
        spark.createDataFrame(rows, SCHEMA).write.json(f"{source}/{number}")
        events = spark.readStream.schema(SCHEMA).json(f"{source}/*")
        detect.rule_alerts(events, RULES[1:2], panes, alerts, str(tmp_path / "ck"), availableNow=True).awaitTermination()
        return [(r.rule_id, r.group_key, r.event_count, r.status) for r in alerts.latest().collect()]

    assert run(0) == []  # two events are below the threshold
    assert run(1) == [("all", "all", 4, "open")]
    assert run(2) == [("all", "all", 6, "open")]  # the same alert
    assert spark.read.parquet(f"{tmp_path}/alerts/changes/2").count() == 1
    assert sorted(os.listdir(f"{tmp_path}/ck-arrivals")) == ["1", "2"]


SMALL = "id string, rule_name string, group_key string, severity string, status string, event_count long, first_event_at timestamp, last_event_at timestamp, created_at timestamp"


def test_indicator_alerts_are_counted_once(spark, tmp_path):
    library = spark.createDataFrame([("ip", "10.0.0.1", "f", "high", True)], "type string, value string, source string, severity string, enabled boolean")
    alerts = ChangeLog(spark, str(tmp_path / "alerts"), SMALL, ["group_key", "id"], ["group_key"])
    seen, ck = str(tmp_path / "seen"), str(tmp_path / "ck")
    event = lambda i, text: spark.createDataFrame([(f"e{i}", "a", "syslog", None, T0 + timedelta(minutes=i), None, text, "{}")], SCHEMA)
    event(1, "from 10.0.0.1").union(event(2, "from 10.0.0.2")).write.json(f"{seen}/1")
    scan = lambda: detect.indicator_alerts(spark.readStream.schema(SCHEMA).json(f"{seen}/*"), library, alerts, ck, availableNow=True).awaitTermination()
    scan()
    event(3, "10.0.0.1 again").write.json(f"{seen}/2")
    scan()
    got = alerts.latest().collect()
    assert [(r.group_key, r.event_count, r.status) for r in got] == [("ioc:ip:10.0.0.1", 2, "open")]
    # The last batch once more, as after a crash before it was noted as done.
    hits = ioc.matched(event(3, "10.0.0.1 again"), library)
    alerts.append(1, ioc.changed(alerts.latest(1), hits, "2026-10-01 00:03:00"))
    assert [r.event_count for r in alerts.latest().collect()] == [2]


STREAM_HIT = "kind string, at timestamp, " + HIT


def test_state_equals_the_batch_functions(spark, tmp_path):
    """Hits and closings over several batches with a restart before each, against changes applied to a table."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", False)
    rnd = random.Random(4)
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    alerts, want, minute = spark.createDataFrame([], ALERTS), [], 0
    for number in range(6):
        minute += rnd.choice([5, 15, 25, 70])
        at = T0 + timedelta(minutes=minute)
        close = alerts.filter("status <> 'closed'").select("rule_id", "group_key").distinct().limit(1).collect() if number in (2, 4) else []
        rows = [("close", at - timedelta(minutes=1), r.rule_id, None, r.group_key, None, None, None, None, None, None) for r in close]
        hits = [("r", "rule", g, "high", rnd.randrange(1, 20), at - timedelta(minutes=9), at - timedelta(minutes=rnd.randrange(5)), 10, 60 if g != "c" else 0) for g in "abc" if rnd.random() < 0.8]
        rows += [("hit", at, *h) for h in hits]
        spark.createDataFrame(rows, STREAM_HIT).coalesce(1).write.parquet(f"{source}/{number}")
        stream = alert_changes(spark.readStream.schema(STREAM_HIT).parquet(f"{source}/*"), 10_000)
        stream.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start(out).awaitTermination()
        for r in close:
            mine = alerts.filter((F.col("group_key") == r.group_key) & (F.col("status") != "closed"))
            newest = mine.orderBy(F.desc("last_event_at")).first()
            alerts = spark.createDataFrame(alerts.withColumn("status", F.when(F.col("id") == newest.id, "closed").otherwise(F.col("status"))).collect(), ALERTS)
            want.append((r.group_key, "closed", newest.id, newest.event_count, at - timedelta(minutes=1)))
        changed = cycle.changes(alerts, spark.createDataFrame(hits, HIT), str(at))
        want += [(r.group_key, r.change, r.id, r.event_count, at) for r in changed.collect()]
        alerts = spark.createDataFrame(cycle.applied(alerts, changed).collect(), ALERTS)
    got = plain(spark.read.parquet(out), ["group_key", "change", "id", "event_count", "at"])
    assert {g[1] for g in got} == {"created", "updated", "suppressed", "closed"}
    assert got == sorted(want, key=repr)
