import ipaddress
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from evspark.functions import predicates as P
from evspark.functions import rules as R
from evspark.operators import alerts as A
from evspark.operators import ioc, lists, rulesets, store, watch
from evspark.operators.match import by_capture, match_groups
from evspark.sources import ingest
from evspark.sources.envelope import SCHEMA
from evspark.sources.tables import EventTable, backup, copied, day_digests
from evspark.streaming import detect
from tests.data import T0, events


def test_table_is_idempotent_and_rejects(spark, tmp_path):
    t = EventTable(spark, str(tmp_path / "e"))
    a = events(spark).filter("tenant_id = 'a'")
    assert t.read("a").count() == 0
    bad = t.append(a.unionByName(spark.createDataFrame([("x", "b", "s", None, T0, None, "r", "{}"), (None, None, " ", None, None, None, "r", "{}"), (None, None, "s", None, None, None, "r", "[1]")], SCHEMA)), "a")
    assert sorted(r.rejected for r in bad.collect()) == ["another tenant", "parsed", "source_type"]
    assert t.append(a, "a").count() == 0 and t.read("a").count() == 10
    t.append(spark.createDataFrame([(None, None, " s ", " ", None, None, "a\0b", "{}")], SCHEMA), "a", "2026-10-02 00:00:00")
    r = t.read("a").filter("source_type = 's'").first()
    assert (r.raw, r.collector_id, r.received_at) == ("ab", None, datetime(2026, 10, 2)) and r.id
    kept = t.rewrite(t.read("a").filter("source_type <> 's'"), "a", str(tmp_path / "e2"))
    assert kept.read("a").count() == 10
    other = EventTable(spark, str(tmp_path / "copy"))
    assert copied(a, other, "a").count() == 0 and other.read("a").count() == 10
    manifest = backup(a, str(tmp_path / "b"))
    assert backup(a, str(tmp_path / "b2"), manifest).count() == 1 and spark.read.json(str(tmp_path / "b" / "*")).count() == 10
    assert day_digests(a).first().digest == day_digests(a.orderBy(F.desc("id"))).first().digest


def test_store_reads(spark):
    a = events(spark).filter("tenant_id = 'a'")
    assert [r.id for r in store.scan_page(a, None, 3).collect()] == ["01", "02", "03"]
    assert [r.id for r in store.scan_page(a, ("2026-10-01 00:30:00", "03"), 2).collect()] == ["04", "05"]
    assert [(r.key, r.n) for r in store.group_counts(a, "collector_id").collect()] == [("c1", 5), ("c3", 2), ("c2", 1), ("c4", 1)]
    assert {r["path"]: r.n for r in store.leaf_paths(a).collect()} == {"source.ipv4": 2, "event.outcome": 2}
    assert store.field_keys(a).first().n == 9
    policy = spark.createDataFrame([("mac", None), ("router", 1)], "source_type string, days int")
    assert {r.source_type: r.n for r in store.expired_counts(a, policy, 2, "2026-10-03 01:10:00").collect()} == {"syslog": 4, "router": 1}


def _alerts(spark):
    at = lambda m: T0 + timedelta(minutes=m)
    rows = [
        ("1", "r1", "R1", "g", "low", "open", 3, 0, None, at(0), at(5), at(1)),
        ("2", "r1", "R1", "g", "high", "acknowledged", 4, 1, "u", at(2), at(9), at(3)),
        ("3", "r1", "R1", "h", "low", "closed", 1, 0, None, at(0), at(1), at(1)),
        ("4", None, "R9", "g", "low", "acknowledged", 1, 0, "v", None, at(1), at(4)),
        ("5", None, "R9", "g", "medium", "acknowledged", 1, 0, "w", None, at(3), at(2)),
    ]
    return spark.createDataFrame(rows, "id string, rule_id string, rule_name string, group_key string, severity string, status string, event_count long, merged_count long, assignee_id string, first_event_at timestamp, last_event_at timestamp, created_at timestamp")


def test_merge_plan(spark):
    got = {r.ident: r for r in A.merge_plan(_alerts(spark)).collect()}
    a, b = got["r1"], got["R9"]
    assert (a.primary_id, a.n, a.severity, a.status, a.assignee_id, a.event_count, a.merged_count) == ("1", 2, "high", "open", "u", 7, 3)
    assert (b.primary_id, b.severity, b.status, b.assignee_id) == ("5", "medium", "acknowledged", "w")
    assert [(r.id, r.rn) for r in A.duplicates(_alerts(spark)).filter("ident = 'r1'").collect()] == [("1", 1), ("2", 2)]


def test_upsert(spark):
    hit = spark.createDataFrame([("r1", "R1", "g", "high", 9, T0, T0 + timedelta(minutes=20)), ("r1", "R1", "h", "high", 2, T0, T0)], "rule_id string, rule_name string, group_key string, severity string, n long, first_at timestamp, last_at timestamp")
    after, new = A.upserted(_alerts(spark), hit, "2026-10-01 00:15:00", 10)
    got = {r.id: r for r in after.collect()}
    assert got["2"].event_count == 9 and got["2"].last_event_at == T0 + timedelta(minutes=20) and got["1"].event_count == 3
    assert [(r.group_key, r.status) for r in new.collect()] == [("h", "open")]
    assert A.upserted(_alerts(spark), hit, "2026-10-01 00:15:00", 10, 30)[1].count() == 0


def test_watches(spark):
    at = lambda m: T0 - timedelta(minutes=m)
    reg = spark.createDataFrame([("c1", at(5), None, 30), ("c2", at(50), 60, 30), ("c3", at(50), None, None), ("c4", at(1), None, 1)], "name string, last_seen timestamp, within_minutes int, silent_minutes int")
    now = str(T0)
    assert [r.name for r in watch.disconnected(reg, now).collect()] == ["c3"]
    seen = spark.createDataFrame([("c1", at(10)), ("c4", at(10))], "collector_id string, received_at timestamp")
    assert [r.name for r in watch.silent(reg, seen, now).collect()] == ["c4"]
    samples = spark.range(1000).select(F.timestamp_seconds("id").alias("at"), "id")
    thin = watch.thinned(samples, "at", 10).collect()
    assert len(thin) == 10 and thin[-1].id == 999
    growth = spark.createDataFrame([("2026-09-30", 10), ("2026-09-29", 5), ("2026-10-01", 99)], "day string, n long")
    assert watch.daily_growth(growth, now).first().per_day == 7


def test_lists(spark):
    a = spark.createDataFrame([(1, "10.0.0.0/8"), (2, "10.1.2.3"), (3, "11.0.0.1"), (4, "bad")], "i int, v string")
    b = spark.createDataFrame([(7, "10.1.0.0/16"), (8, "10.1.2.3/32"), (9, "0.0.0.0/0")], "j int, w string")
    assert sorted((r.i, r.j) for r in lists.overlapping(a, b, "v", "w").collect()) == [(1, 7), (1, 8), (1, 9), (2, 7), (2, 8), (2, 9), (3, 9)]
    d = spark.createDataFrame([(1, "a.b.example"), (2, "b.example"), (3, "xb.example"), (4, "other.org")], "i int, v string")
    allowed = spark.createDataFrame([("b.example",), ("x.other.org",)], "domain string")
    assert sorted((r.i, r.domain) for r in lists.covered_domains(d, allowed, "v", "domain").collect()) == [(1, "b.example"), (2, "b.example"), (4, "x.other.org")]


def test_feed_reconcile(spark):
    lines = spark.createDataFrame([("# note",), ('"evil.example",x',), ("1.2.3[.]4 ; gone",), ("junk",), ("EVIL.example",)], "value string")
    now = ingest.feed_values(lines, "feed", "high")
    assert sorted((r.type, r.value) for r in now.collect()) == [("domain", "evil.example"), ("ip", "1.2.3.4")]
    listed = spark.createDataFrame([("ip", "9.9.9.9", "feed", "high", True, None), ("ip", "8.8.8.8", "mine", "low", True, None), ("domain", "evil.example", "feed", "high", False, T0)], "type string, value string, source string, severity string, enabled boolean, expires_at timestamp")
    got = {r.value: r for r in lists.reconciled(listed, now, str(T0)).collect()}
    assert got["9.9.9.9"].expires_at == T0 and got["8.8.8.8"].expires_at is None
    assert got["evil.example"].enabled and got["evil.example"].expires_at is None and got["1.2.3.4"].enabled
    assert [r.value for r in lists.published(lists.reconciled(listed, now, str(T0)), str(T0)).collect()] == ["1.2.3.4", "8.8.8.8", "evil.example"]


def test_rulesets(spark):
    ssh = rulesets.Rule("sshd", P.equals("app_name", "sshd"), {"ssh.user": R.arrayindex(R.regextract(F.col("raw"), r"for (?:invalid user )?(\w+)"), 0), "host": F.upper(F.get_json_object("parsed", "$.host"))}, ("by*",))
    rest = rulesets.Rule("rest", F.lit(True), {"seen": F.lit("yes")}, source_type="SYSLOG")
    got = {int(r.id): r for r in rulesets.parsed(events(spark).filter("tenant_id = 'a'"), [ssh, rest]).select("id", "rule", "parsed", F.get_json_object("parsed", "$.ssh.user").alias("u"), F.get_json_object("parsed", "$.bytes").alias("b"), F.get_json_object("parsed", "$.xdm.event.outcome").alias("o")).collect()}
    assert (got[1].rule, got[1].u, got[1].b, got[1].o) == ("sshd", "admin", None, "FAILED") and '"host":"WEB01"' in got[1].parsed
    assert (got[3].rule, got[3].b) == ("rest", "12.5") and got[5].rule is None and '"tags":["a","b"]' in got[5].parsed
    model = rulesets.modelled(events(spark), [rulesets.Rule("a", F.lit(True), {"x.host": F.get_json_object("parsed", "$.host"), "k": F.lit("1")}), rulesets.Rule("b", P.equals("host", "rtr"), {"k": F.lit("")})])
    docs = {int(r.id): r.parsed for r in model.collect()}
    assert '"xdm":{"x":{"host":"rtr"}}' in docs[7] and '"k":"1"' in docs[3]
    keep = rulesets.kept_by_policy(events(spark), [rulesets.DropRule("MAC", pattern="UPPER", action="keep"), rulesets.DropRule(ids=((1, 2), (8, 8)))], F.col("source_type"), F.col("id").cast("int"), {"mac": "drop"}, erase=["dup "])
    assert {int(r.id): r.raw for r in keep.collect()} == {3: "sudo: bob : COMMAND=/bin/ls", 4: "no host here", 6: "UPPER and lower CaSe", 7: "dhcp 100%_done\\ back\\slash", 9: "no event time", 10: "host", 11: "other tenant web01"}
    found = rulesets.hits(events(spark), rulesets.Detection("f", "high", lambda: [P.contains("_raw", "failed")], "field:host"), str(T0 + timedelta(minutes=60)))
    assert sorted((r.group_key, r.n) for r in found.collect()) == [("mbp", 1), ("web01", 1)]
    with pytest.raises(ValueError):
        rulesets.Detection("f", "high", list, threshold=0)


def test_sources(spark):
    lines = spark.createDataFrame([("Oct  1 00:00:01 web01 sshd[42]: Failed password",), ("2024-01-02T03:04:05Z h app: x",), ("free text",), (" ",)], "value string")
    got = ingest.text_lines(lines, "me").select(*[F.get_json_object("parsed", f"$.{k}") for k in ("format", "host", "app_name", "proc_id", "message")], "event_time").collect()
    assert [tuple(r) for r in got] == [("syslog-file", "web01", "sshd", "42", "Failed password", None), ("syslog-file", "h", "app", None, "x", datetime(2024, 1, 2, 3, 4, 5)), ("plain", "me", None, None, "free text", None)]
    j = ingest.json_batch(spark.createDataFrame([("m", None, "2024-01-02 03:04:05"), (None, "r", "Jan 1"), (" ", None, None)], "message string, raw string, time string")).collect()
    assert [(r.raw, r.event_time) for r in j] == [("m", datetime(2024, 1, 2, 3, 4, 5)), ("r", None)]


def test_ioc(spark):
    ind = spark.createDataFrame([("ip", "203.0.113.9", "s", "high", True), ("ip", "10.0.0.5", "s", "low", False)], "type string, value string, source string, severity string, enabled boolean")
    got = ioc.matched(events(spark), ind).collect()
    assert [(r.key, r.n, r.sample_ids) for r in got] == [("ip:203.0.113.9", 1, ["01"])]


def test_streams(spark, tmp_path):
    a = events(spark).filter("tenant_id = 'a'")
    for k in range(2):
        a.write.mode("append").parquet(str(tmp_path / "in"))  # every event twice
    stream = lambda n=1000: spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", n).parquet(str(tmp_path / "in"))
    detect.ingest(stream(5), str(tmp_path / "out"), str(tmp_path / "c1"), "a", availableNow=True).awaitTermination()
    assert EventTable(spark, str(tmp_path / "out")).read("a").count() == 10
    ind = spark.createDataFrame([("ip", "203.0.113.9", "s", "high", True)], "type string, value string, source string, severity string, enabled boolean")
    seen: list = []
    detect.each_batch(detect.indicator_hits(detect.deduplicated(stream()), ind), lambda df, n: seen.extend(r.id for r in df.collect()), str(tmp_path / "c2"), availableNow=True).awaitTermination()
    assert seen == ["01"]
    q = detect.windowed_counts(stream(), F.col("source_type"), "30 minutes", "30 minutes").writeStream.format("memory").queryName("w").outputMode("complete").option("checkpointLocation", str(tmp_path / "c3")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert sum(r.n for r in spark.table("w").collect()) == 20


def test_a_run_raises_more_than_100_groups(spark):
    """A distributed attack: 300 addresses over the threshold, each of them a hit; 1000 at most."""
    at = T0 + timedelta(minutes=5)
    many = spark.range(1100 * 2).select(F.col("id").cast("string").alias("id"), F.concat(F.lit("Failed password from 10.0."), F.concat_ws(".", (F.col("id") % 1100 / 256).cast("int").cast("string"), (F.col("id") % 1100 % 256).cast("string"))).alias("raw"), (F.col("id") % 1100).alias("host"))
    e = many.select("id", F.lit("a").alias("tenant_id"), F.lit("syslog").alias("source_type"), F.lit("c1").alias("collector_id"), F.lit(at).alias("received_at"), F.lit(at).alias("event_time"), "raw", F.lit("{}").alias("parsed"), "host")
    rule = rulesets.Detection("f", "high", lambda: [P.contains("_raw", "failed password")], r"from (\S+)", 2, 10)
    now = str(T0 + timedelta(minutes=10))
    got = rulesets.hits(e.filter("host < 300").drop("host"), rule, now).collect()
    assert len({r.group_key for r in got}) == len(got) == 300 and {r.n for r in got} == {2}
    assert rulesets.hits(e.drop("host"), rule, now).count() == 1000
    assert match_groups(e.filter("host < 300").drop("host"), group=by_capture(r"from (\S+)")).count() == 300


def test_syslog_by_the_grammar(spark):
    data = r'[a@1 k="x\]y" q="say \"hi\"" e="\\"][b][c z=""]'
    lines = [
        (rf"<34>1 2024-01-02T03:04:05Z h app 7 ID {data} the [text]", ("rfc5424", "h", "app", "7", "ID", data, None, "the [text]")),
        ("<34>1 2024-01-02T03:04:05Z h app 7 ID - - dash", ("rfc5424", "h", "app", "7", "ID", None, None, "- dash")),
        ("<34>1 2024-01-02T03:04:05Z h - - - [not data] text", ("rfc5424", "h", None, None, None, None, None, "[not data] text")),
        ('<34>1 2024-01-02T03:04:05Z h - - - [a b="open] text', ("rfc5424", "h", None, None, None, None, None, '[a b="open] text')),
        ('<34>1 - h app - - [a b="1"]', ("rfc5424", "h", "app", None, None, '[a b="1"]', None, "")),
        ("<13>Oct  1 00:00:01 h su[1]: a: b", ("rfc3164", "h", None, None, None, None, "su[1]", "a: b")),
        ("<13>Oct  1 00:00:01 h no colon", ("unstructured", None, None, None, None, None, None, "<13>Oct  1 00:00:01 h no colon")),
        ("<13>Foo  1 00:00:01 h tag: x", ("unstructured", None, None, None, None, None, None, "<13>Foo  1 00:00:01 h tag: x")),
        ("<34>0 t h a p m - version 0", ("unstructured", None, None, None, None, None, None, "<34>0 t h a p m - version 0")),
        ("plain", ("unstructured", None, None, None, None, None, None, "plain")),
    ]
    keys = ("format", "host", "app_name", "proc_id", "msg_id", "structured_data", "tag", "message")
    got = ingest.syslog(spark.createDataFrame([(x,) for x, _ in lines], "value string"), year=2024)
    got = {r.raw: tuple(r)[1:] for r in got.select("raw", *[F.get_json_object("parsed", f"$.{k}") for k in keys]).collect()}
    assert got == dict(lines)
    long = "<34>1 - h a - - [a b=\"" + r"\]" * 4000 + "\"] end"
    assert ingest.syslog(spark.createDataFrame([(long,)], "value string")).select(F.get_json_object("parsed", "$.message")).first()[0] == "end"


def test_depth_ignores_strings(spark):
    from evspark.sources.envelope import depth

    docs = [('{"k":"[[[[ \\" ]"}', 1), (r'{"\\":[1]}', 2), ('{"[{":{"a\\\\":"}"}}', 2), ("{}", 1), ('{"a":"' + '\\"[' * 300_000 + '"}', 1)]
    got = spark.createDataFrame(docs, "d string, n int").select(depth(F.col("d")).alias("depth"), "n").collect()
    assert [r.depth for r in got] == [r.n for r in got]


@pytest.mark.parametrize("document", ["{bad", '{"other": []}', "7", '"text"', ""])
def test_broken_feeds_are_refused(spark, document):
    lines = spark.createDataFrame([(document,)], "value string")
    with pytest.raises(Exception, match="BAD_FORMAT"):
        ingest.feed_values(lines, "feed", "low", form="json").collect()
    assert ingest.feed_values(spark.createDataFrame([('{"data": []}',)], "value string"), "feed", "low", form="json").count() == 0


def test_leaves_of_deep_documents(spark):
    deep = "1"
    for i in range(24):
        deep = '{"k%d":%s}' % (i, deep)
    docs = ['{"xdm":{"a":{"b":{"c":null,"d":[{"x":1}],"e":{}}},"f.g":"t"}}', '{"xdm":{}}', '{"xdm":3}', '{"xdm":%s}' % deep, '{"xdm":{"a":{"b":{"c":2}}}}', "bad", None]
    rows = [(str(i), T0, d) for i, d in enumerate(docs)]
    e = spark.createDataFrame(rows, "id string, received_at timestamp, parsed string")
    assert {r["path"]: r.n for r in store.leaf_paths(e).collect()} == {"a.b.c": 2, "a.b.d": 1, "f.g": 1}  # beyond twenty levels nothing
    assert store.leaf_paths(e.limit(0)).count() == 0 and "Python" not in store.leaf_paths(e)._jdf.queryExecution().executedPlan().toString()


def test_p95_of_odd_values(spark):
    import math
    import random

    from evspark.operators import watch

    rnd = random.Random(6)
    groups = {"neg": [-rnd.random() * 100 for _ in range(97)], "mix": [rnd.choice([-1, 1]) * 10 ** rnd.uniform(-5, 5) for _ in range(200)], "same": [3.5] * 50, "zero": [0.0, -0.0, 5e-324, -5e-324], "inf": [float("-inf"), 1.0, float("inf")], "one": [7.0], None: [1.0, 2.0]}
    rows = [(g, v) for g, vs in groups.items() for v in vs] + [("none", None), ("one", None)]
    got = {r.g: r.p95 for r in watch.p95(spark.createDataFrame(rows, "g string, v double").repartition(3), "v", "g").collect()}
    assert got == {g: sorted(vs)[math.ceil(0.95 * len(vs)) - 1] for g, vs in groups.items()}
    nan = watch.p95(spark.createDataFrame([(1, float("nan")), (1, 2.0)], "g int, v double"), "v", "g").first().p95
    assert math.isnan(nan)
    many = spark.range(200_000).selectExpr("id % 2 as g", "1000 + id * 1e-3 as v")
    plan = watch.p95(many, "v", "g")
    assert plan.count() == 2


def test_notify_meets_wanted_alerts_only(spark):
    import random

    rnd = random.Random(8)
    levels = ["critical", "high", "medium", "low", "odd", None]
    channels = [(f"c{i}", f"t{i % 3}", rnd.choice(levels[:4]), T0 - timedelta(days=rnd.randrange(200)), rnd.choice([None, "x", "RULE"])) for i in range(12)] + [("late", "t0", "low", T0 + timedelta(days=9), None)]
    rows = [(f"a{i}", f"t{rnd.randrange(4)}", rnd.choice(levels), rnd.choice(["rule x", "other", None]), T0 - timedelta(days=rnd.randrange(220), seconds=rnd.randrange(9999))) for i in range(300)]
    c = spark.createDataFrame(channels, "channel_id string, tenant_id string, min_severity string, created_at timestamp, name_filter string")
    a = spark.createDataFrame(rows, "id string, tenant_id string, severity string, rule_name string, created_at timestamp")
    rank = lambda s: levels[:4].index(s) if s in levels[:4] else 4
    want = {(k[0], x[0]) for k in channels for x in rows if k[1] == x[1] and rank(x[2]) <= rank(k[2]) and x[4] >= k[3] and (k[4] is None or (x[3] and k[4].lower() in x[3].lower()))}
    sent = set(sorted(want)[::5])
    got = {(r.channel_id, r.alert_id) for r in A.to_notify(c, a, spark.createDataFrame(sorted(sent), "channel_id string, alert_id string")).collect()}
    assert got == want - sent and len(got) > 50
    assert A.to_notify(c, a.limit(0), spark.createDataFrame([], "channel_id string, alert_id string")).count() == 0


def test_requests_are_checked():
    from evspark.operators import endpoints as E

    now = "2026-10-02 00:00:00"
    got = E.asked({"severity": "high", "exclude_rule": "1,2,1", "window": "1h", "limit": "7", "mitre": "T1110.003", "q": ""}, now)
    assert got == E.Asked(E.AlertFilter(severity="high", exclude=("1", "2"), technique="T1110.003"), "2026-10-01 23:00:00", 7, 0)
    bad = [{"nope": "1"}, {"window": "2h"}, {"severity": "odd"}, {"rule": "x1"}, {"rule": "12345678901"}, {"exclude_rule": "1,,2"}, {"exclude_rule": ",".join(map(str, range(21)))}, {"mitre": "T11"}]
    bad += [{"mitre": "T1110.3"}, {"q": "two\nlines"}, {"q": "x" * 201}, {"agent": "\x7f"}, {"policy": "a\tb"}, {"kind": "other"}, {"file_event": "moved"}, {"check_result": "not applicable"}, {"limit": "0"}, {"limit": "101"}, {"offset": "901"}, {"offset": "-1"}]
    for parameters in bad:
        with pytest.raises(ValueError):
            E.asked(parameters, now)


def test_encrypted_backup(spark, tmp_path):
    from evspark.sources.tables import damaged, restored

    rows = [(f"e{i}", "a", "syslog", None if i % 3 else "c", T0 + timedelta(days=i % 4, minutes=i), None, f"line {i} \u00e9", '{"n":%d}' % i) for i in range(20)]
    e = spark.createDataFrame(rows, SCHEMA)
    folder = str(tmp_path / "b")
    one = backup(e, folder, secret="s3cret", now_day="2026-10-04")
    one = spark.createDataFrame(one.collect(), one.schema)
    back = restored(spark, folder, one, "s3cret")
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, e.collect())) and damaged(spark, folder, one, "s3cret").count() == 0
    text = spark.read.text(f"{folder}/*/*").collect()
    assert len(text) == 20 and not any("line" in r.value for r in text)
    assert restored(spark, folder, one, "other").count() == 0 and damaged(spark, folder, one, "other").count() == 4
    # Unchanged, but the last two days are written again.
    two = backup(e, folder, one, secret="s3cret", now_day="2026-10-04").collect()
    assert {r.day for r in two if r.part not in {x.part for x in one.collect()}} == {"2026-10-03", "2026-10-04"}
    assert "s3cret" not in back._jdf.queryExecution().toString() and "binary_literal" not in back._jdf.queryExecution().toString()


def test_quarantine(spark, tmp_path):
    """Three failures pause a source for a minute; others are parsed meanwhile; a batch that comes again is treated as before."""
    from evspark.streaming.quarantine import Quarantine

    bad = {"on": True}

    def parse(rows):
        broken = F.when((F.col("source_type") == "bad") & F.lit(bad["on"]), F.raise_error(F.lit("no"))).otherwise('{"done":1}')
        return rows.withColumn("parsed", broken)

    rows = [(f"{s}{i}", "a", s, None, T0, None, "x", '{"k":1}') for i in range(2) for s in ("bad", "good")] + [("n", "a", None, None, T0, None, "x", "{}")]
    batch = spark.createDataFrame(rows, SCHEMA)
    q = lambda: Quarantine(spark, str(tmp_path / "q"), "rules 1")

    def run(number, second, frame=batch):
        got = q().run(frame, number, f"2026-10-01 00:00:{second:02d}" if second < 60 else "2026-10-01 00:01:%02d" % (second - 60), parse).collect()
        assert len(got) == frame.count() and all(r.parsed == '{"done":1}' for r in got if r.source_type != "bad")
        return {F_.group(1) if (F_ := __import__("re").search('_parse_error":"(\\w+)"', r.parsed)) else "ok" for r in got if r.source_type == "bad"}

    assert [run(n, n) for n in range(3)] == [{"PARSE_FAILED"}] * 3
    assert run(3, 10) == {"PARSE_QUARANTINED"} and run(4, 61) == {"PARSE_QUARANTINED"}  # until 00:01:02
    assert run(3, 10) == {"PARSE_QUARANTINED"}  # the batch again
    assert run(5, 63) == {"PARSE_FAILED"}  # tried again, one strike
    bad["on"] = False
    assert run(6, 64) == {"ok"} and q().log.latest().first().strikes == 0
    bad["on"] = True
    assert [run(n, n + 60) for n in (7, 8)] == [{"PARSE_FAILED"}] * 2  # strikes start anew
    assert Quarantine(spark, str(tmp_path / "q"), "rules 2").run(batch.limit(0), 9, "2026-10-01 00:02:00", parse).count() == 0


def test_slow_rules_are_stopped(spark, tmp_path):
    import time

    from evspark.streaming.quarantine import Quarantine

    batch = spark.createDataFrame([("1", "a", "slow", None, T0, None, "x", "{}")], SCHEMA)
    wait = F.udf(lambda x: time.sleep(60) or x)
    began = time.time()
    got = Quarantine(spark, str(tmp_path / "q"), "r", limit_seconds=3).run(batch, 0, "2026-10-01 00:00:00", lambda rows: rows.withColumn("parsed", wait("parsed"))).first()
    assert "PARSE_TIMEOUT" in got.parsed and time.time() - began < 40


def test_blocks_of_lists_keep_columns(spark):
    """Columns with the names of a block's parts stay as they are, other texts and nulls have no block, and no filter makes the block again."""
    rows = [("10.1.2.3/16", 1, "a"), ("2001:DB8::/32", 2, "b"), ("10.1.9.9", 3, "c"), ("no address", 4, "d"), (None, 5, "e"), ("10.1.2.3/33", 6, "f")]
    left = spark.createDataFrame(rows, "ip string, start int, text string")
    got = lists._blocks(left, "ip")
    assert got.columns == ["ip", "start", "text", "_start", "_bits"]
    assert sorted((r.start, r.text, bytes(r._start).hex(), r._bits) for r in got.collect()) == [(1, "a", "0" * 20 + "ffff0a010000", 112), (2, "b", "20010db8" + "0" * 24, 32), (3, "c", "0" * 20 + "ffff0a010909", 128)]
    assert "Filter" not in got._jdf.queryExecution().optimizedPlan().toString()
    right = spark.createDataFrame([("10.1.0.0/24", 1), ("10.1.9.0/24", 2), ("2001:db8:1::", 3), ("::/0", 4)], "block string, n int")
    pairs = {(r.start, r.n) for r in lists.overlapping(left, right, "ip", "block").collect()}
    assert pairs == {(1, 1), (1, 2), (3, 2), (2, 3), (1, 4), (2, 4), (3, 4)}


def test_overlaps_of_large_groups_meet_in_pieces(spark, monkeypatch):
    """One address and one block of many rows are the work of many tasks; groups of any size give each pair once."""
    for name, value in (("TASK_PAIRS", 1000), ("FEW_PAIRS", 20), ("PIECE", 16)):
        monkeypatch.setattr(lists, name, value, raising=False)
    one = lambda n, value: spark.range(n).select("id", F.lit(value).alias("value"), F.create_map(F.lit("k"), "id").alias("m"))
    pairs = lists.overlapping(one(300, "10.1.2.3"), one(200, "10.1.0.0/16"), "value", "value")
    assert pairs.columns == ["id", "value", "m"] * 2
    met = pairs.toDF("i", "v", "m", "j", "w", "o")
    tasks = met.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()
    assert sum(t.n for t in tasks) == 60_000 and max(t.n for t in tasks) < 6000
    assert met.select("i", "j").distinct().count() == 60_000
    text = lambda i, sizes: f"10.{i * i % 3}.{i % 5}.{i % 2}/{sizes[i % len(sizes)]}" if i % 7 else f"2001:db8::{i % 2}"
    left = [(i, text(i, (32, 32, 24, 16))) for i in range(150)] + [(150, None), (151, "none")]
    right = [(i, text(i, (8, 24, 20, 32))) for i in range(120)]
    found = sorted(map(tuple, lists.overlapping(spark.createDataFrame(left, "i int, a string"), spark.createDataFrame(right, "j int, b string"), "a", "b").select("i", "j").collect()))
    net = {v: ipaddress.ip_network(v, strict=False) for _, v in left[:150] + right}
    assert found == [(i, j) for i, a in left[:150] for j, b in right if net[a].version == net[b].version and net[a].overlaps(net[b])]


def test_texts_of_lists_become_blocks_once(spark, monkeypatch):
    """However many rows have a text; texts of one block meet the same rows, and a row that is there twice makes its pairs twice."""
    made, blocks = [], lists._blocks
    monkeypatch.setattr(lists, "_blocks", lambda rows, value: made.append(rows.count()) or blocks(rows, value))
    left = [(i, ("10.0.0.7", " 10.0.0.7/32 ", "2001:DB8::1", "2001:db8:0::1", "none", None)[i % 6]) for i in range(120)] + [(0, "10.0.0.7")]
    right = [(j, ("10.0.0.0/24", "10.0.0.9/24", "2001:db8::/32", "10.1.0.0/16", None)[j % 5]) for j in range(50)]
    a, b = spark.createDataFrame(left, "i int, a string"), spark.createDataFrame(right, "j int, b string")
    want = sorted((i, j) for i, v in left for j, _ in right if (i % 6 < 2 and j % 5 < 2) or (i % 6 in (2, 3) and j % 5 == 2))
    for most in (lists.TASK_PAIRS, 100):
        for name, value in (("TASK_PAIRS", most), ("FEW_PAIRS", min(most, 300)), ("PIECE", 8)):
            monkeypatch.setattr(lists, name, value)
        assert sorted(map(tuple, lists.overlapping(a, b, "a", "b").select("i", "j").collect())) == want
    assert made == [6, 5] * 2
